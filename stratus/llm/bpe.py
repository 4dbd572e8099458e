"""Byte-level BPE encoding and decoding as a tree reduction.

The token sequences of byte strings form a monoid whose product is "the
encoding of the concatenation".  A long piece is halved down to short leaves,
each leaf is merged directly, and neighbours are joined by encoding a window
around their seam again.  The window grows until the tokens at its edges fit
their outer neighbours: two tokens fit if encoding their concatenated bytes
gives the same two tokens.  A sequence whose neighbours all fit pairwise is the
encoding of its bytes, so nothing outside the window can change any more.

Texts are cut by the tokenizer's pattern; each match is encoded by itself, so
the upper levels of the tree only concatenate.  Decoding concatenates the
tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 16  # bytes merged directly
NONE = 1 << 40  # no such token
CACHED = 400_000  # entries of a worker's cache; it starts anew when full
# Unicode White_Space, which the pattern's \s stands for in every engine (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def compiled(pattern: str):
    import regex

    spaces = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    return regex.compile(spaces)


class Matches(dict):
    """Encodings of the pattern's matches seen so far; long ones aren't kept."""

    def __init__(self, piece):
        self.piece = piece

    def __missing__(self, text: str) -> bytes:
        found = array("I", self.piece(text.encode("utf-8"))).tobytes()
        if len(text) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Encodes and decodes single texts; one per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = compiled(pattern).findall
        self.matches = Matches(self.piece)
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging: always the leftmost pair of lowest rank."""
        ranks = self.ranks
        n = len(data)
        if n <= 64:
            parts = [data[i : i + 1] for i in range(n)]
            pairs = [ranks.get(data[i : i + 2], NONE) for i in range(n - 1)]
            while pairs and (low := min(pairs)) != NONE:
                at = pairs.index(low)
                parts[at] += parts.pop(at + 1)
                del pairs[at]
                if at:
                    pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], NONE)
                if at < len(pairs):
                    pairs[at] = ranks.get(parts[at] + parts[at + 1], NONE)
            return [ranks[p] for p in parts]
        after = list(range(1, n + 1))  # start of the next part
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            alive[after[i]] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            j = before[i]
            if j >= 0 and (r := ranks.get(data[j:end])) is not None:
                heapq.heappush(heap, (r, j, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : after[i]]])
            i = after[i]
        return out

    def fit(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of the concatenated bytes of two encodings."""
        k = 1
        while True:
            left, right = a[-k:], b[:k]
            window = self.merge(b"".join(self.bytes_of[t] for t in left + right))
            sure = (k >= len(a) or self.fit(a[-k - 1], window[0])) and (k >= len(b) or self.fit(window[-1], b[k]))
            if sure:
                return a[:-k] + window + b[k:]
            k *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        rank = self.ranks.get(data)
        return [rank] if rank is not None else self.tree(data)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers."""
        return b"".join(map(self.matches.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I")
        numbers.frombytes(ids)
        return self.concatenated(numbers)

    def concatenated(self, numbers) -> bytes:
        if len(numbers) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, numbers))
        half = len(numbers) // 2
        return self.concatenated(numbers[:half]) + self.concatenated(numbers[half:])


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(sent, pattern: str) -> Encoder:
    """The worker's encoder, built once per process from the broadcast rank file."""
    data = sent.value
    key = (len(data), hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(data), pattern)
    return _ENCODERS[key]


class Tokenizer:
    """A rank file (``path``) and its pattern, usable on DataFrames.

    The rank file is read once by the driver and broadcast; its size is that of
    the vocabulary and doesn't grow with the data.
    """

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as f:
            self.sent = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def _map(self, df: DataFrame, source: str, out: str, call: str) -> DataFrame:
        sent, pattern = self.sent, self.pattern
        fields = [f for f in df.schema.fields if f.name != out]
        at = df.columns.index(source)
        keep = [df.columns.index(f.name) for f in fields]

        def run(parts):
            encoder = _encoder(sent, pattern)
            work = getattr(encoder, call)
            empty = "" if call == "encode" else b""
            for part in parts:
                made = pa.array([work(x.as_py() or empty) for x in part.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), made], names=[*(part.schema.names[i] for i in keep), out])

        schema = df.select(*[F.col(f"`{f.name}`") for f in fields]).withColumn(out, F.lit(None).cast("binary")).schema
        return df.mapInArrow(run, schema)

    def encode(self, df: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame:
        """``df`` with column ``out``: token ids of the whole text as little-endian
        unsigned 32-bit integers.  Null and empty texts have no ids.  A column
        already named ``out`` is replaced; every row stays."""
        return self._map(df, text_col, out, "encode")

    def decode(self, df: DataFrame, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
        """``df`` with column ``out``: the bytes that the ids stand for (none for null)."""
        return self._map(df, ids_col, out, "decode")


def round_trip(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row."""
    coded = tokenizer.encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    back = tokenizer.decode(coded)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
