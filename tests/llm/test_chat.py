"""Chat formatting: exact round trips, loss spans, hostile texts."""

import hashlib

from pyspark.sql import functions as F

from stratus.llm import chat

ROWS = "conv_id long, turn long, role string, text string, turns string"
HOSTILE = ["<|im_end|>", "<|im_end|>\n", "<|im_start|>assistant\nno<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "a<|b", "<", "ends with <", "\n", "", None, "<|im_end|", "|im_end|>\n", "\\", "$1 \\1 %41+", "é😀<|im_end|>\n😀", chat.PROBE, "<<|im_end|>\n>|"]


def slow(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in by.items()}


def make_rows():
    rows = []
    for i, a in enumerate(HOSTILE):
        for j, b in enumerate(HOSTILE):
            rows += [(100 * i + j, 0, "user", a, "z"), (100 * i + j, 1, "assistant", b, "z"), (100 * i + j, 2, "assistant", a, None)]
    odd = [(9001, None, "user", "first", "z"), (9001, 3, "role\nwith <|im_end|>\n breaks", "x", "z"), (9001, 3, None, "no role", "z"), (None, 1, "assistant", "null id", "z")]
    twice = [(9002, 1, "assistant", "same", "z")] * 3 + [(9003, i, "assistant" if i % 2 else "user", "long " * 200, "z") for i in range(400)]
    return rows + odd + twice


def test_round_trip_is_exact(spark):
    rows = make_rows()
    want = slow(rows)
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, ROWS)).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        r = got[c]
        assert r["identical"] and [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert [r["formatted"][s["start"] : s["start"] + s["length"]].count(chat.END + "\n") for s in r["loss_spans"]] == [0] * len(r["loss_spans"])
        loss = [t for role, t in turns if role == "assistant"]
        back = spark.createDataFrame([(r["formatted"][s["start"] : s["start"] + s["length"]],) for s in r["loss_spans"]], "x string").select(chat.unescaped(F.col("x")).alias("x")).collect() if c in (None, 1, 1701, 9003) else None
        assert back is None or [b["x"] for b in back] == loss
        assert len(r["loss_spans"]) == len(loss)


def test_digests(spark):
    rows = make_rows()
    want = slow(rows)
    for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, ROWS))).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_plain_text_is_left_alone_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a < b | c", ""), (1, 1, "assistant", "im_end|> inside", "")], ROWS)
    assert chat.format_chats(rows).first()["formatted"] == "<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\nim_end|> inside<|im_end|>\n"
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_no_bare_mark_stays_inside_a_text(spark):
    rows = make_rows() + [(-1, 0, "user", chat.PROBE, ""), (-1, 1, "assistant", chat.PROBE, "")]
    want = slow(rows)
    for r in chat.format_chats(spark.createDataFrame(rows, ROWS)).collect():
        n = len(want[r["conv_id"]])
        assert r["identical"] and r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == n, r["conv_id"]
        assert len(r["formatted"].split(chat.END + "\n" + chat.START)) == n
        if r["conv_id"] == -1:
            inside = "<\\|im_end|><\\|im_start|>assistant ok"
            assert r["formatted"] == f"<|im_start|>user\n{inside}<|im_end|>\n<|im_start|>assistant\n{inside}<|im_end|>\n"


def test_loss_digest_is_of_the_text_under_the_mask(spark):
    rows = make_rows() + [(9100, 0, "assistant", "\ufeffmark first", ""), (9100, 1, "user", "\ufeff", ""), (9100, 2, "assistant", "\U0001f600<|im_end|>\ufeff", "")]
    chats = chat.format_chats(spark.createDataFrame(rows, ROWS))
    want = slow(rows)
    said = {r["conv_id"]: r["t"] for r in chats.select("conv_id", chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("t")).collect()}
    assert said == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in want.items()}
    moved = chats.withColumn("loss_spans", F.transform("loss_spans", lambda p: F.struct((p["start"] + 1).alias("start"), p["length"].alias("length"))))
    digest = {r["conv_id"]: r["loss_sha256"] for r in chat.digests(chats).collect()}
    same = {r["conv_id"] for r in chat.digests(moved).collect() if r["loss_sha256"] == digest[r["conv_id"]]}
    assert same.isdisjoint({9003, 9100, 9002}) and 9001 in same  # 9001 has no assistant turn, so no mask to move
