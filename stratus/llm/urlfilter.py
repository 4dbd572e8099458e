"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host.

Labelled pages give outcomes (bad or not) per host.  A host's rate of bad
pages is beta-binomial: its prior is the rate of its registered domain, whose
prior is that of the suffix, whose prior is the rate of all labelled pages.
The prior's strength at each level is estimated from how much the children's
rates scatter (method of moments).  A parent's rate is that of its children,
none of which counts for more pages than the prior's strength and one, so a hot
host doesn't decide for its domain or suffix.  A host is blocked if the lower
posterior bound of its rate is above ``limit``: few or mixed outcomes never
block alone.  A host without outcomes has the bound of a new child of its
domain or suffix (no pages of its own, the children's scatter in full).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import ascii_lower, cut

# (verdict, host, path): fixed values
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


#: Suffixes of more than one label below which sites are registered; all others have one label.
SUFFIXES = [
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my",
    "com.ph", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr",
    "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
]


def host_of(url: Column) -> Column:
    """Lower-case (A-Z) host after the first ``://``; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in longest]
    made = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in longest]
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), list(zip(fits, made))[::-1], F.lit(None).cast("struct<rule:string,verdict:string>"))


def last_labels(host: Column, n: int) -> Column:
    """The last n labels of a host."""
    return F.substring_index(host, ".", -n)


def suffix_of(host: Column, suffixes: list[str] = SUFFIXES, more: int = 0) -> Column:
    """The longest of ``suffixes`` that ends the host, else its last label, with ``more`` labels before it."""
    out = last_labels(host, 1 + more)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        out = F.when(last_labels(host, n).isin([x for x in suffixes if x.count(".") + 1 == n]), last_labels(host, n + more)).otherwise(out)
    return out


def domain_of(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label."""
    return suffix_of(host, suffixes, 1)


def pooled_strength(rows: DataFrame) -> float:
    """Prior pages of ``rows(n, bad, prior)``, ``prior`` the parent's mean: solves the
    moments of the beta-binomial over all children, each by its pages; 2 to 1,000."""
    p, n = F.col("bad") / F.col("n"), F.col("n")
    spread = F.sum(n * F.pow(p - F.col("prior"), 2)) / F.sum(n)
    noise = F.sum(F.col("prior") * (1 - F.col("prior"))) / F.sum(n)
    whole = F.sum(n * F.col("prior") * (1 - F.col("prior"))) / F.sum(n)
    moments = rows.agg(spread.alias("s"), noise.alias("e"), whole.alias("v")).first()
    between = max((moments["s"] or 0.0) - (moments["e"] or 0.0), 1e-9)
    return min(max((moments["v"] or 0.0) / between - 1, 2.0), 1000.0)


def child_strength(rows: DataFrame, parent: list[str]) -> float:
    """Prior pages of ``rows(n, bad)`` below ``parent``: the same moments, each child
    counting once, about the mean of its siblings' rates; 2 to 1,000.

    Children without siblings say nothing of the scatter; with none but such
    children the strength is the least.
    """
    p = F.col("bad") / F.col("n")
    groups = rows.groupBy(*parent).agg(F.count("*").alias("k"), F.avg(p).alias("m"), F.var_samp(p).alias("v"), F.sum(1 / F.col("n")).alias("r")).filter("k > 1")
    unit = F.col("m") * (1 - F.col("m")) + F.col("v") / F.col("k")
    sums = groups.agg(F.sum(F.col("k") * F.col("v") - unit * F.col("r")).alias("between"), F.sum(unit * (F.col("k") - F.col("r"))).alias("whole")).first()
    if not sums["whole"] or sums["whole"] <= 0:
        return 2.0
    return min(max(sums["whole"] / max(sums["between"], 1e-9) - 1, 2.0), 1000.0)


def of_children(rows: DataFrame, strength: float, parent: list[str]) -> DataFrame:
    """``(n, bad)`` of each parent.  A child of n pages tells as much of its parent's
    rate as n (strength + 1) / (n + strength) pages drawn from it at large."""
    w = F.col("n") * (strength + 1) / (F.col("n") + strength)
    return rows.groupBy(*parent).agg(F.sum(w).alias("n"), F.sum(w * F.col("bad") / F.col("n")).alias("bad"))


def posterior(rows: DataFrame, strength: float) -> DataFrame:
    """``rows(n, bad, prior)`` with the posterior ``mean`` and its variance ``var``."""
    rows = rows.withColumn("mean", (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength))
    return rows.withColumn("var", F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))


def reputation(outcomes: DataFrame, z: float = 1.645, by_child: bool = False, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``outcomes(host, times, bad)`` (bad 0 or 1) -> ``(level, name, n, bad, mean, lower, lower_new)``
    with level host, domain or suffix.

    Pre-aggregated to one row per host before any other step, so a hot host
    costs no more than a rare one.  ``lower`` is the posterior mean less z
    posterior deviations.  ``lower_new`` is the same bound of a host without
    outcomes below this name: its variance is the scatter of children about
    the mean and the mean's own variance.  No outcomes give no rows.

    Parents are the pooled pages of their children, or, with ``by_child``, the
    children's rates: ``n`` and ``bad`` of domains and suffixes then count a
    child for at most its level's strength and one page.
    """
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = outcomes.groupBy("host").agg(F.sum("times").cast("double").alias("n"), F.sum(F.col("times") * F.col("bad")).cast("double").alias("bad"))
    hosts = cut(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    strength = {}

    def parents(rows: DataFrame, level: str, of: list[str], by: list[str]) -> DataFrame:
        if not by_child:
            return rows.groupBy(*by).agg(*sums)
        strength[level] = child_strength(rows, of)
        return of_children(rows, strength[level], by)

    def rated(rows: DataFrame, level: str) -> DataFrame:
        if not by_child:
            strength[level] = pooled_strength(rows)
        return posterior(rows, strength[level])

    domains = cut(parents(hosts, "host", ["domain"], ["domain", "suffix"]))
    ends = cut(parents(domains, "domain", ["suffix"], ["suffix"]))
    total = parents(ends, "suffix", [], []).first()
    top = ((total["bad"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1)
    ends = cut(rated(ends.withColumn("prior", F.lit(top)), "suffix"))
    domains = cut(rated(domains.join(ends.select("suffix", F.col("mean").alias("prior")), "suffix"), "domain"))
    hosts = rated(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), "host")

    def child(var: Column, level: str) -> Column:
        return var + (F.col("mean") * (1 - F.col("mean")) - var) / (strength[level] + 1)

    new = {"host": F.col("var"), "domain": child(F.col("var"), "host"), "suffix": child(child(F.col("var"), "domain"), "host")}
    bound = lambda var: F.col("mean") - z * F.sqrt(var)
    parts = [
        df.select(F.lit(level).alias("level"), F.col(level).alias("name"), "n", "bad", "mean", bound(F.col("var")).alias("lower"), bound(new[level]).alias("lower_new"))
        for level, df in (("host", hosts), ("domain", domains), ("suffix", ends))
    ]
    return reduce(DataFrame.unionByName, parts)


def labelled(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """``(host, times, bad)`` of the pages whose path ends in the id of a
    labelled document; bad: quality 0 or toxic 1 in any of its labels."""
    doc = F.regexp_extract(path_of(F.col(url_col)), r"/(\d{1,18})(?:\.html)?/?$", 1).try_cast("long")
    given = pages.select(host_of(F.col(url_col)).alias("host"), doc.alias("doc_id")).filter("doc_id is not null and host <> ''")
    known = labels.filter("quality in (0, 1) or toxic in (0, 1)").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    counted = given.groupBy("host", "doc_id").agg(F.count("*").alias("times"))
    return counted.join(known, "doc_id").select("host", "times", "bad")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = 0.5, id_col: str = "page_id", url_col: str = "url", suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_rate, bad_lower)``, one row per row of ``pages``.

    The longest rule that fits decides; else the host's reputation does.  A
    host without labelled pages has the rate of its registered domain, or else
    of its suffix, and is allowed unless the bound of a new host there blocks it;
    without labelled pages there it has no rate and is allowed.
    Null urls and urls without ``://`` have empty host and path.
    """
    rated = cut(reputation(labelled(pages, labels, url_col), by_child=True, suffixes=suffixes))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("__r", ruled(F.col("host"), F.col("path"), rules))
    known = rows.select("host").distinct().select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"))
    for level in ("host", "domain", "suffix"):
        lower = F.col("lower" if level == "host" else "lower_new").alias("lower")
        at = rated.filter(F.col("level") == level).select(F.col("name").alias(level), F.struct("mean", lower).alias(f"r_{level}"))
        known = known.join(at, level, "left")
    known = known.select("host", F.coalesce("r_host", "r_domain", "r_suffix").alias("r"))
    rows = rows.join(known, "host", "left")
    verdict = F.coalesce(F.col("__r.verdict"), F.when(F.col("r.lower") > limit, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), verdict.alias("verdict"), F.col("r.mean").alias("bad_rate"), F.col("r.lower").alias("bad_lower"))
