"""URL rules against a plain loop; reputation against beta-binomial arithmetic in Python."""

import math
import re

import pytest

from stratus.llm import urlfilter

PAGES = "page_id long, url string, html string, host string"
URLS = [
    "https://www.Example.com/en/1", "http://example.com/en/7.html", "http://a.example.com/en", "http://example.com/fr/3", "http://x.net/es/4?x=1", "http://net/fr/", "http://x.net/en/5#top",
    "http://notexample.com/en/9", "http://x.org/", "no scheme", None, "", "://", "http://", "http://host", "http://host.com", "http://HOST.com?q=/en/", "ftp://u:p@h.net:80/fr/../x", "a://b://c/en/",
    "http://ÉX.com/en/", "http://x.com\n/y", "http://.com/", "http://www.example.com/en/?a#b", "http://com/x", "http://sub.www.example.com/en/2/", "x" * 9000 + "://y.net/es/",
]


def slow(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_hosts_paths_and_rules(spark):
    pages = [(i, u, "x", "clash") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)] * 2
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urlfilter.judge(spark.createDataFrame(pages, PAGES), none).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = slow(URLS[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urlfilter.judge(spark.createDataFrame([], PAGES), none).count() == 0


def test_reputation_matches_plain_arithmetic(spark):
    rows = [("a.x.org", 30, 1), ("a.x.org", 2, 0), ("b.x.org", 1, 1), ("c.y.org", 20, 0), ("c.y.org", 1, 1), ("d.z.net", 5, 0), ("lone", 3, 1)]
    got = {(r["level"], r["name"]): r for r in urlfilter.reputation(spark.createDataFrame(rows, "host string, times long, bad int")).collect()}
    up = {"host": lambda h: ".".join(h.split(".")[-2:]), "domain": lambda h: h.split(".")[-1], "suffix": lambda h: "all"}

    def sums(f):
        out = {}
        for h, t, b in rows:
            n, bad = out.get(f(h), (0, 0))
            out[f(h)] = (n + t, bad + t * b)
        return out

    total = sum(t for _, t, _ in rows)
    prior = {"all": (sum(t * b for _, t, b in rows) + 0.5) / (total + 1)}
    for level, f in (("suffix", up["domain"]), ("domain", up["host"]), ("host", lambda h: h)):
        at = sums(f)
        p0 = {k: prior[up[level](k)] for k in at}
        s = sum(n * (b / n - p0[k]) ** 2 for k, (n, b) in at.items()) / total
        e = sum(p0[k] * (1 - p0[k]) for k in at) / total
        v = sum(n * p0[k] * (1 - p0[k]) for k, (n, b) in at.items()) / total
        m = min(max(v / max(s - e, 1e-9) - 1, 2.0), 1000.0)
        prior = {k: (b + m * p0[k]) / (n + m) for k, (n, b) in at.items()}
        for k, (n, _) in at.items():
            assert got[level, k]["mean"] == pytest.approx(prior[k])
            assert got[level, k]["lower"] == pytest.approx(prior[k] - 1.645 * math.sqrt(prior[k] * (1 - prior[k]) / (n + m + 1)))


def test_bad_hosts_are_blocked_and_few_outcomes_are_not(spark):
    pages = [(i, f"http://spam.bad.org/de/{i}", "", "") for i in range(60)] + [(100 + i, f"http://good.fine.org/de/{100 + i}.html", "", "") for i in range(60)] + [(300, "http://new.fine.org/de/300/", "", "")]
    labels = [(i, 0, 0) for i in range(50)] + [(100 + i, 1, 0) for i in range(50)] + [(300, 0, 0), (300, None, None), (None, 0, 1)]
    got = urlfilter.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["host"], r["verdict"]) for r in got} == {("spam.bad.org", "block"), ("good.fine.org", "allow"), ("new.fine.org", "allow")}
    assert all(r["rule"] is None for r in got)


def test_a_hot_host_decides_neither_for_its_suffix_nor_for_new_hosts(spark):
    # .org: one host of 10,000 pages (95 % bad), 50 clean domains of 20 pages (5 % bad); .com clean
    rows = [("hot.bad.org", 9500, 1), ("hot.bad.org", 500, 0)]
    for i in range(50):
        rows += [(f"www.fine{i}.org", 1, 1), (f"www.fine{i}.org", 19, 0), (f"www.fine{i}.com", 20, 0)]
    outcomes = spark.createDataFrame(rows, "host string, times long, bad int")
    got = {(r["level"], r["name"]): r for r in urlfilter.reputation(outcomes, by_child=True).collect()}
    assert got["suffix", "org"]["mean"] < 0.15 and got["suffix", "org"]["lower_new"] < 0.5
    assert got["host", "hot.bad.org"]["lower"] > 0.9 and got["host", "www.fine3.org"]["mean"] < 0.15

    pages, labels = [], []
    for host, times, bad in [("hot.bad.org", 950, 1), ("hot.bad.org", 50, 0)] + rows[2:]:
        for _ in range(times):
            pages.append((len(pages), f"http://{host}/de/{len(pages)}", "", ""))
            labels.append((len(labels), 1 - bad, 0))
    pages.append((len(pages), "http://www.new.org/de/", "", ""))
    judged = urlfilter.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    verdicts = {r["host"]: r["verdict"] for r in judged.collect()}
    assert verdicts["www.new.org"] == "allow" and verdicts["www.fine3.org"] == "allow" and verdicts["hot.bad.org"] == "block"


def test_parents_of_child_rates_match_plain_arithmetic(spark):
    rows = [("a.x.org", 30, 1), ("a.x.org", 2, 0), ("b.x.org", 1, 1), ("e.x.org", 9, 0), ("c.y.org", 20, 0), ("c.y.org", 1, 1), ("f.y.org", 3, 0), ("d.z.net", 5, 0), ("lone", 3, 1)]
    got = {(r["level"], r["name"]): r for r in urlfilter.reputation(spark.createDataFrame(rows, "host string, times long, bad int"), by_child=True).collect()}
    up = {"host": lambda h: ".".join(h.split(".")[-2:]), "domain": lambda h: h.split(".")[-1], "suffix": lambda h: "all"}
    at = {"host": {}}
    for h, t, b in rows:
        n, bad = at["host"].get(h, (0, 0))
        at["host"][h] = (n + t, bad + t * b)
    strength = {}
    for level, above in (("host", "domain"), ("domain", "suffix"), ("suffix", "all")):
        groups = {}
        for k, (n, b) in at[level].items():
            groups.setdefault(up[level](k), []).append((n, b / n))
        between = whole = 0
        for g in (g for g in groups.values() if len(g) > 1):
            k, m = len(g), sum(p for _, p in g) / len(g)
            v = sum((p - m) ** 2 for _, p in g) / (k - 1)
            unit = m * (1 - m) + v / k
            between += k * v - unit * sum(1 / n for n, _ in g)
            whole += unit * (k - sum(1 / n for n, _ in g))
        s = strength[level] = min(max(whole / max(between, 1e-9) - 1, 2), 1000) if whole > 0 else 2
        at[above] = {k: (sum(n * (s + 1) / (n + s) for n, _ in g), sum(n * (s + 1) / (n + s) * p for n, p in g)) for k, g in groups.items()}
    n, b = at["all"]["all"]
    prior = {"all": (b + 0.5) / (n + 1)}
    below = {"host": [], "domain": ["host"], "suffix": ["domain", "host"]}
    for level in ("suffix", "domain", "host"):
        prior = {k: (b + strength[level] * prior[up[level](k)]) / (n + strength[level]) for k, (n, b) in at[level].items()}
        for k, (n, _) in at[level].items():
            r, m = got[level, k], prior[k]
            var = m * (1 - m) / (n + strength[level] + 1)
            assert r["mean"] == pytest.approx(m) and r["lower"] == pytest.approx(m - 1.645 * math.sqrt(var))
            for x in below[level]:
                var += (m * (1 - m) - var) / (strength[x] + 1)
            assert r["lower_new"] == pytest.approx(m - 1.645 * math.sqrt(var))


def test_sites_under_a_two_label_suffix_stay_apart(spark):
    hosts = spark.createDataFrame([("www.a.co.uk",), ("b.co.uk",), ("co.uk",), ("uk",), ("x.y.org",), ("",)], "host string")
    got = [tuple(r) for r in hosts.select(urlfilter.domain_of("host"), urlfilter.suffix_of("host")).collect()]
    assert got == [("a.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("y.org", "org"), ("", "")]
    assert hosts.select(urlfilter.domain_of("host", ["y.org"])).collect()[4][0] == "x.y.org"
