"""Main text extraction: known pages, the best region against all regions, odd rows."""

import html
import random
import re

from stratus.llm import htmltext

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Head &am</title><style>p{margin:0}</style><script>var t="</p>";track(1);</script></head>
<body class="sidebar-left"><header><h1>Site</h1></header><nav><ul><li><a href="/x>y">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now</div>
<article id="main"><h1>Title &amp; more &am</h1><p><b>One</b>two  three<br>four<p>five &quot;six&quot; &#233;&nbsp;x <i>y</i>z<aside>side note that is long enough to split a region of few words in two parts</aside>
<script>if (a < b) document.write("<p>no</p>")</script><form><label>Name</label><input type="text"></form><ul><li>item<li>next</ul><p class="notice">Cookies!</p>In.<div id="comments"><p>first!</p></div></article>
<div class="related"><p>Others read this and that and more of this and that</p></div><footer>&copy; us</footer></body></html>"""
WANT = 'Title & more &am Onetwo three four five "six" é x yz item next In.'
WEIGHTS = htmltext.Weights({"in p": (500, 0), "out p": (0, 20), "any p": (500, 20), "in h1": (50, 0), "tag p": (90, 3), "tag li": (1, 80), "any li": (0, 70), "any ": (0, 9)})


def test_known_page_whole_and_truncated():
    assert htmltext.extract(PAGE, WEIGHTS) == WANT
    assert htmltext.extract(PAGE.split("</article>")[0], WEIGHTS) == WANT
    assert htmltext.extract(PAGE, htmltext.Weights({})) == WANT


def test_odd_pages_do_not_fail():
    for page in (None, "", "<", "<p", "< p>", "</p></div>", "<!--", "<script>", "plain words only", "<p>a<p>b</p>c", "<a href='x>y'>l</a>", '<p title="unclosed>text', "<article>" * 3000 + "deep" + "</article>" * 3000, "<<<>>>", "&#x0;&#99999999;"):
        assert isinstance(htmltext.extract(page, WEIGHTS), str)
    assert htmltext.extract("<p>a&lt;b</p> <p> c\n\td </p>", WEIGHTS) == "a<b c d"
    assert htmltext.extract("<article><p>" + "w " * 50_000 + "</p></article>", WEIGHTS) == " ".join(["w"] * 50_000)


def test_region_is_the_best_of_all_regions():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<li>", "</li>", "<div>", "</div>", "one two ", "three ", "<b>", "</b>", "<ul>", "</ul>"]
    for _ in range(300):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        pieces = list(htmltext.parse(page))
        score = [len(v.split()) * WEIGHTS.word(*p, False) if k == "text" else WEIGHTS.tag(v) for k, v, p in pieces]
        best = max([0.0] + [sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)])
        whole = htmltext.extract(page, WEIGHTS)
        regions = {" ".join("".join(v if k == "text" else " " if p else "" for k, v, p in pieces[i:j]).split()) for i in range(len(score)) for j in range(i, len(score) + 1) if abs(sum(score[i:j]) - best) < 1e-9}
        assert whole in (regions if best else {""})


def test_frames(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (3, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.main_text(pages, htmltext.learn(pages)).collect()
    assert sorted(r["text"] for r in got) == ["", "", WANT, WANT] and all(len(r["text"]) == r["n_chars"] for r in got)
    assert htmltext.main_text(pages.limit(0), htmltext.learn(pages.limit(0))).count() == 0


def test_query_gives_the_articles(spark):
    from stratus.llm.queries import QUERIES

    root = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{root}/pages.parquet").collect()}
    got = QUERIES["op10_html_text"](spark, root).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"</?b>", "", article)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())


def test_class_names_alone_do_not_take_article_text():
    page = '''<article><div class="article-header"><p>Lead of the story</p></div><p class="share-price">Shares rose</p><p id="ad-hoc">T</p>
    <p class="notice">Cookies!</p><div class="comments"><p>first</p></div><p>Body</p></article><div class="sidebar-left"><p>More of this and that</p></div>'''
    for weights in (WEIGHTS, htmltext.Weights({})):
        assert htmltext.extract(page, weights) == "Lead of the story Shares rose T Body"


def test_counts_go_by_the_true_side_of_the_article():
    page = '<html><body><nav><ul><li>Menu here</li></ul></nav><div class="ad">Buy</div><article><h1>T</h1><p class="lead">one two</p><p class="notice">no</p></article><div class="foot">x y</div></body></html>'
    got = htmltext.count(page)
    assert got["any p"] == [2, 0] and got["any li"] == [0, 2] and got["any div"] == [0, 3] and got["hint lead"] == [2, 0] and got["hint <nav"] == [0, 2] and got["hint foot"] == [0, 2]
    assert got["tag html"] == [0, 2] and got["tag body"] == [0, 2] and got["tag p"][1] == 0 and got["tag h1"] == [2, 0] and got["tag li"] == [0, 2]
    assert htmltext.count("<div><p>no mark</p></div>") == {}


def test_pages_without_any_mark(spark):
    """The articles of pages whose marks, classes and structure elements are all turned into plain div elements."""
    root = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{root}/pages.parquet")
    weights = htmltext.learn(pages)
    right = neutral = total = 0
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        plain = re.sub(r"(</?)article\b", r"\1div", r["html"])
        right += htmltext.extract(plain, weights) == want
        neutral += htmltext.extract(re.sub(r'(</?)(nav|footer)\b', r"\1div", plain).replace(' class="ad"', ""), weights) == want
        total += 1
    assert right == total and neutral >= 0.96 * total, (right, neutral, total)
