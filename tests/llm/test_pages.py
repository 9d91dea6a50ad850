import math
import time

import pytest
from pyspark.sql import functions as F

from gainsay.llm import style_tree as S, url_filter as U

FRAME = ("<html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href='/'>Home {i}</a></ul></nav>"
         "<div class='cookie-notice'>We use <b>cookies</b></div><aside><p>Other {i}</p></aside><article>{body}<div class='share-box'>Share this</div>"
         "<section id='comments'><p>first! {i}</p></section></article><form><label>Mail</label><input></form><footer>&copy; {i}</footer></body></html>")
SCHEMA = "page_id long, url string, html string"


def test_article_without_furniture(spark):
    body = "<h1>A &amp; B</h1><p>one\n  <b>two</b><br>three<p>four<ul><li>x<li>y</ul>"
    rows = [(i, f"http://h.example/{i}", FRAME.format(i=i, body=body + f"<p>{i}</p>")) for i in range(12)]
    rows += [(12, "http://h.example/n", None), (13, None, ""), (14, "x", "plain text"), (0, "http://h.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = S.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert all(texts[i] == f"A & B\n\none two three\n\nfour\n\nx\n\ny\n\n{i}" for i in range(12))
    assert (texts[12], texts[13], texts[14]) == ("", "", "plain text")
    assert S.extract(pages.limit(0)).collect() == []


def test_repeated_branches_of_a_site_go_by_entropy(spark):
    page = "<body><div class=top>Same on every page</div><div class=body><p>{a}</p><p>{b}</p></div><div class=end>Also the same</div></body>"
    rows = [(i, "http://s.example/x", page.format(a=f"text {i}", b=f"more {i * i}")) for i in range(20)]
    rows += [(100, "http://other.example/", page.format(a="lone", b="page"))]
    pages = spark.createDataFrame(rows, SCHEMA)
    texts = {r.page_id: r.text for r in S.extract(pages).collect()}
    assert all(texts[i] == f"text {i}\n\nmore {i * i}" for i in range(20))
    assert texts[100] == "Same on every page\n\nlone\n\npage\n\nAlso the same"        # one page can't tell
    seen = {r.path.rpartition("/")[2]: r for r in S.importance(pages).where("host = 's.example'").collect()}
    assert seen["div.top"].content == pytest.approx(0) and seen["p"].content == pytest.approx(1) and seen["p"].pages == 20


def test_copies_of_pages_do_not_make_an_article_repeat(spark):
    page = "<body><div class=top>Same on every page</div><div class=body><p>{a}</p></div><footer>{n}</footer></body>"
    rows = [(i, f"http://m.example/?{i}", page.format(a="mirrored" if i >= 10 else f"text {i}", n=i)) for i in range(100)]
    texts = {r.page_id: r.text for r in S.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert texts == {i: "mirrored" if i >= 10 else f"text {i}" for i in range(100)}
    few = [(i, "http://f.example/", page.format(a="lone", n="")) for i in range(20)]
    assert {r.text for r in S.extract(spark.createDataFrame(few, SCHEMA)).collect()} == {"Same on every page\n\nlone"}     # one page can't tell


@pytest.mark.parametrize("page, want", [
    ("<article><p>cut off <b>here", ["cut off here"]), ("<article><p>a &lt;b&gt; &#233;&nbsp;x</p><p", ["a <b> é x"]), ("<article><p>a<!-- <p>no", ["a"]),
    ("<article><p>1 < 2 & 3</p></article>", ["1 < 2 & 3"]), ("<article><script>if(a<b){}</script><p>x</p>", ["x"]), ("", []), ("<p></p>", []),
    ("<article><p title='a>b'>x</p><p title=\"q>y</p></article>", ["x", "y"]), ("<main><header><h1>T</h1></header><div>d<p>p</div>e</main>out", ["T", "d", "p", "e"]),
    ("<article><p>see <span class=ad>buy <span>now</span></span>this</p></article>", ["see", "this"]), ("<article>" + "<div>" * 3000 + "deep", ["deep"]),
])
def test_markup(page, want):
    assert S.kept(S.parsed(page)[0], set()) == want


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "deep", "<article><x>" + "<y><li>t</li>" * 60_000, "<span>" * 100_000 + "</b>" * 100_000 + "deep"])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    assert S.kept(S.parsed(page)[0], set())[-1] in ("deep", "t")
    assert time.process_time() - began < 8         # a square of the depth would take minutes


def test_importance_by_brute_force(spark):
    """Entropies of a small site, counted anew from its distinct pages."""
    site = [(f"<body><div class=a>{i % 3}</div><div class=b><p>{i}</p>{'<p>x</p>' * (i % 2)}</div><div class=c>same</div></body>") for i in range(9)]
    rows = [(i, "http://b.example/", p) for i, p in enumerate(site + site[:4])]

    def entropy(values):
        if len(values) < 2:
            return 0.0
        counts = [values.count(v) for v in set(values)]
        return (math.log(len(values)) - sum(c * math.log(c) for c in counts) / len(values)) / math.log(len(values))

    got = {r.path.rpartition("/")[2]: r for r in S.importance(spark.createDataFrame(rows, SCHEMA)).collect()}
    below = ["div.a,div.b,div.c"] * 9
    want = {"div.a": ([str(i % 3) for i in range(9)], below), "div.c": (["same"] * 9, below),
            "p": ([f"{i}" + "\nx" * (i % 2) for i in range(9)], ["p" + ",p" * (i % 2) for i in range(9)])}
    assert set(got) == set(want)
    for name, (texts, styles) in want.items():
        assert got[name].pages == 9 and got[name].content == pytest.approx(entropy(texts)) and got[name].presentation == pytest.approx(entropy(styles))
        assert got[name].importance == pytest.approx(0.8 * entropy(texts) + 0.2 * entropy(styles))


@pytest.mark.parametrize("page, want", [
    ("<div>body<p>text</div><ol class=comment-list><li><article class='comment-body'>me too</article></ol>", ["body", "text"]),
    ("<div>body</div><article class='comment-body'>me too</article>", ["body"]), ("<div>body</div><aside><article>teaser</article></aside>", ["body"]),
    ("<body><form id=aspnetForm action=/><nav>Home</nav><div><p>the text</p></div></form><footer>f</footer>", ["the text"]),
    ("<form><input><article>the text</article></form><div>out</div>", ["the text"]), ("<div>the long text</div><form>Mail</form>", ["the long text"]),
    ("<form class=search-form>Find things here</form><p>x", ["x"]), ("<article>x</article><form>Mail, and a long explanation</form>", ["x"]),
    ("<html class='no-js ad'><body class='single comments-open'><p>x", ["x"]), ("<article class='post single comments-open'>x</article>", ["x"]),
    ("<main class=search><article id=post class='category-search ad'>x</article></main>", ["x"]),
    ("<html><head><title>t</title><meta charset=utf-8><body><p>x", ["x"]), ("<head><link rel=a><style>p{}</style><p>x<p>y", ["x", "y"]),
    ("<head><title>t</title>bare", ["bare"]), ("<head><title>t</title>bare <a href=/>link</a>", ["bare link"]),
])
def test_furniture_never_swallows_the_page(page, want):
    assert S.kept(S.parsed(page)[0], set()) == want


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
URLS = {
    "HTTP://Example.NET/en/x?q": ("example.net", "/en/x", "example.net/en/", "allow"), "http://a.example.net/EN/": ("a.example.net", "/EN/", "net/", "block"),
    "http://x.net": ("x.net", "", None, "allow"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "ftp://m.example.com/de/a#b": ("m.example.com", "/de/a", "example.com/de/", "block"), "http://org/fr/1": ("org", "/fr/1", "org/fr/", "allow"),
    "http://bad.io/a/": ("bad.io", "/a/", None, "block"), "http://www.bad.io/a?x": ("www.bad.io", "/a", None, "block"), "http://bad.io/b": ("bad.io", "/b", None, "allow"),
    "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "http://Ünï.example.net/en/é?": ("Ünï.example.net", "/en/é", "example.net/en/", "allow"),
}


@pytest.mark.parametrize("limit", [U.BROADCAST_BYTES, 0])
def test_url_verdicts(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
    rows = list(enumerate(URLS)) + [(0, next(iter(URLS)))]
    urls = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit("clash")).withColumn("host", F.lit(0))
    listed = spark.createDataFrame([("bad.io/a",), ("bad.io/a",), (None,), ("",)] + [(f"l{i}.io",) for i in range(500)], "key string")
    got = U.judged(urls, listed, RULES).collect()
    assert len(got) == len(rows)
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: URLS[u] for i, u in rows}
    assert U.judged(urls.limit(0), listed, RULES).collect() == []
    none = U.judged(urls, listed.limit(0), ()).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(rows)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    blocks = -(-5000 * U.BITS_PER_URL // 256)
    filled = U.bloom(keys, blocks)
    probe = spark.range(20000).selectExpr("concat('k', id) AS key", "id < 5000 AS member").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    hit = F.lit(True)
    for i, m in enumerate(U.masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    got = {r.member: r.n for r in probe.join(filled, "block", "left").where(hit).groupBy("member").agg(F.count("*").alias("n")).collect()}
    assert got[True] == 5000 and got.get(False, 0) < 600
