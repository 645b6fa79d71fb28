"""Main text of pages and url filters."""

import html
import re
import time

import numpy as np
import pytest

from chronolith.llm import html_extract, queries, url_filter


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_labeller_on_pages_it_wasn_t_trained_on(model):
    maker = html_extract.PageMaker(1234)
    wrong = total = 0
    for _ in range(120):
        x, y = html_extract.labelled_page(maker.page())
        if len(y):
            wrong += int((model.labels([x])[0] != (y > 0)).sum())
            total += len(y)
    assert wrong / total < 0.02


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    m = html_extract.BlockLabeller({k: v.astype(np.float64) for k, v in html_extract.BlockLabeller.fresh().params.items()})
    x, mask = r.normal(0, 0.5, (2, 5, html_extract.DIMS)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], float)
    y = r.integers(0, 2, (2, 5)).astype(float)
    _, g = m.gradients(x, mask, y)
    for name in ("uf", "ub", "wf", "cb", "out", "bias"):
        v = m.params[name].reshape(-1)
        k = int(r.integers(len(v)))
        old = v[k]
        v[k] = old + 1e-4
        up = m.gradients(x, mask, y)[0]
        v[k] = old - 1e-4
        down = m.gradients(x, mask, y)[0]
        v[k] = old
        assert abs((up - down) / 2e-4 - g[name].reshape(-1)[k]) < 2e-3 * max(1, abs(g[name].reshape(-1)[k])) + 1e-4


def test_blocks():
    page = "<html><head><title>t</title></head><body><p>a &lt;b<b>c</b>d<br>e<p>f<ul><li>g<li>h</ul><script>x</script><!-- y -->&nbsp;z"
    assert [t for _, t, _ in html_extract.blocks_of(page)] == ["a <bcd e", "f", "g", "h", "z"]
    assert html_extract.blocks_of("") == [] and [t for _, t, _ in html_extract.blocks_of("no markup < here")] == ["no markup < here"]


@pytest.mark.parametrize(
    "head",
    [
        "<head><title>t</title></head><body>",
        "<head><title>t</title><body>",
        "<HEAD lang=en>\n<meta charset=utf-8><title>t <b> u</title><!-- <p>c --><script>'<body><p>s'</script><link rel=x>",
        "<head><title>t<body>",
        "<head><style>p {}</head><body>",
        "<head><noscript><div>n</div></noscript><title>t</title></head>",
        "<head>",
        "",
    ],
)
def test_heads_end_with_or_without_an_end_tag(head):
    page = f"<!doctype html><html>{head}<header>a</header><p>b <code>x</code><p>c</head>d"
    assert [t for _, t, _ in html_extract.blocks_of(page)] == ["a", "b x", "c", "d"]


@pytest.mark.parametrize("piece", ["<div>", "<a ", "<link ", '<p class="x>', "<p a='\"x", "<!--", "<svg>x", "<li><ul>", "<", "</p>", "<b>x", "<head>"])
def test_pages_of_a_megabyte_take_linear_time(piece):
    began = time.time()
    html_extract.blocks_of(piece * ((1 << 20) // len(piece)))
    assert time.time() - began < 5


def test_unbalanced_quotes_end_with_their_tag():
    texts = lambda page: [t for _, t, _ in html_extract.blocks_of(page)]
    assert texts('<p class="x>The text</p><p>more</p>') == ["The text", "more"]
    assert texts("<p class='x>The text <a href='y'>z</a></p>after") == ["The text z", "after"]
    assert texts('<p title="a > b" data-h="<b>q</b>">more') == ["more"]
    assert texts('<p>whole<p class="cut') == ["whole"]


def test_deep_and_long_pages(model):
    deep = html_extract.blocks_of("<div>" * 20_000 + "x" + "</div>y" * 20_000)
    assert len(deep) == 20_001 and deep[0][0].depth == 20_000
    maker = html_extract.PageMaker(99)
    long = [b for _ in range(30) for b in html_extract.labelled_page(maker.page())[0]]
    assert (model.long_page(long, 37) == model.labels([long])[0]).all()


def test_main_text_of_the_pages(spark, small):
    got = {r.page_id: r for r in queries.op2_html_extract(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|h2|br)>", " ", article))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_pages_with_nothing(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (3, "u", "<nav><a>x</a></nav>", "x"), (4, "u", "<" * 3000, "x"), (5, "u", "<div>" * 3000, "x")], "page_id long, url string, html string, text string")  # an extra column of the output's name
    got = html_extract.extract_main_text(df).collect()
    assert len(got) == 6 and all(r.text == "" for r in got if r.page_id in (1, 2, 3))
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_links_of_long_and_odd_pages(spark):
    long = [p * (120_000 // len(p)) for p in ("<link ", "<meta a='", "<!--", "<script>", '<link rel="canonical" href="')]
    odd = [
        ("<!-- <link rel=canonical href=/no> --><link rel='nofollow Canonical' href='/a&amp;b'>", "http://h.com/a&b"),
        ("<script>'<link rel=canonical href=/no>'</script><link data-x='a>b' href=../c rel=canonical>", "http://h.com/p/../c"),
        ("<meta http-equiv=refresh content=\"5; url='?q=1'\">", "http://h.com/p/q?q=1"),
        ("<meta content='0;URL=//i.org/z' http-equiv=Refresh>", "http://i.org/z"),
        ("<link relx=canonical href=/no><link rel=canonicals href=/no><meta name=refresh content='0;url=/no'>", None),
    ]
    rows = [(f"http://l.com/{k}", h) for k, h in enumerate(long)] + [("http://h.com/p/q", h) for h, _ in odd]
    began = time.time()
    got = [tuple(r) for r in url_filter.alias_edges(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert time.time() - began < 20
    assert got == [("http://h.com/p/q", v) for _, v in odd if v]


def test_rules_and_aliases(spark):
    canonical = lambda u: f"<head><LINK href='{u}' rel=canonical></head>"
    pages = [
        (1, "http://A.Example.org/es/1?x#y", None), (2, "https://notexample.org/es/", None), (3, "http://b.com/de/1", ""), (4, "http://c.net/z", canonical("http://b.com/de/1")),
        (5, "http://d.net/a/b", "<meta http-equiv=\"refresh\" content=\"0; URL=/c\">"), (6, "http://d.net/c", canonical("HTTP://C.net/z#frag")), (7, None, None), (8, "no scheme", None), (9, "http://x.com", None), (9, "http://x.com", None),
        (10, "http://e.net/", canonical("http://b.com/fr/2")), (11, "http://f.com/fr/9", canonical("http://b.com/de/1")), (12, "http://g.net/", canonical("http://x.com")),
    ]
    df = spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, verdict string")
    got = {r.page_id: r for r in url_filter.url_verdicts(df, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("org/", "allow") and got[3].verdict == "block"
    assert (got[7].host, got[7].path, got[8].host, got[9].path) == ("", "", "", "")
    # 3, 4, 5, 6 and 11 are aliases: 3 is blocked, but 11 is allowed by its own rule, which wins for those without one
    assert [got[i].verdict for i in (4, 5, 6, 11)] == ["allow"] * 4 and got[10].verdict == "allow" and got[12].verdict == "allow"
    without = url_filter.url_verdicts(df.where("page_id <> 11"), rules)
    assert {r.page_id: r.verdict for r in without.collect() if r.page_id in (3, 4, 5, 6)} == {3: "block", 4: "block", 5: "block", 6: "block"}
    more = spark.createDataFrame([("http://g.net/", "http://b.com/de/1")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_filter.url_verdicts(df.where("page_id <> 11"), rules, more).collect()}[12] == "block"
    assert url_filter.url_verdicts(df, rules).count() == len(pages) and url_filter.url_verdicts(df.limit(0), rules).count() == 0
