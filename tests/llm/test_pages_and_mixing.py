import random
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import pytest
from pyspark.sql import functions as F

from weftline.llm import host_paths as H
from weftline.llm import mixing as M

ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph, with <i>some</i>thing.<p>Second<br>\n line<ul><li>one<li>two</ul><div class='ad-box'>Buy</div><pre>a\n b</pre>tail"
WANT = "Title & more\n\nFirst paragraph, with something.\n\nSecond line\n\none\n\ntwo\n\na b\n\ntail"
FRAME = (
    "<!DOCTYPE html><html class='cookie'><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body class='has-sidebar'><div id='cookie-notice'>We use cookies</div>"
    "<div class='site-header'>Hi</div><nav><ul><li><a>n</a></ul></nav><!-- c <p>no</p> --><div class='wrap'><div class='sidebar'>side, stuff, here, and, more, of, it, {pad}</div>"
    "<div class='content post-{n}'>{article}<form>Name <input></form><ul><li><a href='/'>m1</a><li><a>m2</a><li><a>m3</a></ul><div class='comments'><p>Reader said, a, lot, of, things {pad}</p></div></div></div><footer>&copy;</footer>"
)


def test_article_only():
    p = H.Page(FRAME.format(n=1, article=ARTICLE, pad="x " * 200))
    assert p.text(p.best()) == WANT


def test_a_page_within_one_form_or_class():
    assert H.Page("<body><form><div class='main'><h1>H</h1><p>Text here.</p></div></form>").text(None) == "H\n\nText here."
    assert H.Page("<body><div class='widget'><article><p>Text here.</p></article></div><nav>n</nav>").text(None) == "Text here."
    assert H.Page("<body><div class='cookie-notice'><p>We use cookies.</p></div><nav>n</nav>").text(None) == ""
    assert H.Page("<body><form>Name</form><nav>n</nav><p>Text.</p>").text(None) == "Text."


@pytest.mark.parametrize(
    ("attributes", "out"),
    [
        ("class='topnav'", True), ("class='ad2'", True), ("id='disqus_thread'", True), ("class='readerComments'", True), ("class=cookieBar", True), ("role='navigation'", True),
        ("class='site-footer dark'", True), ("aria-hidden='true'", True), ("style='display: none'", True), ("class='post-body'", False), ("class='commentary'", False),
        ("class='adventure'", False), ("id='main-content'", False), ("class='shadow header-less'", False), ("data-x='nav'", False), ("class='headline'", False),
        ("id='related-work'", False), ("class='alert-study'", False), ("class='search-results-method'", False), ("class='related-posts'", True), ("id='post-comments'", True),
        ("class='cookie-notice-wrapper'", True), ("class='newsletter-signup'", True), ("class='advertisement'", True), ("class='sidebar-left'", True),
    ],
)
def test_left_out_elements(attributes, out):
    assert H._left_out("div", " " + attributes)[0] == out


def test_host_path_wins_over_the_page(spark):
    normal = [(i, "http://Host.example/a", FRAME.format(n=i, article=ARTICLE, pad="")) for i in range(6)]
    odd = FRAME.format(n=9, article="<p>Short, text.</p>", pad="").replace("<footer>", "<div class='legal'><p>" + "Terms, long. " * 60 + "</p></div><footer>")
    rows = normal + [(6, "http://host.example/b?x", odd), (7, None, ARTICLE), (8, "no host", None), (9, "http://other.example", ""), (9, "http://other.example", ""), (None, "http://host.example", ARTICLE)]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, path string, host string")
    got = H.main_text(d).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].text == WANT and by[i].n_chars == len(WANT) for i in range(6))
    assert by[6].text == "Short, text." and by[6].url == "http://host.example/b?x"
    assert by[8].text == by[9].text == "" and by[9].n_chars == 0
    assert by[7].text.startswith("Title & more\n\nFirst") and by[None].text.startswith("Title & more")
    assert H.main_text(d.limit(0)).count() == 0


def test_broken_markup():
    for t in ("<", "<p", "</p></div>", "<div class='x>text</div>", "<table><tr><td>a<td>b<tr><td>c", "<a><b></a>t</b>", "<script>never closed", "<!-- open", "text & &amp; &#x41; &bogus;"):
        H.Page(t).text(None)
    assert H.Page("<table><tr><td>a<td>b<tr><td>c").text(None) == "a\n\nb\n\nc"


@pytest.mark.parametrize("seed", range(12))
def test_period_is_fair(seed):
    rng = random.Random(seed)
    w = {f"s{i}": rng.choice([1, 2, 3, 5, 10, 0.5, 7.3]) for i in range(rng.randint(1, 25))}
    share = M.shares(w, rng.choice([60, 100, 997]))
    own = M.one_period(share)
    order = {t: s for s, v in own.items() for t in v}
    assert sorted(order) == list(range(sum(share.values())))
    assert brute.deviation([order[t] for t in sorted(order)], share) < 1


def test_mix(docs_of, spark):
    rng = random.Random(3)
    rows = [(i, "t", rng.choice(["big"] * 5 + ["mid", "mid", "low", None])) for i in range(700)]
    weights = {"big": 1.0, "mid": 2.0, "low": 1.0, None: 0.5}
    got = M.mix(docs_of(rows), weights, block=4, period=60).orderBy("__position").collect()
    assert [r["__position"] for r in got] == list(range(700)) and {r.doc_id for r in got} == set(range(700))
    slots = defaultdict(list)
    for r in got:
        slots[r["__slot"]].append(r)
        assert r["__release"] <= r["__slot"] < r["__due"]
    assert sorted(slots) == list(range(len(slots))) and all(len({r.source for r in s}) == 1 and len(s) <= 4 for s in slots.values())
    phases = defaultdict(list)
    for t in sorted(slots):
        phases[slots[t][0]["__phase"]].append(slots[t][0].source)
    left = Counter({s: -(-n // 4) for s, n in Counter(r[2] for r in rows).items()})
    for p in sorted(phases):
        share = M.shares({str(s): weights[s] for s in left if left[s] > 0}, 60)
        assert brute.deviation(list(map(str, phases[p])), {s: Fraction(a) for s, a in share.items()}) < 1
        left -= Counter(phases[p])
    assert not +left


def test_mix_odd_rows(clashing, odd_rows, docs_of):
    got = M.mix(clashing, {"s": 1.0}).collect()
    assert sorted(r["__position"] for r in got) == list(range(len(odd_rows)))
    assert M.mix(docs_of([])).count() == 0
    named = clashing
    for c in ("__s", "__h", "__cell", "__rank", "__block", "__own", "__source", "__hash", "__position", "s", "c", "before", "first", "start", "phase"):
        named = named.withColumn(c, F.lit("x"))
    again = M.mix(named, {"s": 1.0})
    assert len(set(again.columns)) == len(again.columns) and again.where("__s = 'x' and __hash = 'x' and first = 'x'").count() == len(odd_rows)
    assert sorted(r["__position"] for r in again.collect()) == list(range(len(odd_rows)))
    with pytest.raises(ValueError):
        M.mix(clashing, {"s": 0.0})
    ordered = M.in_order(M.mix(docs_of([(i, "t", f"s{i % 3}") for i in range(50)]), block=2), 50, 4)
    assert [r["__position"] for r in ordered.collect()] == list(range(50))


@pytest.mark.parametrize(
    "weights",
    [
        {f"s{i}": 4.0 if i == 0 else 2.0 if i < 5 else 1.0 for i in range(20)},
        {"rare": 1.0, "a": 4000.0, "b": 1000.5},
        {"x": 3.141592653589793, "y": 0.1234567890123, "z": Fraction(1, 3)},
    ],
)
def test_deviation_from_the_given_weights(docs_of, weights):
    total = sum(Fraction(str(w)) for w in weights.values())
    n = {s: int(Fraction(str(w)) / total * 4000) + 1 for s, w in weights.items()}
    got = M.mix(docs_of([(len(s) * 10**6 + i, "t", s) for s in n for i in range(n[s])]), weights, block=1).orderBy("__slot").collect()
    assert [r["__slot"] for r in got] == list(range(sum(n.values())))
    first = [r for r in got if r["__phase"] == 0]
    assert len(first) > 3900
    assert brute.deviation([r.source for r in first], {s: Fraction(str(w)) for s, w in weights.items()}) < 1
    for r in first:
        w = Fraction(str(weights[r.source])) / total
        assert r["__release"] == int(r["__block"] / w) <= r["__slot"] < r["__due"] == -int(-(r["__block"] + 1) / w // 1)


@pytest.mark.parametrize("outer", ["article", "main"])
def test_an_article_around_its_lead_and_body(spark, outer):
    body = "Long text, with commas, of a body. " * 20
    page = f"<body><div class='wrap'><{outer}><h1>Title</h1><div class='lead'><p>Lead in.</p></div><div class='body'><p>{body}</p></div><p>Closing.</p></{outer}><div class='legal'>Terms.</div></div></body>"
    d = spark.createDataFrame([(i, "http://h.example/a", page) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in H.main_text(d).collect()} == {f"Title\n\nLead in.\n\n{body.strip()}\n\nClosing."}
    links = "<div class='more'>" + "<p><a href='/'>Another story of the day</a></p>" * 2 + "</div>"
    p = H.Page(page.replace("<p>Closing.</p>", links * 3) if outer == "main" else page)
    assert ("Another" in p.text(p.best())) is False


def _page(body):
    return f"<html><body><nav><a href='/'>Home</a></nav>{body}<footer>&copy;</footer></body></html>"


def test_the_whole_article_is_kept():
    links = "<ul><li><a href='a'>Ref one</a><li><a href='b'>Ref two</a><li><a href='c'>Ref three</a></ul>"
    parts = "<section id='related-work'><p>Earlier work.</p></section><div class='alert-study'><p>A study.</p></div><div class='search-results-method'><p>How.</p></div>"
    page = _page(f"<article><header><h1>Title</h1></header><p>Lead, in.</p>{parts}<h2>Sources</h2>{links}<div class='comments'><p>First!</p></div></article>")
    want = "Title\n\nLead, in.\n\nEarlier work.\n\nA study.\n\nHow.\n\nSources\n\nRef one\n\nRef two\n\nRef three"
    p = H.Page(page)
    assert p.text(p.best()) == p.text(p.best(), []) == want


def test_lists_of_links_by_consensus(spark):
    menu = "<ul><li><a>Home page</a><li><a>All news</a><li><a>About us</a></ul>"
    own = lambda i: f"<ul><li><a>Source {i}a</a><li><a>Source {i}b</a><li><a>Source {i}c</a></ul>"
    page = lambda i: _page(f"<div class='content'><h1>Title {i}</h1><p>Some text, of page {i}.</p>{own(i)}{menu}</div>")
    d = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(5)] + [(9, "http://few.example/", page(9))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.main_text(d).collect()}
    assert all(got[i] == f"Title {i}\n\nSome text, of page {i}.\n\nSource {i}a\n\nSource {i}b\n\nSource {i}c" for i in range(5))
    assert got[9] == "Title 9\n\nSome text, of page 9."


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50_000 + "text" + "</div>" * 50_000, "<a " * 330_000, '<a "' * 250_000, "<a '><a \">" * 100_000, "<script " * 120_000, "<b>" * 100_000 + "<hr>" * 50_000,
     "<div>" * 20_000 + "</span>" * 100_000, "<!--" * 200_000, "<ul><li>" * 50_000, "<table><tr><td>" * 20_000, "<p>" * 200_000],
    ids=lambda x: x[:8],
)
def test_long_deep_and_broken_pages_are_linear(page):
    import time

    t = time.process_time()
    p = H.Page(page)
    p.votes()
    p.text(p.best())
    assert time.process_time() - t < 20  # a square of such sizes would be hours


def brute_text(page):
    """The article element of the given pages, which know no frame but nav, ad and
    footer: cut at its tags of blocks."""
    import html as entities
    import re

    inner = "".join(re.findall(r"(?s)<article>(.*?)</article>", page))
    pieces = re.split(r"</?(?:p|h1|h2|ul|ol|li|div)\b[^>]*>", inner.replace("<br>", " "))
    plain = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in pieces)
    return "\n\n".join(x for x in plain if x)


def test_given_pages_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: brute_text(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert len(got) > 100 or len(got) == len(want)
    assert got == want
