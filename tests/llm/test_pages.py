"""The style trees against brute force and the articles that the pages were made of; hostile and odd pages."""

import html
import math
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.llm import pages, queries

DATA = "/root/testdata/sf0.01"


def _frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _extracted(spark, bodies, **how):
    rows = [(k, f"https://h.example/{k}", f"<body>{b}</body>") for k, b in enumerate(bodies)]
    return [r["text"] for r in sorted(pages.extract(_frame(spark, rows), **how).collect(), key=lambda r: r["page_id"])]


def _articles():
    """Each page's article by cutting its source at the marks."""
    out = {}
    for page_id, source in duckdb.sql(f"select page_id, html from '{DATA}/pages.parquet'").fetchall():
        inner = source[source.index("<article>") + 9 :].split("</article>")[0]
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        out[page_id] = "\n\n".join(x for x in texts if x)
    return out


def test_all_articles_come_whole_without_any_class_word(spark):
    want, df = _articles(), spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in queries.op10_html_extract(spark, DATA).collect()}
    assert got == want
    assert {r["page_id"]: r["text"] for r in pages.extract(df, words=False).collect()} == want
    off = {r["page_id"]: r["text"] for r in pages.extract(df, least_pages=1 << 40, words=False).collect()}
    assert sum(off[k] != want[k] for k in want) > 0.9 * len(want)  # it is the tree that decides


def test_importances_match_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    parsed = [(pages.host_of(r["url"]), pages.parse(r["html"])) for r in df.collect()]
    unlike = defaultdict(set)
    for host, p in parsed:
        unlike[host].add("\n".join(p.texts))
    shown, placed, styled, members = Counter(), Counter(), Counter(), defaultdict(set)
    seen = set()
    for host, p in parsed:
        by_host, by_template = pages._sites(host, p.template)
        site = by_host if len(unlike[host]) >= pages.LEAST_PAGES else by_template
        members[site].add("\n".join(p.texts))
        for kind, node, what in pages.rows_of(p):
            if (site, "\n".join(p.texts), kind, node, what) not in seen:
                seen.add((site, "\n".join(p.texts), kind, node, what))
                {pages.BLOCK: shown, pages.PLACE: placed, pages.STYLE: styled, pages.PAGE: Counter()}[kind][site, node, what] += 1
    want = {(s, pages.TREE): 1.0 for s, m in members.items() if len(m) >= pages.LEAST_PAGES}
    for (site, node, what), n in shown.items():
        m = placed[site, node, 0]
        if m >= pages.LEAST_PAGES and n > pages.LEAST_PAGES**0.5 and (value := min(1.0, 2 * math.log(m / n) / math.log(m))) < 1:
            want[site, pages._long(what)] = value
    for site, node in {(s, n) for s, n, _ in styled}:
        counts = [c for (s, n, _), c in styled.items() if (s, n) == (site, node)]
        if sum(counts) >= pages.LEAST_PAGES:
            value = -sum(c / sum(counts) * math.log2(c / sum(counts)) for c in counts) / math.log2(min(sum(counts), pages.STYLES_WHOLE))
            if min(1.0, value) > pages.FLOOR:
                want[site, pages._long(node)] = min(1.0, value)
    got = {(r["site"], r["key"]): r["value"] for r in pages.importances(df.select("url", "html")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_too_many_values_for_a_broadcast_give_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/pages.parquet").union(spark.read.parquet(f"{DATA}/pages.parquet").limit(5)).union(_frame(spark, [(None, None, None)]))
    want = sorted(map(str, pages.extract(df).collect()))
    monkeypatch.setattr(pages, "VALUES_BROADCAST", -1)
    monkeypatch.setattr(pages, "HOSTS_BROADCAST", -1)
    assert sorted(map(str, pages.extract(df).collect())) == want and len(want) == df.count()


def test_what_all_pages_show_goes_and_a_repeated_sibling_takes_nothing_with_it(spark):
    assert _extracted(spark, [f"<div class=x>Same words on all pages</div><div class=main><p>Text {k} of its own</p></div>" for k in range(12)]) == [f"Text {k} of its own" for k in range(12)]
    got = _extracted(spark, [f"<article><p>Text {k} of its own</p><p>More {k}</p><div>Please rate this article</div></article>" for k in range(12)])
    assert got == [f"Text {k} of its own\n\nMore {k}" for k in range(12)]


def test_an_advert_that_differs_on_each_page_goes_by_presentation(spark):
    bodies = [f"<div class=x>Buy number {k} now</div><div class=y>{''.join(f'<p>Text {k} {j}</p>' for j in range(1 + k % 7))}</div>" for k in range(40)]
    assert _extracted(spark, bodies) == ["\n\n".join(f"Text {k} {j}" for j in range(1 + k % 7)) for k in range(40)]


@pytest.mark.parametrize("tag", ["article", "div class=text", "main", "section"])
@pytest.mark.parametrize("after", [True, False])
def test_articles_of_one_shape_beside_lists_of_varying_length(spark, tag, after):
    """Several hosts whose articles are all built alike while a list of links is not: the articles alone come."""
    rows, want = [], {}
    for host in range(3):
        for k in range(40):
            links = "<ul>" + "".join(f"<li><a href=/{j}>Link {host} {k} {j}</a></li>" for j in range(1 + k % 7)) + "</ul>"
            text = f"<{tag}><h1>Title {host} {k}</h1><p>Article text {k} of <a href=/>host {host}</a></p></{tag.split()[0]}>"
            rows.append((100 * host + k, f"https://h{host}.example/{k}", f"<body>{text + links if after else links + text}</body>"))
            want[100 * host + k] = f"Title {host} {k}\n\nArticle text {k} of host {host}"
    assert {r["page_id"]: r["text"] for r in pages.extract(_frame(spark, rows)).collect()} == want


def test_what_says_much_of_its_own_stays_beside_what_varies(spark):
    """Texts of one shape and of RICH characters, beside plain lists that vary and no article anywhere."""
    text = lambda k: f"Text {k} " + " ".join(f"w{(k * 7919 + j) % 9973}" for j in range(60))
    got = _extracted(spark, [f"<div class=a><p>{text(k)}</p></div><div class=b>{'<p>x</p>' * (1 + k % 7)}</div>" for k in range(40)])
    assert all(t.startswith(text(k)) for k, t in enumerate(got))
    index = [f"<div>{''.join(f'<p><a href=/>Entry {k} {j}</a></p>' for j in range(1 + k % 5))}</div>" for k in range(20)]
    assert _extracted(spark, index) == ["\n\n".join(f"Entry {k} {j}" for j in range(1 + k % 5)) for k in range(20)]  # nothing but links: these are the page


def test_a_class_word_inside_an_article_takes_nothing_from_it(spark):
    bodies = [f"<div>Menu</div><article><section class='social history'><p>Text {k}</p></section>{'<p class=widget>More</p>' * 0}<p class=widget>More {k}</p>{'<p>x</p>' * (k % 5)}</article>" for k in range(20)]
    got = _extracted(spark, bodies)
    assert all(t.startswith(f"Text {k}\n\nMore {k}") for k, t in enumerate(got))


def test_copies_of_a_page_count_once(spark):
    body = lambda k: f"<div class=x>Same words</div><div class=main><p>Text {k} of its own</p></div>"
    own = [0] * 90 + list(range(1, 11))
    assert _extracted(spark, [body(k) for k in own]) == [f"Text {k} of its own" for k in own]
    assert _extracted(spark, [body(0)] * 20) == ["Same words\n\nText 0 of its own"] * 20


def test_markup_of_one_page():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><div class='ad'>buy</div><article><header><h1>Head &amp; tail</h1></header><p><b>one<br><p>two\n  x <span hidden>h</span>y</p><div class=comments>no</div><script>var a='</p>'</script></article><aside>s</aside><div id='cookie-notice'>c</div><footer>f</footer></body>"
    text = lambda source, **how: pages.judge(pages.parse(source), None, **how)
    assert text(page) == ["Head & tail", "one", "two x", "y"]
    assert text(page, words=False) == ["buy", "Head & tail", "one", "two x", "y", "c"]
    assert text("") == [] and text(None) == [] and text("plain &lt; text") == ["plain < text"] and text("1 < 2 <p>x</p") == ["1 < 2", "x"]
    assert text("<p title='a>b' class=it's>x</p>") == ["x"] and text("<!-- a > b -->x<![CDATA[ y&amp; ]]><?php z ?>") == ["x y&amp;"]


@pytest.mark.parametrize("source", ["<a " * 100_000, '<a x="' * 100_000, "<div>" * 100_000, "<div><p>x" * 60_000, "<li><ul>x" * 60_000, "<![CDATA[" * 100_000, "<!--" * 100_000, "<script>" * 100_000, "<a " + "b " * 300_000 + ">x", "word " * 300_000, "<div>" * 60_000 + "</p></x>" * 60_000])
def test_hostile_pages_take_time_in_proportion(source):
    start = time.perf_counter()
    pages.judge(pages.parse(source), None)
    assert time.perf_counter() - start < 5


def test_odd_rows(spark):
    assert pages.extract(_frame(spark, [])).count() == 0
    rows = [(1, None, None), (1, None, None), (None, "x", "<p>a"), (2, "//h", ""), (3, "//h", "<p>" + "long text " * 50_000)]
    odd = _frame(spark, rows).withColumn("text", F.lit("t")).withColumn("host", F.lit(1)).withColumn("site", F.lit(2))
    got = pages.extract(odd)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r["page_id"] or 0, r["text"][:4], len(r["text"])) for r in got.collect()) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0), (3, "long", 499_999)]
