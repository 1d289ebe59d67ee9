"""HTML extraction and URL filters."""

from __future__ import annotations

import datetime as dt
import html as chars
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.llm import html_extract, url_filters
from tests.oracle import compare, connect

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav>
<div id="main-column"><h1>Heading</h1><div class=text>First paragraph, with commas, and a <b>bold &amp; <i>nested</i></b> part; it goes on. And on.</div><div class=text>Second&nbsp;one<br>with a break, another sentence. &lt;tag&gt; &#233; &unknown;</div></div>
<div class="comments"><p>Nice post, thanks for sharing, I liked it. Really.</p></div><aside>Related, things, here.</aside><form>Name: <input></form><footer>&copy; Someone, 2024.</footer><script>var a="<p>no, no, no.</p>"</script></body></html>"""


def test_page_without_article():
    assert html_extract.content_of(PAGE) == ["Heading", "First paragraph, with commas, and a bold & nested part; it goes on. And on.", "Second one with a break, another sentence. <tag> é &unknown;"]


def test_article_without_its_boilerplate():
    page = "<body><nav>Menu</nav><article><header><h1>Big</h1><div>by X</div></header><p>One, two, three. Four.<p>Five<ul><li>six<li>seven</ul><aside>ad, ad.</aside><div class='share-bar'>Share, now.</div><section class='comments'><p>No, never.</p></section></article><footer>Bye, all.</footer>"
    assert html_extract.content_of(page) == ["Big", "One, two, three. Four.", "Five", "six", "seven"]


LONG = "This paragraph says something, at some length, of what the page is about; and it ends."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{LONG}</p><svg/><p>{LONG} 2</p><iframe src=x /><p>{LONG} 3</p></article>", [LONG, f"{LONG} 2", f"{LONG} 3"]),
        (f"<article><p>{LONG}</p><svg><p>{LONG} 2</p></article>", [LONG, f"{LONG} 2"]),
        (f"<article><p>One <svg-icon></svg-icon> two, three. {LONG}</p><p>{LONG} 2</p></article>", [f"One two, three. {LONG}", f"{LONG} 2"]),
        (f"<title-bar>Top</title-bar><article><p>{LONG}</p></article>", [LONG]),
        (f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. {LONG}</p></article>", [f"So x=2 holds. {LONG}"]),
        (f"<article><p class='share-price'>{LONG} 1</p><p>{LONG}</p><section id=legal><p>{LONG} 2</p></section></article>", [f"{LONG} 1", LONG, f"{LONG} 2"]),
        (f"<div class=c1><h1>Top</h1><p>{LONG}</p><p>{LONG} 2</p><ul><li>one<li>two<li>three</ul></div><div class=footer>Bye, all.</div>", ["Top", LONG, f"{LONG} 2", "one", "two", "three"]),
        (f"<main><div><a href=/1>Home</a> <a href=/2>News</a></div><article><h1>Top</h1><p>{LONG}</p></article></main>", ["Top", LONG]),
        (f"<form id=aspnet><div class=top><a href=/>Home</a></div><div class=mid><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p></div></form>", [f"{LONG} {LONG}"] * 2),
        (f"<div class=mid><p>{LONG}</p><p>{LONG}</p></div><form>Your name, please: <input></form><div hidden><p>{LONG} 9</p></div>", [LONG, LONG]),
    ],
)
def test_nothing_else_is_lost(page, want):
    assert html_extract.content_of(page) == want


def brute_scores(page):
    """Scores by their definition: every pair of paths, and distances by walking up the tree."""
    h, paths = html_extract, page.paths
    weight = {i: p.weight for i, p in enumerate(paths)}
    above = {i: [i] for i in range(len(paths))}
    for i in above:
        while above[i][-1]:
            above[i].append(paths[above[i][-1]].parent)
    inner = {p.parent for i, p in enumerate(paths) if i}

    def holder(i):
        return paths[paths[i].parent].container if paths[i].container == i and i not in inner else paths[i].container

    def up_from(i):
        chain = [i]
        while chain[-1]:
            chain.append(holder(paths[chain[-1]].parent))
        return chain

    def far(a, b):
        x, y = up_from(a), up_from(b)
        return min(x.index(c) + y.index(c) for c in set(x) & set(y))

    ratio = {i: (h.NO_LENGTH + (1 - h.NO_LENGTH) * (t := p.text / p.blocks) / (t + h.HALF_LENGTH)) * (h.NO_MARKS + (1 - h.NO_MARKS) * (m := p.marks / p.blocks) / (m + h.HALF_MARKS)) * (1 - (1 - h.ALL_LINKS) * p.links / p.text) for i, p in enumerate(paths) if p.blocks}
    named = {i: np.prod([paths[j].hint for j in above[i]]) for i in ratio}
    bare = {i: weight[i] ** 2 * r * paths[i].text for i, r in ratio.items()}

    def taken(j):
        """What the class of one element takes: in full with a tenth of the mass elsewhere, else a power of it."""
        elsewhere = sum(m * named[i] ** 2 for i, m in bare.items() if j not in above[i])
        own = sum(m for i, m in bare.items() if j in above[i])
        return paths[j].hint ** min(1, elsewhere / (elsewhere + own) / h.OUTSIDE) if elsewhere + own else 1.0

    weight = {i: weight[i] * np.prod([taken(j) for j in above[i] if paths[j].hint < 1]) for i in ratio}
    seq = [ratio[b[0]] for b in page.blocks]
    side = np.exp(-0.5)
    smooth = [(side * seq[max(0, k - 1)] + seq[k] + side * seq[min(len(seq) - 1, k + 1)]) / (1 + 2 * side) for k in range(len(seq))]
    mass = {i: weight[i] ** 2 * r * paths[i].text for i, r in ratio.items()}
    out = {}
    for i in ratio:
        near = sum(m * h.DECAY ** far(holder(i), holder(j)) for j, m in mass.items()) / (sum(mass.values()) or 1)
        out[i] = weight[i] * np.sqrt(np.mean([v for v, b in zip(smooth, page.blocks, strict=True) if b[0] == i]) * min(near, 1))
    return out


def made_page(rng, number):
    """(html, content blocks) of a page without article and main, whose classes mislead: the content's container may be called post-list, its neighbours story or text."""
    sentence = lambda n: " ".join(rng.choice("river stone walks under bright morning light over quiet fields while people talk".split()) for _ in range(n)).capitalize()
    name = lambda: rng.choice(["story", "text", "c%d" % rng.randint(1, 99), "post-list", "block inner", "share-price", "x"])
    content, body = [], []
    for k in range(rng.randint(4, 14)):
        kind = rng.random()
        if kind < 0.15:
            content.append(f"{sentence(3)} {number}-{k}")
            body.append(f"<h2>{content[-1]}</h2>")
        elif kind < 0.3:
            own = [f"{sentence(rng.randint(2, 6))} {number}-{k}-{j}" for j in range(3)]
            content += own
            body.append("<ul>" + "".join(f"<li>{x}" for x in own) + "</ul>")
        else:
            content.append(", ".join(sentence(rng.randint(4, 9)) for _ in range(rng.randint(3, 8))) + f". {number}-{k}.")
            body.append(f"<p class='{name()}'>{content[-1]}</p>" if rng.random() < 0.3 else f"<p>{content[-1]}</p>")
    links = lambda n: "".join(f"<li><a href=/{j}>{sentence(rng.randint(1, 4))}</a>" for j in range(n))
    page = f"<html><body><div class='{name()}'><ul>{links(6)}</ul></div><div class=wrap><div class='{name()} col'>{''.join(body)}</div><div class='{name()} side'><ul>{links(8)}</ul><a href=/x>{sentence(2)}</a></div></div><div class='{name()} end'><a href=/a>About</a> <a href=/b>Terms</a> {sentence(2)}</div></body></html>"
    return page, content


NAMES = "right-sidebar content-sidebar left-rail sidebar modal-content overlay popup header-content page-header-wrapper masthead footer-wrap banner-page promo promotion nav-wrapper menu-page toolbar cookie-box share-page comment-page login-page newsletter ad-wrapper widget related".split()


@pytest.mark.parametrize("name", NAMES)
def test_a_name_around_the_whole_page_decides_nothing(name):
    body = "<h1>Top</h1>" + "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    want = ["Top", *(f"{LONG} {i}" for i in range(6))]
    menu, end = "<nav><a href=/>Home</a> <a href=/n>News</a></nav>", "<footer>Bye, all.</footer>"
    assert html_extract.content_of(f"<body>{menu}<div class='{name}'>{body}</div>{end}</body>") == want
    assert html_extract.content_of(f"<body><div class='{name}'>{menu}<div id='{name}-inner'>{body}</div>{end}</div></body>") == want
    assert html_extract.content_of(f"<body>{menu}<div class='{name}'><article>{body}</article></div>{end}</body>") == want


@pytest.mark.parametrize("name", NAMES)
def test_a_name_beside_the_content_counts(name):
    story = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    for around in ("<article>{}</article>", "<div class=story>{}</div>"):
        got = html_extract.content_of(f"<body>{around.format(story)}<div class='{name}'><p>{LONG} 8</p><p>{LONG} 9</p></div></body>")
        assert got == [f"{LONG} {i}" for i in range(6)]


def test_comments_longer_than_the_article():
    story = f"<p>{LONG} 1</p><p>{LONG} 2</p>"
    assert html_extract.content_of(f"<div class=story>{story}</div><div class=comments>{f'<p>{LONG} 3</p>' * 9}</div>") == [f"{LONG} 1", f"{LONG} 2"]


def test_cells_of_a_table_layout():
    links = "".join(f"<a href=/{i}>Some page {i}</a><br>" for i in range(8))
    side = "".join(f"<li><a href=/{i}>Another {i}</a>" for i in range(6))
    page = f"<table><tr><td>{links}</td><td><h1>Top</h1><p>{LONG} 1</p><p>{LONG} 2</p></td><td><ul>{side}</ul></td></tr></table>"
    assert html_extract.content_of(page) == ["Top", f"{LONG} 1", f"{LONG} 2"]
    data = "<table>" + "".join(f"<tr><td>Name number {i}</td><td>{i} units, about.</td></tr>" for i in range(5)) + "</table>"
    got = html_extract.content_of(f"<article><p>{LONG} 1</p>{data}<p>{LONG} 2</p></article>")
    assert got == [f"{LONG} 1", *(x for i in range(5) for x in (f"Name number {i}", f"{i} units, about.")), f"{LONG} 2"]


def test_a_name_on_a_paragraph_does_not_decide():
    assert html_extract.content_of(f"<article><p>{LONG} 1</p><p class='notice'>{LONG} 2</p><p>{LONG} 3</p></article>") == [f"{LONG} {i}" for i in (1, 2, 3)]


def test_scores_equal_their_definition(spark, sf):
    rng = random.Random(5)
    pages = [made_page(rng, i)[0] for i in range(20)] + [PAGE] + [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(10).collect()]
    for text in pages:
        page = html_extract.read_page(text)
        got = html_extract.scores(page)
        assert all(abs(got[i] - v) < 1e-9 for i, v in brute_scores(page).items())
        least = html_extract.THRESHOLD * max(1.0, got.max())
        assert html_extract.content_of(text) == [t for p, t in page.blocks if got[p] >= least]


def test_precision_and_recall_without_article():
    rng, right, returned, wanted = random.Random(11), 0, 0, 0
    for i in range(300):
        page, content = made_page(rng, i)
        got = html_extract.content_of(page)
        right += len(set(got) & set(content))
        returned += len(got)
        wanted += len(content)
    assert right / returned >= 0.98 and right / wanted >= 0.98, (right / returned, right / wanted)


def test_work_is_linear_in_the_page():
    took = []
    for n in (20_000, 80_000):
        for page in ("<div>" * n + LONG, "<svg>" * n + LONG, "<a href=x>" * n + LONG, "<p class=a" * n, "".join(f"<div class=c{i}>{i}" for i in range(n))):
            began = time.time()
            html_extract.content_of(page)
            took.append(time.time() - began)
    assert all(b < 12 * max(a, 0.05) for a, b in zip(took[:5], took[5:], strict=True)), took


def test_extract_with_clashing_columns_and_no_rows(spark):
    rows = spark.createDataFrame([(1, f"<p>{LONG}</p>", "old", 5, "k")], "page_id long, html string, text string, N_CHARS int, url string")
    (got,) = html_extract.extract(rows).collect()
    assert (got.text, got.n_chars, got.url, got.html) == (LONG, len(LONG), "k", f"<p>{LONG}</p>")
    assert html_extract.extract(rows.filter("false")).collect() == []


def test_broken_and_empty_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "   "), (4, "u", "<div"), (5, "u", "plain text, no tags."), (6, None, "<p>unclosed, <b>bold text. <p>next, one here."), (7, "u", "<" * 2000), (8, "u", "<p>" * 3000 + "deep, text."), (8, "u", "<p a='x>quoted, text.</p>"), (9, "u", "<!-- only -->"), (10, "u", "<nav>menu, only.</nav>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=["page_id", "url"]).collect()
    assert [r.text for r in got[:4]] == ["", "", "", ""] and got[4].text == "plain text, no tags." and got[5].text == "unclosed, bold text.\n\nnext, one here."
    assert got[7].text == "deep, text." and got[9].text == got[10].text == "" and all(r.n_chars == len(r.text) for r in got)


def test_long_page_is_whole():
    body = "".join(f"<p>Sentence number {i}, which is long enough. It ends.</p>" for i in range(20_000))
    assert len(html_extract.content_of(f"<html><body><article>{body}</article></body></html>")) == 20_000


def test_query_keeps_the_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.op6_html_extract(spark, sf).collect():
        body = re.split(r"</article>|<footer>", pages[r.page_id].split("<article>")[1])[0]
        blocks = [" ".join(chars.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def day(n):
    return dt.datetime(2024, 1, n)


def test_captures_are_judged_as_of_their_fetch(spark):
    entries = [("bad.com", "spam", "add", day(5)), ("bad.com", "spam", "remove", day(10)), ("bad.com", "spam", "add", day(20)), ("sub.bad.com", "malware", "add", day(8)), ("BAD.com", "spam", "add", day(5)), (None, "spam", "add", day(1)), ("x.org", None, "add", day(1)), ("same.day", "spam", "add", day(3)), ("same.day", "spam", "remove", day(3))]
    captures = [
        (1, "http://bad.com/a", day(4)), (2, "http://bad.com/a", day(5)), (3, "https://user@WWW.bad.com:80/x", day(9)), (4, "http://bad.com/", day(10)), (5, "http://bad.com./", day(25)), (6, "http://a.sub.bad.com", day(9)), (7, "http://notbad.com/", day(9)),
        (8, None, day(9)), (9, "no url", day(9)), (10, "http://bad.com/", None), (11, "http://same.day/", day(4)), (2, "http://bad.com/a", day(5)),
    ]
    got = url_filters.judge(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz"), spark.createDataFrame(entries, "pattern string, category string, action string, dated timestamp_ntz")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 12 and sum(r.page_id == 2 for r in got) == 2
    assert {i for i, r in by.items() if r.blocked} == {2, 3, 5, 6}
    assert by[6].category == "malware" and by[5].listed_at == day(20) and by[3].host == "www.bad.com" and by[8].host is None


def brute_judge(captures, entries):
    """The latest listing that holds, by trying all entries for each capture."""
    out = []
    for page, url, at in captures:
        host = (m[1].lower().rstrip(".") if (m := re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")) else "") or None
        best = None
        for pattern, category in {(p.lower().strip("."), c) for p, c, *_ in entries}:
            own = sorted({(d, a) for p, c, a, d in entries if (p.lower().strip("."), c) == (pattern, category)})
            for (since, action), after in zip(own, [*[d for d, _ in own[1:]], None], strict=True):
                if host and at and action == "add" and (host == pattern or host.endswith("." + pattern)) and since <= at and (after is None or at < after):
                    best = max(best or (since, len(pattern), category), (since, len(pattern), category))
        out.append((page, host, best is not None, best and best[2], best and best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 1024])
def test_suffixes_and_many_subdomains(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filters, "HOT", hot)
    rng = random.Random(hot)
    entries = [("com", "tld", "add", day(20)), (".co.uk", "tld", "add", day(3)), ("b.com", "spam", "add", day(2)), ("b.com", "spam", "remove", day(9)), ("A.b.com.", "adult", "add", day(4))]
    entries += [(f"s{i}.big.org", rng.choice(["x", "y"]), rng.choice(["add", "remove"]), day(rng.randint(1, 28))) for i in range(300) for _ in range(2)]
    hosts = ["com", "x.com", "b.com", "a.b.com", "z.a.b.com", "ab.com", "news.co.uk", "co.uk", "uk", "big.org", "s1.big.org", "t.s2.big.org"] + [f"s{i}.big.org" for i in range(80)]
    captures = [(i, f"http://{rng.choice(hosts)}/p", day(rng.randint(1, 28))) for i in range(400)] + [(None, "http://b.com", day(5)), (None, None, None), (None, None, None), (9, "http://b.com", None)]
    left = spark.createDataFrame([(*c, "mine", 1) for c in captures], "page_id long, url string, fetched_at timestamp_ntz, host string, n int")
    got = url_filters.judge(left, spark.createDataFrame(entries, "pattern string, category string, action string, dated timestamp_ntz")).collect()
    assert sorted(((r.page_id, r.host, r.blocked, r.category, r.listed_at) for r in got), key=str) == brute_judge(captures, entries)


def test_filters_on_empty_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    none = pages.filter("false")
    assert url_filters.judge(url_filters.demo_captures(none), url_filters.demo_entries(none)).count() == 0
    assert url_filters.judge(url_filters.demo_captures(pages), url_filters.demo_entries(none)).filter("blocked").count() == 0


def test_filters_equal_sql(spark, sf):
    compare(url_filters.op9_url_filters(spark, sf), connect(sf), url_filters.ORACLE)


def test_copies_of_a_capture_are_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "PIECE", 3)
    captures = [(1, "http://b.com/x", day(9))] * 40 + [(2, "http://b.com/y", day(2))] * 3 + [(None, None, None)] * 7
    entries = [("b.com", "spam", "add", day(5))]
    got = url_filters.judge(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz"), spark.createDataFrame(entries, "pattern string, category string, action string, dated timestamp_ntz"))
    assert sorted(((r.page_id, r.host, r.blocked, r.category, r.listed_at) for r in got.collect()), key=str) == brute_judge(captures, entries)
    assert got.filter("page_id = 1").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_long_history_is_met_once_a_category(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    entries = [("b.com", kind, action, at(4 * i + shift)) for i in range(150) for kind, shift in (("adult", 0), ("spam", 1)) for action, shift in (("add", shift), ("remove", shift + 2))]
    captures = [(i, "http://a.b.com/", at(i)) for i in range(0, 610)]
    left, right = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz"), spark.createDataFrame(entries, "pattern string, category string, action string, dated timestamp_ntz")
    got = url_filters.judge(left, right).collect()
    assert sorted(((r.page_id, r.host, r.blocked, r.category, r.listed_at) for r in got), key=str) == brute_judge(captures, entries)
