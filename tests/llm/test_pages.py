"""Operators on pages and vectors: main text, archives, URL rules, nearest vectors."""

import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from framesift.llm import topk, urls, warc, wrappers

SCHEMA = "page_id long, url string, html string, host string, payload string, text string"


def page(k, body, nav=True):
    menu = f"<nav><ul><li><a href='/{k}'>Menu {k}</a></li></ul></nav>" if nav else ""
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{menu}"
            f"<!-- ad --><div class='ad'>Buy {k}</div><article><h1>Title {k}</h1>{body}</article><footer>&copy; {k}</footer></body></html>")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    long = "<p>" + "word &amp; more " * 8000 + "</p>"
    out = [(k, f"https://h{k % 3}.example.org/en/{k}", page(k, f"<p><b>Body {k}\n  text<br><p>Second &lt;{k}&gt;</p>")) for k in range(30)]
    out += [(40, None, None), (41, "no scheme", ""), (None, "http://H1.Example.org?x", page(1, long)), (43, "http://x.org", page(2, long)),
            (44, "http://x.org/a\r\nb", page(2, long)), (3, out[3][1], out[3][2]), (3, out[3][1], out[3][2]), (46, "://", "\r\n\r\nWARC/1.1\r\n"),
            (47, "http://a.b/é", "é" * r.randint(9000, 20000)), (None, None, None), (48, "https://com/de/x", "<p>" * 3000 + "deep")]
    return out


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_main_text(pages, rows, none):
    found = wrappers.extracted(pages).collect()
    same([(r.page_id, r.url) for r in found], [(p, u) for p, u, _ in rows])
    by = {r.page_id: r for r in found}
    assert by[7].text == "Title 7\nBody 7 text\nSecond <7>" and by[7].n_chars == len(by[7].text)
    assert by[40].text == by[41].text == "" and by[48].text == "deep"
    assert by[43].text == "Title 2\n" + ("word & more " * 8000).strip()
    assert wrappers.extracted(none).count() == 0


@pytest.mark.parametrize("html, text", [
    ("<p>a<p>b <i>c</i>\n d<ul><li>x<li>y</ul><div>z<br>w</div>&eacute;&#x41;", "a\nb c d\nx\ny\nz w\néA"),
    ("<body><div class='wrap sidebar-left'><article>Kept</article></div><aside>no</aside></body>", "Kept"),
    ("<article>A<form>f</form><div class='notice'>n</div><section id='comments'><article class='comment'>c</article></section></article>", "A"),
    ("<main><p>One</p><button>b</button><div hidden>h</div><div role='navigation'>n</div></main><p>out</p>", "One"),
    ("<div id='content'><p>In</p></div><div class='cookie-banner'>c</div>", "In"),
    ("<p>only text &amp", "only text &"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("", ""), ("<b>" * 5000 + "x", "x"),
    ("<article>short</article><article>the longer one of two</article>", "the longer one of two"),
])
def test_elements(html, text):
    assert wrappers.extract(html) == text


@pytest.mark.parametrize("html, text", [
    ("<article><h2 id='related-work'>Related</h2><p id='social'>Said</p><section id='social-impact'><p>Impact</p></section></article>", "Related\nSaid\nImpact"),
    ("<article><div class='entry-header'><h1>Title</h1></div><section id='history-of-advertising'>History</section></article>", "Title\nHistory"),
    ("<article><section id='comments-on-method'>Method</section><h2 class='section header'>Head</h2></article>", "Method\nHead"),
    ("<h2 id='related-work'>No main</h2><p id='comments'>Text</p>", "No main\nText"),
    ("<article>A<div class='social-share'><a href='/'>Here</a> <a href='/'>There</a></div><div class='box related'>r</div><p class='ad'>x</p></article>", "A"),
])
def test_names_in_the_main_element(html, text):
    assert wrappers.extract(html) == text


def site(k, **more):
    return (f"<div class=top><p>Welcome to the site</p></div><div><h2>Head {k}</h2><p>Read more at our site.</p>"
            f"<p>Body {k} is long enough to be what page {k} is about.</p></div><p>{more.get('tail', 'Made with care')}</p>")


def test_template_goes(spark):
    rows = [(k, "http://s.org/x", site(k)) for k in range(12)] + [(50 + k, "http://copies.org/", site(1)) for k in range(9)]
    rows += [(70, "http://few.org", site(1)), (71, "http://few.org", site(2))]
    found = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"Head {k}\nBody {k} is long enough to be what page {k} is about." for k in range(12))
    # Copies of one page and a host with two pages have no template.
    assert "Welcome" in found[50] and "Welcome" in found[70]


def texts_of(spark, rows):
    return {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_that_outweighs_short_pages(spark):
    """Boilerplate of over half of a page, on all pages or on one, is still template."""
    menu = "".join(f"<div><p>Menu entry number {k} of the site</p></div>" for k in range(20))
    rows = [(k, "http://short.org/", f"{menu}<div><p>Short {k}</p></div>") for k in range(9)]
    rows += [(20 + k, "http://one.org/", f"{menu}<div><p>{f'Long {k} ' * (200 if k else 1)}</p></div>") for k in range(9)]
    found = texts_of(spark, rows)
    assert all(found[k] == f"Short {k}" for k in range(9))
    assert all(found[20 + k] == (f"Long {k} " * (200 if k else 1)).strip() for k in range(9))


def test_template_of_all_pages(spark):
    """Long pages count, an odd page voids nothing, and what a few of many pages share stays."""
    long = "".join(f"<p>Word {k}</p>" for k in range(100))
    rows = [(k, "http://long.org/", f"<div><p>Welcome</p></div><div><p>{f'Body {k} ' * 12000}</p></div>") for k in range(5)]
    rows += [(100 + k, "http://odd.org/", site(k)) for k in range(5)] + [(110, "http://odd.org/404", f"<table><tr><td>Not found</table>{long}")]
    rows += [(200 + k, "http://six.org/", f"<div><p>{'Shared by few' if k < 6 else f'Own {k}'}</p></div><div><p>Page {k}</p></div>") for k in range(40)]
    found = texts_of(spark, rows)
    assert all(found[k] == (f"Body {k} " * 12000).strip() for k in range(5))
    assert all(found[100 + k] == f"Head {k}\nBody {k} is long enough to be what page {k} is about." for k in range(5))
    assert "Not found" in found[110] and found[203] == "Shared by few\nPage 3"


def test_least_pages(spark):
    """Every host with four different pages has a wrapper; one with three has none."""
    rows = [(100 * h + k, f"http://h{h}.org/", f"<div><p>Welcome</p></div><div><p>Page {h} {k}</p></div>") for h in range(30) for k in range(3 + (h > 0))]
    found = texts_of(spark, rows)
    assert all(found[100 * h + k] == ("" if h else "Welcome\n") + f"Page {h} {k}" for h in range(30) for k in range(3 + (h > 0)))


def test_tree_matching():
    a, b = wrappers.slots("<div><p>x</p><p>1</p><p>y</p></div>"), wrappers.slots("<div><p>x</p><p>2</p><p>3</p><p>y</p></div>")
    score, pairs = wrappers.matched(a, b)
    assert {(x.text, y.text) for x, y in pairs} >= {("x", "x"), ("y", "y")} and score >= 5


def test_archive(spark, pages, rows, none, tmp_path):
    kept, expected = defaultdict(list), []
    for p, _, html in rows:
        kept[(html or "").encode()].append(p)
    for p, _, html in rows:
        payload = (html or "").encode()
        last = max((x for x in kept[payload] if x is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected.append((p, len(payload), digest, "response" if p == last else "revisit", None if p == last else last))
    path = str(tmp_path / "archive")
    table = str(tmp_path / "pages")
    pages.write.parquet(table)
    warc.written(spark.read.parquet(table), path, warc.Archive(segment=700, chunk=100, records=9))
    read = warc.read(spark, path).cache()
    assert read.where("problem IS NOT NULL").count() == 0
    found = warc.resolved(read.drop("payload")).collect()
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], expected)
    texts = {bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
    assert texts == set(kept)
    warc.written(none, str(tmp_path / "none"))
    assert warc.resolved(warc.read(spark, str(tmp_path / "none")).drop("payload")).count() == 0


def test_archive_below_the_least_size(spark, tmp_path):
    table = str(tmp_path / "p")
    spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string").write.parquet(table)
    warc.written(spark.read.parquet(table), str(tmp_path / "a"), warc.Archive(least=3))
    found = warc.resolved(warc.read(spark, str(tmp_path / "a")).drop("payload")).collect()
    same([(r.page_id, r.record_type, r.refers_to) for r in found], [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)])


def test_broken_archives(spark, tmp_path):
    """Missing segments, wrong totals, framing and digests keep their row and say what is wrong."""
    row = {"row": 1, "page_id": 5, "url": "u", "payload": b"x" * 5000, "of_page": None, "of_row": None}
    small = warc.Archive(segment=1000, chunk=300)
    whole = warc.page_records(row, small)
    cases = {"missing": [whole[0], *whole[2:]], "length": [*whole[:-1], whole[-1][:-1].replace(b"Content-Length: ", b"Content-Length: ")],
             "framing": [r.replace(b"12c\r\n", b"12d\r\n") for r in whole], "digest": [r.replace(b"xx", b"yx") for r in whole]}
    cases["length"] = [*whole[:-1], whole[-1].replace(b"Segment-Total-Length: ", b"Segment-Total-Length: 9")]
    for name, records in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.warc.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in reversed(records))))
        found = warc.read(spark, str(folder)).collect()
        assert len(found) == 1 and found[0].problem and found[0].payload is None, name
    folder = tmp_path / "fine"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in reversed(whole)))
    assert bytes(warc.read(spark, str(folder)).first().payload) == row["payload"]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("com", "/de/", "allow"), (None, "/", "block"), ("x", None, "block"), ("y", "", "block")]


def judged(url):
    before, found, rest = (url or "").partition("://")
    host, path = "", ""
    if found:
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host):].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and p is not None and v
            and (host == h or host.endswith("." + h)) and path.startswith(p) and (h, p, v) != ("com", "/de/", "allow")]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark, pages, rows, none):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    more = ["http://A.b.COM/de/x?y", "http://com/de", "http://xcom/de/", "http://example.org/en/12#a", "http://sub.example.org/es/",
            "http://example.org/es", "http://example.org", "http://y", "a://b://c/d", "http://" + "a." * 2000 + "org/q", "x://h?/p", "http://h\n.org/\n/z", "Ä://ÄB.org/"]
    given = pages.select("page_id", "url", "host").union(spark.createDataFrame([(900 + k, u, "q") for k, u in enumerate(more)], "page_id long, url string, host string"))
    found = urls.judged(given, rules).collect()
    same([tuple(r) for r in found], [(p, *judged(u)) for p, u in [(p, u) for p, u, _ in rows] + [(900 + k, u) for k, u in enumerate(more)]])
    assert urls.judged(none, rules).count() == 0
    free = urls.judged(given, rules.limit(0)).collect()
    assert {(r.rule, r.verdict) for r in free} == {(None, "allow")} and len(free) == len(found)


@pytest.mark.parametrize("kind", ["spread", "ties", "huge"])
def test_nearest(spark, kind):
    import math
    from pyspark.sql import functions as F

    r = random.Random(kind)
    value = {"spread": lambda: r.gauss(0, 0.3), "ties": lambda: r.choice([0.0, 0.001, -0.001]), "huge": lambda: r.gauss(0, 2e5)}[kind]
    rows = [(k, [value() for _ in range(r.choice([8, 8, 8, 5, 0]))]) for k in range(300)]
    rows += [(300, None), (301, [0.1, None]), (302, [float("nan")]), (303, [float("inf"), 1.0]), (None, [1.0]), (7, rows[7][1])]
    table = spark.createDataFrame([(k, v, 0, 1) for k, v in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(3)
    search = topk.Search(k=10, pivots=4, queries=7, candidates=60, step=16)
    found = topk.nearest(table, F.col("vec_id") % 10 == 0, search).collect()
    whole = {k: [math.floor(x * 1024) for x in v] for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in (k for k in whole if k % 10 == 0):
        scores = sorted((-sum(x * y for x, y in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:10]
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    same([tuple(x) for x in found], expected)
    assert topk.nearest(table.limit(0), F.col("vec_id") % 10 == 0, search).count() == 0
    assert topk.nearest(table.where("vec_id < 4"), F.col("vec_id") == 0, search).count() == 3
