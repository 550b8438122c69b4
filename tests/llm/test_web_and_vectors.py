"""Operators on pages and vectors: brute force, round trips, odd inputs."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from threadloom.llm import archives, covertree, differencing, urls
from threadloom.llm.tables import table

SF = "/root/testdata/sf0.001"
URLS = [None, "", "no scheme", "http://", "HTTPS://A.Example.COM", "https://a.example.com/", "x://net/es/",
        "http://www.example.com/en/1?a#b", "http://b.www.example.com/en/", "http://example.com/en/9#f",
        "http://example.com:80/en/", "http://notexample.com/en/", "http://q.net/fr/x?y=/es/",
        "http://q.net?x/fr/", "http://com/", "http://x.org/en/"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows],
                                 "page_id bigint, url string, html string, host string, rule string")


def test_url_rules_by_hand(spark):
    from threadloom.llm.catalog import URL_RULES
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    df = pages(spark, [(i, u, None) for i, u in enumerate(URLS)])
    for r in urls.judge(df, rules).collect():
        url, host, path = URLS[r.page_id] or "", "", ""
        if "://" in url:
            rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
            host, slash, tail = rest.partition("/")
            host, path = host.lower(), slash + tail
        fits = [(h + p, v) for h, p, v in URL_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), url
    assert urls.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    draw = np.random.default_rng(5).integers(-2**62, 2**62, (3000, 2))
    df = spark.createDataFrame(draw.tolist(), "h1 bigint, h2 bigint")
    cascade = urls.Cascade(df.limit(700), df)
    got = cascade.listed(draw[:, 0], draw[:, 1])
    listed = {(r.h1, r.h2) for r in df.limit(700).collect()}
    assert got.tolist() == [tuple(x) in listed for x in draw.tolist()] and len(cascade.levels) > 1


def test_arc_of_both_versions():
    records = [("http://a/ b", "text/html", archives.http(b"one\n\nhttp://fake 1 2 3 4\n", 7)),
               ("-", "text/html", archives.http(b"", None))]
    for version in (1, 2):
        packed = archives.arc_file(version, "x.arc.gz", "20010203040506", records)
        for data in (packed, b"".join(archives._members(packed))):
            got = list(archives.parse_arc(data))
            assert [(r["URL"], r["body"]) for r in got] == [(u, b) for u, _, b in records]
            assert got[0]["Archive-date"] == "20010203040506" and ("Checksum" in got[0]) == (version == 2)
        record = archives.convert(got[0], "arc", 0, None)
        (headers, block), = archives.parse_warc(archives._member(record))
        assert headers["WARC-Type"] == "response" and headers["WARC-Date"] == "2001-02-03T04:05:06Z"
        assert archives.parse_http(block) == ({"content-type": "text/html; charset=utf-8", "x-page-id": "7",
                                               "content-length": "25"}, b"one\n\nhttp://fake 1 2 3 4\n")
    with pytest.raises(ValueError):
        list(archives.parse_arc(archives.arc_record(1, "u", "1", "t", b"abcd", "n", 0)[:-3]))


def test_through_archives(spark):
    rows = [(3, "http://x/", "same"), (1, None, "same"), (9, "http://y z/", "same"), (4, "u", None),
            (5, "u", ""), (6, "u", "é" * 50_000), (6, "u", "é" * 50_000), (None, "u", "same"), (8, "u", "only")]
    got = archives.through_archives(pages(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    first = {"same": 1, "": 4, "é" * 50_000: 6, "only": 8}
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for i, _, html in rows:
        html = html or ""
        for r in by[i]:
            assert r.payload_bytes == len(html.encode()) and r.payload_digest == archives.digest(html.encode())
            assert r.refers_to == (None if r.record_type == "response" else first[html])
            if i != 6:
                assert (r.record_type == "response") == (first[html] == i)
    assert sorted(r.record_type for r in by[6]) == ["response", "revisit"]
    large = archives.through_archives(pages(spark, rows[:3] + rows[5:7]), least=5).collect()
    assert sorted(r.record_type for r in large) == ["response"] * 4 + ["revisit"]
    assert archives.through_archives(pages(spark, rows).limit(0)).count() == 0


def lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_lines_of_broken_pages():
    def texts(page):
        return [t for t, _, around in differencing.lines_of(page) if not around]

    assert texts("<p>A</p><script>for(i=0;i<n;i++){}</script><p>B</p>") == ["A", "B"]
    assert texts("<script><!-- x </script><p>B</p>") == ["B"]
    assert texts("\u0130\u0130<script>x</script><p>B</p>") == ["\u0130\u0130", "B"]
    assert texts("<p>A <a href='b") == ["A"]
    assert texts("<p title='a>b'>A</p><p title=\"a>B") == ["A", "B"]
    assert texts("<p>a < b and 3<4</p><!-- C <p>D") == ["a < b and 3<4"]
    assert texts("<div class=comments><article><p>A</p></article></div><p>B</p>") == ["B"]
    assert texts("<nav><li>A<article><p>B</p></article>") == ["B"]
    for long in ("<a" * 200_000, "<a " + "\"' " * 50_000, "<a \"' " * 50_000 + ">", "<!--" * 50_000):
        assert texts(long) == []


@pytest.mark.parametrize("page", [
    '<article class="post category-social"><p>A</p></article>', '<main class="site-main no-sidebar"><p>A</p></main>',
    '<body class="has-sidebar with-menu ad"><p>A</p></body>', '<html class="no-ads nav"><body id="footer"><p>A</p>',
    '<article class="share related"><p>A</p></article>', '<article><section id="related-work"><p>A</p></section></article>',
    '<article><h2 id="social-security" class="widget">A</h2></article>', '<article><h2 id="login-flow">A</h2></article>',
    '<section id="comments"><p>A</p></section>', '<article><div id="login"><p>A</p></div></article>',
    '<div class="has-sidebar promo-free"><p>A</p></div>', '<div class="section" id="footer"><p>A</p></div>'])
def test_names_of_layouts_and_topics_mark_nothing(page):
    assert [t for t, _, around in differencing.lines_of(page) if not around] == ["A"]


@pytest.mark.parametrize("box", [
    'p class="ad"', "div class='x Side-Bar y'", "div id=sidebar", "section class=related", "div id='comments'",
    "div class=cookie-banner", "h2 hidden", "div role=navigation"])
def test_closed_list_of_names_still_marks(box):
    page = f"<div><{box}>A</{box.split()[0]}><p>B</p></div>"
    assert [t for t, _, around in differencing.lines_of(page) if not around] == ["B"]


@pytest.mark.parametrize("page, expected", [
    ('<article><p class="ad">Buy<p>One<p>Two</article>', "One Two"),
    ('<article><p class="ad">Buy<div>One</div>Two</article>', "One Two"),
    ('<article><ul><li class="ad">Buy<li>One<ul><li class=ad>Buy<li>Two</ul><li>Three</ul></article>', "One Two Three"),
    ('<article><aside>No<div class="share">No</aside><p>One</article>', "One"),
    ('<article><section><div class="share">No</section>One</article>', "One"),
    ('<ul><p class=ad>No<li>One</ul>', "One"), ('<nav><a>No</a> <a>No</a></nav>One', "One"),
    ('<dl><dt class="ad">No<dd>One<dt>Two</dl>', "One Two"),
    ('<table><tr class=ad><td>No<tr><td class="ad">No<td>One<tr><td>Two</table>', "One Two"),
    ('<table><tbody class=ad><tr><td>No<tbody><tr><td>One</table>', "One"),
    ('<datalist><option class=ad>No<option>One</datalist>', "One"),
    ('<table class=ad><tr><td><table><tr><td>No</table>No<tr><td>No</table><p>One', "One"),
    ('<div class=ad><p>No</span></p>No<div>No</div>No</div>One', "One"),
    ('<div class=ad><table><tr><td></div>No</table>No</div>One', "One"),
    ('<p>One <span class="ad">No</span> Two</p>', "One Two"), ('<b class=ad><p>No</b>One', "One"),
    ('<a class=share>No<a>One</a>', "One"), ('<form>No<form>No</form>One', "One"),
    ('<head><title>No</title><body><p>One', "One"), ('<head><meta x>One', "One"),
    ('<button>No<button>No</button>One', "One"), ('<h2 hidden>No<h3>One</h2>Two', "One Two"),
    ('<div><article>One</div><p>Two</article>No', "One Two"), ('<main><article>One</main>No', "One")])
def test_implied_ends(page, expected):
    lines = [(t, inside) for t, inside, around in differencing.lines_of(page) if not around]
    assert " ".join(t for t, inside in lines if inside or not any(i for _, i in lines)) == expected


def test_lines_of_inline_elements_stay_whole():
    assert differencing.lines_of("<nav><a>A</a> <a>B</a></nav><p>C <b>D</b>") == [("A B", False, True), ("C D", False, False)]


def test_open_elements_take_linear_time():
    for part in ("<div><li>", "<b><p></b>", "<p class=ad><div>", "<article><p class=ad>", "<table><td><a>", "</x><i>"):
        differencing.lines_of(part * 20_000 + "</div>" * 20_000)
    differencing.lines_of("<div>" * 20_000 + "<li></li><b></i>" * 20_000)


def test_alignment_is_a_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(400):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(0, 14))] for _ in range(2))
        found = differencing.aligned(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and all(a[i] in rest for i in found)
        assert len(found) == lcs(a, b)


def test_main_text(spark):
    site = "<div>Welcome to our site</div><div class='side-bar'>Links</div>"
    tail = "<div>All rights reserved</div><div id=comments><p>Nice!</p></div>"
    rows = [
        (1, "http://h.com/a/1", f"{site}<p>First\n page &amp; text</p>{tail}"),
        (2, "http://h.com/a/2", f"{site}<p>Second</p><h2>More <b>here</b></h2>{tail}"),
        (3, "http://h.com/b", "<nav>Menu</nav><article><header><h1>T</h1></header><p>x &lt; y<br>z"
                              "<script>if (a</p>b) x</script><aside>No</aside></article><footer>F</footer>"),
        (4, None, None), (5, "http://other.org/", ""), (6, "http://other.org/", "<p>copy</p>"),
        (7, "http://other.org/", "<p>copy</p>"), (8, "http://h.com/b", "<!-- <p>no</p> --><main><p>Main</main>"),
        (9, "http://long.org/", "<p>" + "many words " * 50_000 + "</p>" * 500)]
    got = {r.page_id: r for r in differencing.extract(pages(spark, rows)).collect()}
    expected = {1: "First page & text", 2: "Second\nMore here", 3: "T\nx < y z", 4: "", 5: "", 6: "copy",
                7: "copy", 8: "Main", 9: ("many words " * 50_000).strip()}
    assert {i: r.text for i, r in got.items()} == expected
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert differencing.extract(pages(spark, rows).limit(0)).count() == 0


def test_copies_have_the_nearest_different_page(spark):
    def page(own):
        return f"<div>Site</div><p>{own}</p><div>Rights</div>"

    # one run of copies over several parts, among others
    rows = [(k, f"http://h.com/a?page={k}", page("Copy")) for k in range(1, 41)]
    rows += [(50, "http://h.com/", page("Start")), (51, "http://h.com/b", page("End"))]
    got = {r.page_id: r.text for r in differencing.extract(pages(spark, rows)).collect()}
    assert got == {**dict.fromkeys(range(1, 41), "Copy"), 50: "Start", 51: "End"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_extract_matches_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = []
    for k in range(160):
        host = draw.choice(["a.com", "a.com", "b.com", "c.com"])
        lines = [draw.choice("vwxyz") for _ in range(draw.randrange(0, 5))]
        html = "".join(f"<p>{x}</p>" for x in ["Site", *lines, "Rights"])
        if draw.random() < 0.7 and rows:
            html = draw.choice(rows[-3:])[2]
        path = draw.choice(["/x", "/x", "/x/y", "/x/yz", "/z"])
        rows.append((k if k else None, draw.choice([f"http://{host}{path}?{k}"] * 20 + [None]), html))
    rows += [(k, f"http://d.com/{'p' if k < 230 else 'q'}", "<p>Site</p><p>Same</p>") for k in range(200, 260)]
    rows += [(k, f"http://d.com/{u}", f"<p>Site</p><p>{u}</p>") for k, u in ((199, "o"), (300, "qq"))]

    def where(row):
        rest = (row[1] or "").partition("://")[2].partition("?")[0]
        host, slash, tail = rest.partition("/")
        return host, slash + tail

    order = sorted(rows, key=lambda r: (*where(r), r[0] or -1))
    texts = [[t for t, _, _ in differencing.lines_of(r[2])] for r in order]
    expected = {}
    for i, row in enumerate(order):
        host, path = where(row)
        first, last = i, i
        while first and where(order[first - 1])[0] == host and texts[first - 1] == texts[i]:
            first -= 1
        while last + 1 < len(order) and where(order[last + 1])[0] == host and texts[last + 1] == texts[i]:
            last += 1
        near = [(differencing._alike(where(order[j])[1], where(order[end])[1]), -j)
                for j, end in ((first - 1, first), (last + 1, last))
                if 0 <= j < len(order) and host and where(order[j])[0] == host]
        shared = differencing.aligned(texts[i], texts[-max(near)[1]]) if near else []
        assert not near or len(shared) == lcs(texts[i], texts[-max(near)[1]])
        expected[row[0]] = "\n".join(t for k, t in enumerate(texts[i]) if k not in shared)
    got = {r.page_id: r.text for r in differencing.extract(pages(spark, rows).repartition(5)).collect()}
    assert got == expected


def vectors_by_force(rows, cosine=0.95):
    units = [covertree.unit(v) if i is not None else None for i, v in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = units[i], units[j]
        if a is not None and b is not None and len(a) == len(b) and float(a @ b) >= cosine:
            links[i] += 1
            links[j] += 1
            up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[root(i)].append(key)
    return sorted(((key, links[i], min(groups[root(i)]) if key is not None else None)
                   for i, (key, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("shelf", [40, 8192])
def test_vectors_match_brute_force(spark, shelf):
    draw = np.random.default_rng(4)
    rows = [(k, x.tolist()) for k, x in enumerate(draw.normal(size=(150, 6)))]
    near = draw.normal(size=6)
    rows += [(1000 + k, (near + 0.12 * draw.normal(size=6)).tolist()) for k in range(120)]
    rows += [(2000 + k, [0.0, 3.0 * (k + 1), 0, 0, 0, 0]) for k in range(40)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [1.0, None] * 3), (3004, [float("nan")] * 6),
             (3005, [float("inf")] * 6), (3006, [1.0, 1.0]), (3007, [2.0, 2.0]), (3008, [1e300] * 6),
             (3009, [1e-300] * 6), (None, [0.0, 1.0, 0, 0, 0, 0])]
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "x", 1)
                                for i, v in rows],
                               "vec_id bigint, embedding array<double>, name string, node int")
    got = covertree.near_vectors(df, sample=60, shelf=shelf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == vectors_by_force(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert covertree.near_vectors(table(spark, SF, "embeddings").limit(0)).count() == 0


def test_large_nodes_are_split_by_nets_of_their_own(spark, monkeypatch):
    """Tight groups under few top nodes: deeper levels prune, and change no result."""
    draw = np.random.default_rng(8)
    middles = draw.normal(size=(40, 6))
    x = np.repeat(middles / np.linalg.norm(middles, axis=1)[:, None], 12, axis=0)
    x = x + draw.normal(size=x.shape) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "vec_id bigint, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    met, real = [], covertree.staged

    def counted(frame, name):
        out = real(frame, name)
        if name == "meet":
            met.append(out.count())
        return out

    monkeypatch.setattr(covertree, "staged", counted)
    results = []
    for leaves in (4096, 0):
        monkeypatch.setattr(covertree, "LEAVES", leaves)
        rows = covertree.near_vectors(df, sample=3, shelf=24).collect()
        results.append(sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows))
        assert [r[1] for r in results[-1]] == (links.sum(1) - 1).tolist()
    assert results[0] == results[1]
    assert met[0] < 0.7 * met[1]
