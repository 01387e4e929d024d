"""Column functions on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.operators import pack, paragraphs, site, tokens, translate


def one(spark, make, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(make(*[F.col(k) for k in values]).alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("Title..", "Title"), ("   ...   ", "document"), ("CON", "CON_"), ("com3", "com3_"), ("Company", "Company"), ("", "document"), ("com0", "com0"), ("LPT9", "LPT9_")])
def test_sanitize_name(spark, name, want):
    assert one(spark, T.sanitize_name, a=name) == want


def test_normalize_lines(spark):
    text = "A\r\nB\rC\u0085D\u2028E\u2029F\u000bG\fH"
    assert one(spark, T.normalize_lines, a=text) == "A\nB\nC\nD\nE\nF\nG\nH"
    assert one(spark, lambda c: T.normalize_lines(c, True), a=text) == "A\nB\nC\nD\nE\nF\nG\fH"


@pytest.mark.parametrize(("start", "target", "want"), [("OEBPS/text", "OEBPS/text/b.html", "b.html"), ("OEBPS/text", "index.html", "../../index.html"), (".", "a/b.html", "a/b.html"), ("", "b.html", "b.html"), ("a", "b/c.html", "../b/c.html"), ("a/b", "a/c/d.html", "../c/d.html")])
def test_relative_path(spark, start, target, want):
    assert one(spark, T.relative_path, a=start, b=target) == want


@pytest.mark.parametrize(("href", "n", "want"), [("ch_02_intro.xhtml", 2, "2. ch 02 intro"), ("x/part-one.html", 1, "1. part one"), (".html", 3, "Chapter 3")])
def test_chapter_label(spark, href, n, want):
    assert one(spark, T.chapter_label, a=href, b=n) == want


@pytest.mark.parametrize(("text", "indent", "want"), [("LITTLE TOKYO", 0, "h2"), ("A short line", 20, "h2"), ("nine words that stand far from the left margin", 20, "h3"), ("1234", 0, "p"), ("plain words", 2, "p")])
def test_classify_block(spark, text, indent, want):
    assert one(spark, T.classify_block, a=text, b=indent) == want


def test_garbage(spark):
    assert one(spark, T.is_garbage, a="if lf if if if if if")
    assert not one(spark, T.is_garbage, a="if lf if")
    assert not one(spark, T.is_garbage, a="plain words of a text")


@pytest.mark.parametrize(("name", "want"), [("book_7_Im0.png", 7), ("book_99_Im0.png", 0), ("book_x_3.png", 3), ("7.png", 0), ("a_b_8_c.png", 8)])
def test_image_page_no(spark, name, want):
    assert one(spark, lambda c: T.image_page_no(c, F.lit(10)), a=name) == want


def test_echo(spark):
    assert one(spark, T.is_echo, a="", b="short")
    assert not one(spark, T.is_echo, a="short", b="short")
    assert one(spark, T.is_echo, a=" HELLO WORLD ", b="hello world")


def test_paragraphs(spark):
    assert one(spark, paragraphs.paragraph_array, a="a\nb\n\n c \n \n\nd") == ["a b", "c", "d"]
    assert one(spark, paragraphs.paragraph_array, a="a\n \nb\n") == ["a", "b"]
    assert one(spark, lambda c: paragraphs.paragraph_array(c, "blank"), a="a\n \nb\n") == ["a", "b"]
    assert one(spark, paragraphs.paragraph_array, a="") == []


def test_thirty_five_paragraphs_are_two_pages(spark):
    df = spark.createDataFrame([(1, "\n".join(f"p{i}" for i in range(35)))], "id int, text string")
    for counted in (False, True):
        got = paragraphs.paginate(paragraphs.paragraphs(df, ["id"], counted=counted), ["id"]).groupBy("page_no", "total_pages").count().orderBy("page_no").collect()
        assert [tuple(r) for r in got] == [(1, 2, 30), (2, 2, 5)]


@pytest.mark.parametrize(("sizes", "groups"), [([0, 12, 5, 5, 3], [0, 1, 2, 2, 3]), ([5, 5, 3, 3], [0, 0, 1, 1]), ([], []), ([20, 20], [0, 1]), ([0, 0, 11], [0, 0, 1])])
def test_greedy(spark, sizes, groups):
    assert list(pack.greedy_groups(sizes, 10)) == groups
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "k int, o int, s int")
    assert [r.group_no for r in pack.greedy_pack(df, ["k"], "o", "s", 10).orderBy("o").collect()] == groups


def test_runs_compose_to_sequential_packing():
    """Summaries of pieces, applied one after another, lead to the groups of one pass over all items."""
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(1500):
        limit, n = rng.choice([0, 1, 5, 10, 50]), rng.randint(0, 30)
        sizes = [rng.choice([0, 0, 1, 2, 3, 7, 12, 60]) for _ in range(n)]
        cuts = sorted(rng.randint(0, n) for _ in range(rng.randint(0, 4)))
        want, group, total = list(pack.greedy_groups(sizes, limit)), None, 0
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            if a < b:
                group, total = pack.after(pack.summary(np.array(sizes[a:b]), limit), group, total, limit)
                assert (group, total) == (want[b - 1], sum(s for s, g in zip(sizes[:b], want[:b], strict=True) if g == want[b - 1]))


def test_one_key_is_packed_in_several_tasks(spark):
    rows = [("hot", n, n * 7919 % 101) for n in range(6000)] + [(k, n, 40) for k in ("a", "z", None) for n in range(5)]
    df = spark.createDataFrame(rows, "k string, o int, s int")
    packed = pack.greedy_pack(df.repartition(3), ["k"], "o", "s", 100)
    got = packed.withColumn("task", F.spark_partition_id()).collect()
    for key in ("hot", "a", "z", None):
        own = sorted((r.o, r.s, r.group_no) for r in got if r.k == key)
        assert [g for _, _, g in own] == list(pack.greedy_groups([s for _, s, _ in own], 100))
    assert len({r.task for r in got if r.k == "hot"}) > 1


def test_a_key_of_several_whole_batches_is_packed(spark):
    """In ranges of over 10,000 rows of a key a whole Arrow batch begins and ends within it."""
    df = spark.range(100_000).selectExpr("0 as k", "id as o", "cast(id % 13 as int) as s")
    got = pack.greedy_pack(df, ["k"], "o", "s", 100).orderBy("o").collect()
    assert [r.group_no for r in got] == list(pack.greedy_groups([i % 13 for i in range(100_000)], 100))


def test_numbers_of_a_key_that_lies_in_several_ranges(spark):
    from bindery.operators.ranks import numbered

    rows = [("hot", n * 3 % 4001, f"v{n}") for n in range(4001)] + [(k, n, f"{k}{n}") for k in ("a", None, "z") for n in range(3)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would go to one task
    try:
        got = numbered(df, ["k"], ["o"], ["v"], total="all", ranges=6).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and len({r.task for r in got if r.k == "hot"}) > 1
    for key in ("hot", "a", "z", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: r.o)
        values = [r.v for r in own]
        assert [(r.n, r.all) for r in own] == [(n, len(own)) for n in range(1, len(own) + 1)]
        assert [r.prev_v for r in own] == [None, *values[:-1]] and [r.next_v for r in own] == [*values[1:], None]


def test_ids_come_back_from_the_backend_as_they_were(spark):
    """64-bit hashes beside nulls, in translation and in asking again."""
    rows = [(9007199254740993, 0, "some text here"), (None, 0, "other text here"), (-(1 << 62) - 1, 1, "more text here")]
    df = spark.createDataFrame(rows, "book_id long, seq int, text string").coalesce(1)
    done = translate.translate_packed(df, lambda ts, a, b: ts, "en", "de", ["book_id"])
    again = translate.retry_echoes(done, lambda ts, a, b: ["S:" + t for t in ts], "en", "de").collect()
    assert {r.book_id: (r.translated, r.tries) for r in again} == {b: ("S:" + t, 1) for b, _, t in rows}


@pytest.mark.parametrize(("translated", "original"), [("", "short"), (None, "short"), ("short", "short"), ("\u00a0Hello World ", "hello world"), ("STRASSE der Welt", "straße der Welt"), ("Ähnliche Wörter", "ähnliche wörter"), ("a", "b" * 20), ("\u3000", "long enough text")])
def test_echoes_have_one_definition(spark, translated, original):
    df = spark.createDataFrame([(translated, original)], "t string, o string")
    assert df.select(T.is_echo(F.col("t"), F.col("o"))).first()[0] == T.echoes(translated, original)


def test_pages_are_judged_by_their_own_segments(spark):
    segments = spark.createDataFrame([(p, n) for p in (1, 2, 3) for n in (0, 1)], "page_id int, seq int")
    done = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", None), (2, 0, "a", "E"), (2, 1, "b", "E"), (3, 0, "a", None)], "page_id int, seq int, text string, error string")
    got = {r.page_id: (r.failed, r.status) for r in translate.page_status(segments, done, ["page_id"]).collect()}
    assert got == {1: (0, "ok"), 2: (2, "original"), 3: (1, "partial")}


@pytest.mark.parametrize(("link", "want"), [
    ('<a href="ch1.xhtml">', '<a href="ch1.html">'), ("<a href='../text/ch1.xhtml#top'>", "<a href='ch1.html#top'>"), ("<a href=./ch1.xhtml?q=1#t>", '<a href="ch1.html?q=1#t">'), ('<img SRC = "../img/%61b.xhtml">', '<img SRC = "../img/ab.html">'),
    ('<img srcset="ch1.xhtml 1x, ../img/ab.xhtml 2x">', '<img srcset="ch1.html 1x, ../img/ab.html 2x">'), ('<a href="/text/ch1.xhtml">', None), ('<a href="http://x/text/ch1.xhtml">', None), ('<a href="#ch1.xhtml">', None), ('<a title="href=ch1.xhtml" href="ch2.xhtml">', None),
    ("<p>ch1.xhtml</p>", None), ("<script>a.href='ch1.xhtml'</script>", None), ("<!-- <a href='ch1.xhtml'> -->", None), ('<a href="../ch1.xhtml">', None), ('<a href="&#99;h1.xhtml">', '<a href="ch1.html">'), ('<a href="../../text/ch1.xhtml">', None),
])
def test_links_follow_by_folder(spark, link, want):
    from bindery.operators import books

    manifest = spark.createDataFrame([(1, 1, "a", "text/ch1.xhtml", "text/html"), (1, 2, "b", "img/ab.xhtml", "text/html"), (2, 1, "a", "text/ch2.xhtml", "text/html")], "book_id int, pos int, item_id string, href string, media_type string")
    pages = spark.createDataFrame([(1, "text/ch9.xhtml", f"<body>{link}"), (1, "text/ch8.xhtml", None)], "book_id int, href string, html string")
    assert {r.href: r.html for r in books.normalize_hrefs(manifest, pages)[1].collect()} == {"text/ch9.xhtml": f"<body>{want or link}", "text/ch8.xhtml": None}


def test_contents_in_parts(spark):
    spine = spark.createDataFrame([("b", n, f"c{n}.html", "", f"says {n}") for n in range(1, 8)] + [("one", 1, "x.html", "", "")], "book_id string, spine_pos int, href string, base_path string, snippet string")
    titles = spark.createDataFrame([("b", "T & t")], "book_id string, title string")
    got = {(r.book_id, r.part): r for r in site.build_index(spine, titles, entries=3).collect()}
    assert set(got) == {("b", 1), ("b", 2), ("b", 3), ("one", 1)}
    assert got["b", 2].html.count("<p><a") == 3 and 'rel="prev" href="index.html"' in got["b", 2].html and 'rel="next" href="index_3.html"' in got["b", 2].html
    assert "T &amp; t" in got["b", 1].html and 'rel="prev"' not in got["b", 1].html and "7. says 7" in got["b", 3].html
    assert 'url=x.html' in got["one", 1].html


def test_segments_skip_code(spark):
    page = "<title>T &amp; t</title><body>a<script>var t='</p>'</script><pre>no<code>no</code></pre><p> b <!-- no --><i>c</i></p>"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    assert [r.text for r in tokens.extract_segments(df, ["id"]).orderBy("seq").collect()] == ["T & t", "a", "b", "c"]
    tm = spark.createDataFrame([("b", "<B>"), ("no", "wrong"), ("c", "")], "text string, translated string")
    assert tokens.apply_translations(df, tm, ["id"]).first()["html"] == page.replace(" b ", " &lt;B&gt; ")


def test_snippet(spark):
    text = '<body><div class="page-header">No. No.</div><p>One. Two! Three.</p></body>'
    assert one(spark, site.snippet, a=text) == "One. Two!"
    assert one(spark, site.snippet, a="<body>" + "x" * 350).endswith("x…")
    assert one(spark, site.snippet, a="<body><script>a</script></body>") == ""


def test_parse_reply(spark):
    reply = "1. one\n 2.  two \n2. again\n3.\n4. y\n9. out"
    assert one(spark, lambda c: translate.parse_reply(c, F.lit(4)), a=reply) == ["one", "again", "4. y", ""]


@pytest.mark.parametrize(("html", "texts"), [
    ("<p>1 < 2 and more</p>", ["1 < 2 and more"]), ("<p title=\"a>b c\">x</p>", ["x"]), ("a << b <3 <i>c</i>", ["a << b <3", "c"]), ("x <!-- a > b --> y", ["x", "y"]), ("<?xml v='1'?>t</ >u", ["t", "u"]),
    ("<p>It&#8217;s &#x41; &eacute; &amp;lt; &bogus; &#150; &#0;</p>", ["It’s A é &lt; &bogus; – \ufffd"]), ("t <", ["t <"]), ("a<br/>b<a href='>'>c", ["a", "b", "c"]), ("<p it's>d</p>", ["d"]),
    ("<a href=x title=it's>link text</a><p>more</p><p>isn't it</p>", ["link text", "more", "isn't it"]), ('<a title="open>one</a> two', ["one", "two"]), ("<a b=c'd>e'>f", ["e'>f"]), ("<a =x>y", ["y"]), ("<p/class='a>b'>c", ["c"]),
    ("<!-->a<!--->b<!--c--!>d", ["a", "b", "d"]), ("<SCRIPT>a</scripts>b</script >c<scripts>d", ["c", "d"]), ("</>a</p >b</", ["a", "b</"]), ("<style/>a</style>b", ["b"]),
    ("<div><pre>x</div>y<p><code>z<p>w</code>v", ["y", "w", "v"]), ("<pre>a<pre>b</pre>c</pre>d", ["d"]), ("<code>a<code>b</code>c</code>d", ["d"]), ("<code><p>a</code>b</p>c", ["b", "c"]), ("\u00a0a&nbsp;<b> &nbsp;</b>", ["a"]),
])
def test_segments_of_odd_markup(spark, html, texts):
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert [r.text for r in tokens.extract_segments(df, ["id"]).orderBy("seq").collect()] == texts
    assert "".join(r.raw for r in tokens.html_tokens(df, ["id"]).orderBy("pos").collect()) == html
    assert tokens.apply_translations(df, spark.createDataFrame([], "text string, translated string"), ["id"]).first()["html"] == html


@pytest.mark.parametrize(("body", "blocks"), [
    ("<p>a<p>b<p>c", ["<p>a", "<p>b", "<p>c"]), ("<p>a <b>x</b> y<p>b</p>loose<div>d<p>e<p>f</div><p>g", ["<p>a <b>x</b> y", "<p>b</p>", "loose", "<div>d<p>e<p>f</div>", "<p>g"]),
    ("<p>a<h2>b</h2>c", ["<p>a", "<h2>b</h2>", "c"]), ("<ul><li>a<li>b</ul><hr>x", ["<ul><li>a<li>b</ul>", "<hr>", "x"]), ("<p>a<br>b</p><p>c", ["<p>a<br>b</p>", "<p>c"]),
    ("<table><tr><td>a<td>b</table><p>x", ["<table><tr><td>a<td>b</table>", "<p>x"]), ("<div><b>a</div><p>c<p>d", ["<div><b>a</div>", "<p>c", "<p>d"]), ("<table><tr><th>a<tr><th><table><tr><td>b</table>c</table><i>x</i>y", ["<table><tr><th>a<tr><th><table><tr><td>b</table>c</table>", "<i>x</i>", "y"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>t", ["<ul><li>a<ul><li>b</ul><li>c</ul>", "t"]), ("<b><p>a</b>b</p><p>c", ["<b><p>a</b>b</p>", "<p>c"]), ("<dl><dt>a<dd>b<dt>c</dl>d", ["<dl><dt>a<dd>b<dt>c</dl>", "d"]),
    ("<p>a<div>b</div>c</p>d", ["<p>a", "<div>b</div>", "c</p>", "d"]), ("<span><div>a</span>b</div>c</span><h1>t<h2>u</h1>v", ["<span><div>a</span>b</div>c</span>", "<h1>t", "<h2>u</h1>", "v"]), ("</div>a</td><!-- n --><hr> b", ["a</td><!-- n -->", "<hr>", " b"]), ("<table><td>a<tr><td>b</td></tr></table>c", ["<table><td>a<tr><td>b</td></tr></table>", "c"]),
])
def test_blocks_without_end_tags(spark, body, blocks):
    df = spark.createDataFrame([(1, f"<body>{body}</body>")], "id int, html string")
    assert [r.html for r in tokens.body_blocks(df, ["id"]).orderBy("block_no").collect()] == blocks


@pytest.mark.parametrize(("page", "texts"), [
    ("<p>" + "a < b " * 1000, 1), ("<" * 1_000_000, 1), ("<p>" + "a < b " * 800_000, 1), ("<p " + "a='x>y' " * 100_000 + ">t", 1), ("<p " + "a=it's " * 700_000 + ">t", 1), ('<a b="' * 800_000, 0), ("<script " * 600_000, 0), ("<script>" + "</scrip" * 700_000, 0),
    ("<!--" + "--" * 500_000, 0), ("<div>" * 60_000 + "t", 1), ("<x><div>" + "<b>" * 600 + "</x>" * 8_000 + "t", 1), ("<body " + "a='x>y' " * 100_000 + ">t", 1), ("&amp;" * 200_000, 1), ("<p>x</p>" * 30_000, 30_000),
])
def test_large_and_hostile_pages(spark, page, texts):
    """Pages of up to 5 MB: no overflow, every text, time in proportion to the page."""
    import time

    df = spark.createDataFrame([(1, page)], "id int, html string")
    began = time.time()
    assert tokens.extract_segments(df, ["id"]).count() == texts
    assert tokens.text_len(df, ["id"]).first()["text_len"] >= 0 and tokens.body_blocks(df, ["id"]).count() >= 0
    assert one(spark, site.snippet, a=page) is not None
    assert time.time() - began < 40


def test_segments_come_back_between_their_blanks(spark):
    page = "<p>\u00a0 one&nbsp;<b>\n&lt;two&gt; </b><pre>one</pre><code>one</code><script>one</script>"
    df = spark.createDataFrame([(1, page), (None, page), (2, None), (3, "none")], "id int, html string")
    tm = spark.createDataFrame([("one", "1 & <1>"), ("<two>", "2"), ("none", "")], "text string, translated string")
    got = {r.id: r.html for r in tokens.apply_translations(df, tm, ["id"]).collect()}
    want = "<p>\u00a0 1 &amp; &lt;1&gt;\u00a0<b>\n2 </b><pre>one</pre><code>one</code><script>one</script>"
    assert got == {1: want, None: want, 2: None, 3: "none"}


def test_null_pages_have_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, html string")
    assert tokens.html_tokens(df, ["id"]).count() == tokens.body_blocks(df, ["id"]).count() == tokens.extract_segments(df, ["id"]).count() == 0
    assert {r.id: r.text_len for r in tokens.text_len(df, ["id"]).collect()} == {1: None, 2: 0}
    assert [(r.id, r.html) for r in pack.split_pages(df, ["id"]).collect()] == [(2, "")]


def test_pages_without_end_tags_are_split(spark):
    df = spark.createDataFrame([(1, "<head></head><body>" + "".join(f"<p>{c * 30}" for c in "abcd") + "</body>")], "id int, html string")
    parts = pack.split_pages(df, ["id"], 60).orderBy("chunk").collect()
    assert [(c * 30 in r.html) for r in parts for c in "abcd"] == [True, True, False, False, False, False, True, True]


def test_injection(spark):
    df = spark.createDataFrame([(1, "<head>" + "\u0130" * 4 + "</HEAD><body class='a>b'>x"), (2, "<p>no bar</p>")], "id int, html string")
    bars = spark.createDataFrame([(1, None, "n.html", "index.html", 1, 2)], "id int, prev_href string, next_href string, index_href string, current int, total int")
    got = {r.id: r.html for r in site.inject_nav(df, bars, ["id"], "[CSS]").collect()}
    assert got[2] == "<p>no bar</p>"
    assert got[1].startswith("<head>" + "\u0130" * 4 + "[CSS]</HEAD><body class='a>b'><nav") and got[1].endswith("</nav>x")


def test_groups_of_null_and_nan_keys(spark):
    rows = [(None, float("nan"), 0, 5), (None, float("nan"), 1, 5), (None, float("nan"), 2, 5), (1, 1.0, 0, None), (1, 1.0, 1, 10), (1, 1.0, 2, 1)]
    df = spark.createDataFrame(rows, "k int, f double, o int, s int")
    assert sorted((str(r.k), r.o, r.group_no) for r in pack.greedy_pack(df, ["k", "f"], "o", "s", 10).collect()) == [("1", 0, 0), ("1", 1, 0), ("1", 2, 1), ("None", 0, 0), ("None", 1, 0), ("None", 2, 1)]


def test_batches_are_called_once_and_in_order(spark):
    """Batches of several pages with equal numbers stay apart, also over the borders of Arrow batches."""
    rows = [(p, b, 9 - k, f"{p}-{b}-{9 - k}") for p in (None, 1, 2) for b in (0, 1) for k in range(10)]
    df = spark.createDataFrame(rows, "page int, batch_no int, seq int, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        done = translate.translate(df, lambda ts, a, b: ["|".join(ts)] * len(ts), "en", "de", ["page", "batch_no"], "seq", parallel=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(done) == len(rows)
    assert all(r.translated == "|".join(f"{r.page}-{r.batch_no}-{k}" for k in range(10)) for r in done)


def test_bounded_calls_are_many_small_tasks(spark, tmp_path):
    """One call at a time, and none of the tasks holds the table."""
    import os
    import time

    def backend(texts, src, dst):
        began = time.time()
        time.sleep(0.01)
        with open(tmp_path / f"{os.getpid()}-{time.time_ns()}", "w") as f:
            f.write(f"{began} {time.time()}")
        return texts

    rows = [(p, n, f"{p} {n}") for p in range(12) for n in range(3)]
    done = translate.translate(spark.createDataFrame(rows, "page int, seq int, text string"), backend, "en", "de", ["page"], "seq", parallel=1, pieces=6)
    assert sorted(tuple(r)[:3] for r in done.collect()) == rows and all(r.translated == r.text for r in done.collect())
    calls = sorted(tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir())
    assert len(calls) == 12 and all(a[1] <= b[0] for a, b in zip(calls, calls[1:], strict=False))
    assert len(done.inputFiles()) >= 4


@pytest.mark.parametrize("gaps", [True, False])
def test_large_layouts_give_what_windows_give(spark, gaps):
    import random

    rng = random.Random(4)
    rows = [(k, n, f"{k}{n}", 9000.0 - 12 * n - 10 * (n // rng.choice([3, 4])) if gaps else 5.0, rng.choice([72.0, 72.0, 90.0, 75.0])) for k, size in (("a", 900), ("b", 5), ("c", 1)) for n in range(size)]
    df = spark.createDataFrame(rows, "k string, row_no int, text string, y double, first_x double").repartition(4)
    got = [sorted(map(tuple, paragraphs.rows_to_paragraphs(df, ["k"], n).collect())) for n in (10**6, 3, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def test_observed(spark, tmp_path):
    from pyspark.sql import Observation

    done = spark.createDataFrame([("abc", None), ("de", "failed")], "text string, error string")
    watch = Observation("translation")
    translate.observed(done, watch).write.parquet(str(tmp_path / "out"))
    assert watch.get == {"texts": 2, "failed": 1, "bytes": 5}


def test_retry():
    waits, calls = [], []

    def backend(texts, src, dst):
        calls.append(1)
        if len(calls) < 3:
            raise translate.BackendError("busy", 429)
        return texts

    assert translate.with_retry(backend, sleep=waits.append)(["a"], "en", "de") == ["a"]
    assert waits == [1.0, 2.0]
    with pytest.raises(translate.BackendError):
        translate.with_retry(lambda *a: (_ for _ in ()).throw(translate.BackendError("no", 403)), sleep=waits.append)(["a"], "en", "de")
    assert waits == [1.0, 2.0]


def test_batch_corpus(spark):
    df = spark.createDataFrame([("a" * 300,), ("b" * 300,), ("a" * 300,)], "text string")
    got = pack.batch_corpus(df, 1, 500).orderBy("text").collect()
    assert [(r.text[0], r.batch_no) for r in got] == [("a", 0), ("b", 1)]


def test_entities_of_a_page_are_decoded_once_each(spark):
    """All kinds, and 20,000 of them in one text: in time that doesn't grow with their square."""
    import time

    kinds = {"&amp;lt;": "&lt;", "&#65;": "A", "&#x1F600;": "😀", "&#XE9;": "é", "&#0;": "�", "&#xD800;": "�", "&#999999999;": "�", "&#xFFFFFFFF;": "�", "&#150;": "–", "&eacute;": "é", "&apos;": "'", "&nope;": "&nope;", "& ;": "& ;", "&#;": "&#;"}
    assert one(spark, T.decode_entities, a="|".join(kinds)) == "|".join(kinds.values())
    began = time.time()
    assert one(spark, T.decode_entities, a="x&amp;y&#66;" * 10_000) == "x&yB" * 10_000
    assert time.time() - began < 60


def test_words_in_any_order_become_rows_with_few_bytes_shuffled(spark):
    rows = [(d, r, n, w, 5.0 * n, 9.0 - r) for d in (1, None) for r in (0, 1) for n, w in enumerate(["", " a", "b", "a", None, "c "])]
    df = spark.createDataFrame(rows, "k int, row_no int, word_no int, word string, x double, y double")
    want = sorted((str(d), r, "a b a c", 9.0 - r, 0.0) for d in (1, None) for r in (0, 1))
    for own in (df, df.orderBy(F.desc("word_no"), "row_no"), df.orderBy(F.xxhash64("word_no", "row_no", "k")).repartition(5)):
        got = paragraphs.words_to_rows(own, ["k"])
        assert sorted((str(x.k), x.row_no, x.text, x.y, x.first_x) for x in got.collect()) == want
    # words that lie together are one row before the shuffle
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
