"""Similarity, logs, stores, web, images, languages, sources and streams on small fixtures."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.operators import events, html, images, logs, similarity, stores, web
from tessella.plans import image_pipeline, predicate
from tessella.sources import pdf, tail
from tessella.streaming import bus


def test_similarity(spark):
    import re

    texts = ["the cat the cat the the dog", "a a a b a a", "", "One two one two three, one two!", "x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.i, r.j): r.strength for r in similarity.similar_pairs(d).collect()}
    want = {}
    for n, text in enumerate(texts):
        seq = re.split("[^a-z']+", text.lower())
        for i in range(len(seq)):
            for j in range(len(seq)):
                if i == j or seq[i] != seq[j]:
                    continue
                s = 0
                for w in (1, 2):
                    if j + w < len(seq):
                        s += 63 * (seq[j + w] == seq[j]) + 63 * (i + w < len(seq) and seq[j + w] == seq[i + w])
                    if j - w > 0:
                        s += 63 * (seq[j - w] == seq[j]) + 63 * (i - w > 0 and seq[j - w] == seq[i - w])
                if s:
                    want[n, i, j] = s
    assert got == want
    totals = {r.doc_id: r.strength for r in similarity.similarity_totals(d).collect()}
    assert totals == {n: sum(s for (m, _, _), s in want.items() if m == n) for n in range(len(texts))}


def test_mongo_logs(spark, tmp_path):
    lines = ["2020-01-02T03:04:05.678-0500 I NETWORK [conn 12] a.b c", "2020-01-02T03:04:05.678+0100 W - [x] ", "no record", "2020-02-02T03:04:05.678-0500 E COMMAND [y] z"]
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    rows = logs.find_logs(spark, str(tmp_path / "log")).collect()
    assert [(r.component, r.context, r.message) for r in rows if r.corrupt is None] == [("NETWORK", "conn12", "a . b c"), ("UNKNOWN", "x", ""), ("COMMAND", "y", "z")]
    assert [r.corrupt for r in rows if r.corrupt] == ["no record"]
    assert logs.find_logs(spark, str(tmp_path / "log"), {"date": ("2020", "02")}).count() == 1
    assert logs.find_logs(spark, str(tmp_path / "log"), {"severity": {"level": "W"}}).count() == 1
    assert logs.find_logs(spark, str(tmp_path / "log"), {"severity": {}}, middle_start=True).count() == 3
    with pytest.raises(Exception, match="not a log record"):
        logs.parse_mongo(spark.read.text(str(tmp_path / "log")), fail_fast=True).collect()


NODE = """tail of an earlier entry
2020-01-02 03:04:05 info: started up
2020-01-02 03:04:06 error[404] failed
Trace: {file: a.js, line: 3, url: }
Stack: TypeError: boom
    at f (/x/a.js:3:4)
2020-01-02 03:04:07 error: bad
TypeError [E_CODE]: x is null
    at f (/x/a.js:3:4)
    at g (/x/b.js:5:6)
Trace: t
Stack: s
2020-01-02 03:04:08 error: compile
/x/c.js line
SyntaxError: unexpected
  3 | let x
    at h (/x/c.js:7:8)
Trace: t
Stack: s"""


def test_node_logs(spark, tmp_path):
    (tmp_path / "log").write_text(NODE)
    rows = sorted(logs.find_logs(spark, str(tmp_path / "log"), parser="Node").collect(), key=lambda r: r.entry_num)
    assert [(r.entry_num, r.line_num, r.level, r.status) for r in rows] == [(1, 2, "info", "UNKOWN"), (2, 3, "error", "404"), (3, 7, "error", "UNKOWN"), (4, 13, "error", "UNKOWN")]
    assert rows[0].error is None
    assert rows[1].error.trace == {"file": "a.js", "line": "3", "url": "null"} and rows[1].error.name == "TypeError"
    assert rows[2].error.code == "E_CODE" and [(f.name, f.file, f.line) for f in rows[2].error.frames] == [("f", "/x/a.js", 3), ("g", "/x/b.js", 5)]
    assert rows[3].error.compile_time == "/x/c.js line" and rows[3].error.block == "3 | letx"
    find = lambda **w: [r.entry_num for r in logs.find_logs(spark, str(tmp_path / "log"), w, "node").collect()]
    assert find(error={"is_api_error": True}) == [2] and find(trace={"line": 3}) == [2] and find(error={"is_compile_time": True}) == [4]


def test_events(spark):
    d = spark.createDataFrame([(1, "Reverse", "abc", None), (2, "compress", "A b!", None), (3, "other", "xyz", 2)], "id long, type string, message string, stop int")
    rows = events.progress(d, "stop").orderBy("id", "step").collect()
    last = {r.id: r.message for r in rows if r.complete}
    assert last == {1: "cba", 2: "ab", 3: "yx"}
    assert [r.status for r in rows if r.id == 3] == ["RUNNING", "RUNNING", "CANCELED", "DONE"]
    assert spark.range(1).select(events.percent(F.lit(29), F.lit(100))).first()[0] == 28


def test_stores(spark, tmp_path):
    c = lambda rows: spark.createDataFrame(rows, "section string, entry string, value string")
    a, b = c([("S", "x", "1"), ("T", "y", "2")]), c([("s", "X", "9"), ("U", "z", "3")])
    merged, skipped = stores.merge(b, a)
    assert {tuple(r) for r in merged.collect()} == {("S", "x", "1"), ("T", "y", "2"), ("U", "z", "3")}
    assert {tuple(r) for r in skipped.collect()} == {("S", "x", "9")}
    again, _ = stores.merge(merged, merged)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in merged.collect()}
    stores.write_ini(merged, str(tmp_path / "c.ini"))
    assert {tuple(r) for r in stores.read_ini(spark, str(tmp_path / "c.ini")).collect()} == {tuple(r) for r in merged.collect()}
    skipped = stores.merge_files(spark, "[s]\nx = 9\n[u]\nq = 1\n", str(tmp_path / "c.ini"))
    assert [tuple(r) for r in skipped.collect()] == [("S", "x", "9")]
    assert stores.read_ini(spark, str(tmp_path / "c.ini")).count() == 4
    assert stores.get_entry(merged, "s", "X").first().value == "1"


def test_web(spark):
    page = '<article><span class="p__year">1969</span><a href="/x">Moon <b>day</b></a><a class="p__topic" href="/t">Space</a></article><h1>Head</h1><dl><dt>Author</dt><dd><a href="/me">Me</a></dd></dl><p>One <a href="/1">l</a></p>'
    quotes = '<a class="b-qt qt_1 oncl_q" href="#">Q one</a><a class="bq-aut qa_1 oncl_a" href="#">Ann</a><a class="b-qt qt_2 oncl_q" href="#">Q two</a><a class="bq-aut qa_2 oncl_a" href="#">Ann</a>'
    d = spark.createDataFrame([("u", page), ("/x", quotes), ("n", None)], "url string, html string")
    e = web.articles(d, "html", "url").collect()
    assert [(r.url, r.n, r.title, r.year, r.topic, r.link) for r in e] == [("u", 1, "Moon day", "1969", "Space", "/x")]
    f = web.features(d, "html", "url").where("url = 'u'").first()
    assert f.title == "Head" and f.citation["Author"].link == "/me" and f.body[0].links == ["/1"] and f.body[0].text == "One l"
    assert [tuple(r) for r in web.quotes_by_author(web.anchors(d, "html", "url"), "url").collect()] == [("/x", "Ann", "Q two")]
    assert web.features_of_first_articles(d).count() == 1


NESTED = """before<div class=x>out</i><article data-x="a > b"><p>One <b>two</b> &amp;lt; 1 < 2<article><p class='y'>inner <A HREF="/i">in</A><ul><li>a<li>b</ul></article>behind
</div></div><h1>H</h1><p>three<script>var p="</p><p>no";</script><!-- <p>no --> <a href=/q>four</a><div>five</div></article><p>last<dl><dt>T<dd>d one <a href="/t">t</a><dd>d two</dl><p>cut <style>p{"""


def test_nested_elements(spark):
    d = spark.createDataFrame([(1, NESTED), (2, "no tag"), (3, ""), (4, None), (5, "</p><p>x</p></p>y<p></p>")], "k int, html string")
    assert [(r.k, r.n, r.text, r.links) for r in web.paragraphs(d, "html", "k").orderBy("k", "n").collect()] == [
        (1, 1, "One two &lt; 1 < 2", []),
        (1, 2, "inner in", ["/i"]),
        (1, 3, "three four", ["/q"]),
        (1, 4, "last", []),
        (1, 5, "cut", []),
        (5, 1, "x", []),
        (5, 2, "", []),
    ]
    assert [(r.n, r.heading, r.paragraphs, r.title, r.link) for r in web.articles(d, "html", "k").orderBy("n").collect()] == [(1, "H", 2, "four", "/q"), (2, "", 1, "in", "/i")]
    assert [(r.n, r.term, r.text, r.link) for r in web.definitions(d, "html", "k").orderBy("n").collect()] == [(1, "T", "d one t", "/t"), (2, "T", "d two", None)]
    assert [r.text for r in html.elements(html.tags(d, "html", "k"), "li", "k").orderBy("n").collect()] == ["a", "b"]
    assert web.features(d, "html", "k").where("k = 1").first().citation["T"].text == "d two"


def image(spark, rows):
    return spark.createDataFrame([(1, x, y, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "k int, x int, y int, v int")


def grid(df, w):
    rows = {(r.x, r.y): r.v for r in df.collect()}
    return [[rows[x, y] for x in range(w)] for y in range(len(rows) // w)]


def test_images(spark):
    d = image(spark, [[0, 0, 0, 0], [0, 200, 200, 0], [0, 200, 200, 0], [0, 0, 0, 9]])
    assert grid(images.morph(d, "k", "open", 3), 4)[1][1] == 0
    assert grid(images.median_blur(d, "k", 3), 4)[1][1] == 0
    assert grid(images.gaussian_blur(d, "k", 3), 4)[0][0] > 0
    assert grid(images.bilateral_blur(d, "k", 3), 4)[1][1] > 100
    boxes = [(r.n, r.x0, r.y0, r.x1, r.y1) for r in images.contours(d, "k").orderBy("label").collect()]
    assert boxes == [(4, 1, 1, 2, 2), (1, 3, 3, 3, 3)]
    assert grid(images.rotate(d, "k", 90), 4)[0][3] == 9 or grid(images.rotate(d, "k", 90), 4)[3][0] == 9
    assert images.make_square(d, "k").count() == 36
    assert images.otsu(d, "k").first().threshold == 9
    assert grid(images.edges(d, "k", 300), 4)[0][0] == 0
    assert images.adaptive_threshold(d, "k", 3).count() == 16
    assert abs(images.skew_angle(image(spark, [[1, 0], [0, 1]]), "k").first().angle - 45) < 1e-6
    assert image_pipeline.operation("blur(size=3, name=a b)") == ("image", "blur", {"size": 3, "name": "a b"})
    assert image_pipeline.value("3x3") == "3x3" and image_pipeline.value("-1.5") == -1.5 and image_pipeline.value("(1, 2)") == (1, 2)
    assert image_pipeline.run(d, "k", ["blur(size=3)", "histogram()"]).count() == 256
    assert image_pipeline.run(d, "k", ["crop()"]).count() > 0 and image_pipeline.run(d, "k", ["document()"]).count() == 16
    rgb = spark.createDataFrame([(255, 0, 0), (0, 0, 255), (10, 10, 10)], "r int, g int, b int")
    assert [tuple(r) for r in images.convert_color(rgb, "rgb2hsv").collect()] == [(0, 255, 255), (120, 255, 255), (0, 0, 10)]
    assert [r.v for r in images.convert_color(rgb, "rgb2gray").collect()] == [77, 28, 10]
    ocr = spark.createDataFrame([("\t".join("5 1 1 1 1 1 10 20 30 40 91.5 word".split()),), ("short\tline",)], "value string")
    assert images.ocr_rows(ocr).first().box.width == 30


def test_predicates(spark):
    p = predicate.parse("run<1, 2, a, b>:\n a && b || !c stop")
    assert p["params"] == {"a": 1, "b": 2, "c": None} and p["output"] == ("or", ("and", ("id", "a"), ("id", "b")), ("not", ("id", "c")))
    rows = [(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)]
    d = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    got = {tuple(r) for r in predicate.where(d, "run: (a || b) && !c stop").collect()}
    assert got == {r for r in rows if (r[0] or r[1]) and not r[2]}
    for bad in ("run: a", "walk: a stop", "run<1 a>: a stop", "run: a && stop"):
        with pytest.raises(predicate.PredicateError):
            predicate.parse(bad)


def document():
    table = b"beginbfchar <01> <0041> endbfchar beginbfrange <02> <03> <0042> endbfrange"
    shown = zlib.compress(b"BT /F1 12 Tf (\\001\\002) Tj [(\\003) -5 <01>] TJ ET")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter [/FlateDecode] >>\nstream\n%s\nendstream" % (len(shown), shown), b"<< /Type /Font /ToUnicode 6 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(table), table)]
    out, offsets = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return out + b"trailer\n<< /Size 7 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % start


def test_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(document())
    assert [(r.page, r.seq, r.font, r.text) for r in pdf.read(spark, str(tmp_path)).orderBy("seq").collect()] == [(1, 0, "F1", "AB"), (1, 1, "F1", "C"), (1, 2, "F1", "A")]
    assert pdf.read(spark, str(tmp_path), "objects").count() == 6 and pdf.read(spark, str(tmp_path), "pages").first().strings == 3
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 1, 1, 1, 3, 2, 2, 2, 4, 1, 1, 1])
    assert pdf.undo_predictor(rows, 15, 1, 8, 3)[:9] == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4])
    assert pdf.canonical_codes([0, 2, 1], [7, 8, 9]) == {"00": 7, "01": 8, "100": 9}
    assert pdf.zigzag(3) == [0, 1, 3, 6, 4, 2, 5, 7, 8]
    assert [pdf.components(x) for x in ("DeviceRGB", ["DeviceN", ["a", "b"]], ["Indexed", "DeviceRGB"])] == [3, 2, 1]


def test_read_section(spark, tmp_path):
    path = str(tmp_path / "log")
    open(path, "w").write("one\ntwo\nthree\n")
    assert [r.line for r in tail.read_section(spark, path, 4, 7).collect()] == ["two"]


def test_sink(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)
    open(f"{source}/a.json", "w").write('{"author":"a","quote":"q"}\n{"author":"a","quote":"q"}\n{"author":"b","quote":"q"}\n')
    for n in range(2):
        stream = bus.insert_if_absent_sink(spark.readStream.schema("author string, quote string").json(source), target, str(tmp_path / f"c{n}"), "author", "quote").start()
        stream.processAllAvailable()
        stream.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [("a", "q"), ("b", "q")]


def test_line_numbers_over_blocks(spark, tmp_path):
    folder = tmp_path / "a data"
    folder.mkdir()
    want = []
    for name, n in (("x.log", 700), ("y.log", 3)):
        lines = [f"2024-01-02T03:04:05.006-0000 I NETWORK [conn{i}] {'word ' * (i % 9)}{i}" for i in range(n)]
        (folder / name).write_text("\n".join(lines))
        want += [(name, i + 1, f"conn{i}") for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = logs.find_logs(spark, str(folder), numbered=True)
        assert sorted((r.file.rsplit("/", 1)[1], r.line_num, r.context) for r in found.collect()) == want
        one = logs.find_logs(spark, str(folder), {"line_num": 2}).collect()
        assert sorted(r.context for r in one) == ["conn1", "conn1"]
        assert logs.find_logs(spark, str(folder), middle_start=True).count() == 701
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_similarity_totals(spark):
    rows = [(1, "a b a b, a c"), (2, ""), (2, "it's it's it's"), (None, "Aa aa 1 b"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for key, text in rows:
        one = spark.createDataFrame([(key or 0, text)], "doc_id int, text string")
        pairs = similarity.similar_pairs(one).agg({"strength": "sum"}).first()[0] or 0
        got = similarity.similarity_totals(one).collect()
        assert [r.strength for r in got] == ([] if text is None else [pairs])
    assert similarity.similarity_totals(docs).count() == 4


def test_similar_pairs_by_ranges(spark, monkeypatch):
    """Nothing is joined or gathered by the driver, and long texts are dealt out and paired in parts."""
    import pyarrow as pa

    texts = ["a a a b a a", "the cat the cat the the dog " * 5, "", "x y x y x"]
    d = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "a a"), (5, None)], "doc_id long, text string")
    pairs = similarity.similar_pairs(d)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    want = sorted(tuple(r) for r in pairs.collect())
    assert len(want) == len(set(want)) + len({r for r in want if r[0] == 3})  # the row with a known key is a text of its own
    monkeypatch.setattr(similarity, "ROW_PAIRS", 40)
    monkeypatch.setattr(similarity, "MOST_PAIRS", 30)
    monkeypatch.setattr(similarity, "MOST_BYTES", 20)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([0, 1, 2, 3, 3]), "text": pa.array([*texts, texts[3]])})
    dealt = list(similarity._dealt([batch]))
    assert sum(map(len, dealt)) > 8
    found = list(similarity._paired(dealt[::-1]))
    assert max(map(len, found)) < 200
    assert sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == want
