"""Golden inputs for every reader."""

import csv
import io
import json
import random

from pyspark.sql import functions as F

from lorewell.functions import rules
from lorewell.sources import layout, manifest, markup, plain, records, registry, transcripts
from lorewell.sources.decode import readable


def _docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("doc_id", "seq").collect()]


def test_plain_paragraphs(spark):
    df = plain.text_blocks(_docs(spark, "One\nstill one\n \t\nTwo\n\n\n" + chr(0xA0) + "\n\nThree" + chr(0x2003), "  "))
    assert _rows(df, "doc_id", "text") == [("0", "One\nstill one"), ("0", "Two"), ("0", "Three")]


def test_markdown_kinds_sections_and_line_breaks(spark):
    text = "intro\r\n# A *b*  \r\n- one\r* two" + chr(0x2028) + "3. three\x0b#nospace\n####### seven\n  ###### Deep\ttitle\nlast\n#\n# \n12) no"
    got = _rows(plain.markdown_blocks(_docs(spark, text)), "kind", "text", "heading_level", "section_title")
    assert got == [
        ("paragraph", "intro", None, None), ("heading", "A *b*", 1, "A *b*"), ("list_item", "one", None, "A *b*"),
        ("list_item", "two", None, "A *b*"), ("list_item", "three", None, "A *b*"), ("paragraph", "#nospace", None, "A *b*"),
        ("paragraph", "####### seven", None, "A *b*"), ("heading", "Deep\ttitle", 6, "Deep\ttitle"),
        ("paragraph", "last", None, "Deep\ttitle"), ("paragraph", "#", None, "Deep\ttitle"), ("paragraph", "#", None, "Deep\ttitle"),
        ("paragraph", "12) no", None, "Deep\ttitle"),
    ]
    start = plain.markdown_blocks(_docs(spark, "## First\n## Second\nx"))
    assert _rows(start, "kind", "section_title") == [("heading", "First"), ("heading", "Second"), ("paragraph", "Second")]


HTML = """<html><head><title>T</title><style>p{}</style></head><body><nav><p>menu</p></nav>
<h2>Head &amp; <i>more</i></h2><p>a <b>b</b><!-- c --> d<p>open<ul><li>item <p>inner</p></li><li>two</ul>
<table><tr><th>k</th><th> v </th></tr><tr><td></td><td> </td></tr><tr><td>1<td><p>x</p></tr></table>
<h1> </h1><div>lost</div><p>end</p><script>var t = "</p><p>no</p>";</script><footer><p>foot</p></footer></body></html>"""


def test_html(spark):
    docs = _docs(spark, HTML)
    got = _rows(readable(markup.html_blocks(docs, "text")), "kind", "text", "heading_level", "section_title")
    h = "Head &more"
    assert got == [
        ("heading", h, 2, h), ("paragraph", "abd", None, h), ("paragraph", "open", None, h), ("list_item", "iteminner", None, h),
        ("paragraph", "inner", None, h), ("list_item", "two", None, h), ("table", "k | v\n1 | x", None, h), ("paragraph", "x", None, h),
        ("paragraph", "end", None, h),
    ]
    plainer = _rows(readable(markup.html_blocks(docs, "text", compat=False)), "kind", "text")
    assert plainer == [
        ("heading", "Head & more"), ("paragraph", "a b d"), ("paragraph", "open"), ("list_item", "item inner"), ("list_item", "two"),
        ("table", "k | v\n1 | x"), ("paragraph", "end"),
    ]


def test_xml(spark):
    body = "".join(f"<i>{n}</i>" for n in range(60))
    doc = f'<r xmlns="urn:x" xmlns:p="urn:p">top<!-- no --><p:a> first </p:a>tail<b/>{body}</r>'
    out = _rows(markup.xml_blocks(_docs(spark, doc, "<broken")), "doc_id", "kind", "text", "error")
    lines = ["r: top", "a: first"] + [f"i: {n}" for n in range(60)]
    assert out[0][1:3] == ("paragraph", "\n".join(lines[:50])) and out[1][2] == "\n".join(lines[50:])
    assert out[2][0] == "1" and out[2][1] is None and out[2][3].startswith("Could not parse XML")
    long = _rows(markup.xml_blocks(_docs(spark, "<r>" + "<i>a &amp; b</i>" * 5001 + "</r>")), "text", "error")
    assert sum(r[0].count("\n") + 1 for r in long) == 5001 and long[0][0].startswith("i: a & b")
    odd = _docs(spark, '<?xml version="1.0" encoding="shift_jis"?><a>x</a>', "<a><!-- <b>no</b> --><c k='1'/>t<d>y</d></a>", "plain", "<a><![CDATA[raw]]></a>")
    assert _rows(markup.xml_blocks(odd), "doc_id", "text", "error") == [
        ("0", None, "Could not parse XML: encoding shift_jis"), ("1", "d: y", None), ("2", None, "Could not parse XML: tags do not balance"), ("3", "a: raw", None)]


def test_xml_raw_data_entities_quotes_and_encoding(spark):
    docs = _docs(spark, "<a><![CDATA[<p>x &amp; <!-- y -->]]></a>", "<a>caf&#233; &#xE9; &#x1F600; &amp;#233; &#38;lt; &#0;</a>", "<a k='1 > 0' j=\"<b>\">t</a>")
    assert _rows(markup.xml_blocks(docs), "text", "error") == [
        ("a: <p>x &amp; <!-- y -->", None), ("a: café é " + chr(0x1F600) + " &#233; &lt; &#0;", None), ("a: t", None)]
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><a>café</a>'.encode("latin-1")
    blocks, failed = registry.route(spark.createDataFrame([("x", "xml", latin)], "doc_id string, file_type string, content binary"))
    assert [r.text for r in blocks.collect()] == ["a: café"] and failed.count() == 0


def test_xml_that_is_not_well_formed(spark):
    texts = {"<r><a><b>t</a></b></r>": "tags do not balance", "<r><a x=1>t</a></r>": "a tag is not well-formed", "<r>a</r><q>b</q>": "more than one root", "x<r/>": "tags do not balance", "<r/>x": "text outside the root",
             "<r><a>": "tags do not balance", "</r>": "tags do not balance", "": "no root", "<r>a & b</r>": "an ampersand stands alone", "<r>a &nbsp; b</r>": "an ampersand stands alone",
             "<r a='1'b='2'/>": "a tag is not well-formed", "<r>< a></r>": "a tag is not well-formed", "<r>1 < 2</r>": "a tag is not well-formed"}
    got = dict(_rows(markup.xml_blocks(_docs(spark, *texts)), "doc_id", "error"))
    assert got == {str(i): "Could not parse XML: " + why for i, why in enumerate(texts.values())}
    fine = _docs(spark, "<?xml version='1.0'?>\n<!-- c --><a:r a='1' b=\"2>3\"><n.x/>\n<k>v</k ></a:r >\n<!-- d -->", "<r " + " ".join(f"a{i}='{i}'" for i in range(500)) + "><b>" + "<c>1</c>" * 3000 + "</b></r>")
    assert {r[0] for r in _rows(markup.xml_blocks(fine), "error")} == {None}


def test_csv_rows_as_the_csv_module_reads_them(spark):
    rnd = random.Random(2)
    texts = ['a,b\n5" pipe,x\nc,d', '"open, to the end\nof "" it', '"a"b"c",d', '""', "\ufeffx,y"] + [
        "".join(rnd.choice(['"', '""', ",", "\n", "\r\n", "a", "b ", '"x,y"', "\r"]) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    texts.append('"' + 'a ""quoted"" word, ' * 5_000 + '",end')
    got = {r.doc_id: r.rows for r in _docs(spark, *texts).select("doc_id", records.csv_records("text").alias("rows")).collect()}
    solid = lambda rows: [list(r) for r in rows if any(c.strip() for c in r)]
    for i, text in enumerate(texts):
        assert solid(got[str(i)]) == solid(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))), text


def test_files_stored_by_type_are_read_once(spark, tmp_path):
    rows = [(f"{kind}{i}", bytearray(b"{" if i % 2 else b"[1]"), kind) for kind in ("json", "txt", "csv") for i in range(4)]
    spark.createDataFrame(rows, "doc_id string, content binary, file_type string").write.partitionBy("file_type").parquet(str(tmp_path / "in"))
    files = spark.read.schema("doc_id string, content binary, file_type string").parquet(str(tmp_path / "in"))
    plan = registry.outcomes(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("PartitionFilters: [isnotnull(file_type") + plan.count("PartitionFilters: [NOT coalesce(file_type")  # each scan has a type of its own
    blocks, failed = registry.read_once(files, str(tmp_path / "out"))
    assert {r.doc_id for r in failed.collect()} == {"json1", "json3"} and blocks.count() == 10
    for frame in (blocks, failed):  # what was stored is read, nothing is decoded again
        again = frame._jdf.queryExecution().executedPlan().toString()
        assert again.count("FileScan") == 1 and "MapInArrow" not in again


def test_routed_csv_of_mixed_dialects(spark):
    texts = ['a;b\n1,5;"x;y"\n2,5;z', "1,5;2,5\n3,1;4,2", "a\tb\n1\t2", "a|b|c\n1|2|3", "a,b\n1;2,3", "1,2\n3,4", "one, two\nthree", '"p;q",r\n"s",t\n']
    files = spark.createDataFrame([(str(i), "csv", bytearray(t, "utf-8")) for i, t in enumerate(texts)], "doc_id string, file_type string, content binary")
    got = [r.text for r in registry.route(files)[0].orderBy("doc_id").collect()]
    assert got == ["a | b\n1,5 | x;y\n2,5 | z", "1,5 | 2,5\n3,1 | 4,2", "a | b\n1 | 2", "a | b | c\n1 | 2 | 3", "a | b\n1;2 | 3", "1 | 2\n3 | 4", "one |  two\nthree", "p;q | r\ns | t"]


def test_csv(spark):
    text = chr(0xFEFF) + "name;age\n;\n\"a;b\";3\n"
    assert _rows(records.csv_blocks(_docs(spark, text, ""), sep=";"), "doc_id", "kind", "text") == [("0", "table", "name | age\na;b | 3")]
    quoted = 'a,"say ""x, y"" now"\r\n"two\nlines",""\r\n,\r\nplain,"end"'
    assert _rows(records.csv_blocks(_docs(spark, quoted)), "text") == [('a | say "x, y" now\ntwo\nlines | \nplain | end',)]
    assert _rows(records.csv_blocks(_docs(spark, "v,w\n" * 10_001)), "text")[0][0].count("v | w") == 10_001


def test_json(spark):
    doc = json.dumps({"a": {"b": [1, {"c": None}], "e": {}, "f": []}, "t": True, "s": "x"})
    got = _rows(records.json_blocks(_docs(spark, doc, "3", "{")), "doc_id", "text", "error")
    assert got[0][1] == "a.b[0]: 1\na.b[1].c: None\nt: True\ns: x" and got[1][1] == ": 3"
    assert got[2][2].startswith("Could not parse JSON")
    full = list(records.decode_json(json.dumps(list(range(5001)))))
    assert len(full) == 101 and full[-1][1] == "[5000]: 5000"
    assert _rows(records.json_blocks(_docs(spark, "[1" + "0" * 5000 + "]", "[1]")), "doc_id", "text")[1] == ("1", "[0]: 1")


def test_sheets_and_caps(spark):
    rows = [("d", 1, "S", i, ["x", None, str(i)]) for i in range(6)] + [("d", 2, "Empty", None, None), ("d", 3, "B", 0, [" ", None])]
    df = spark.createDataFrame(rows, "doc_id string, sheet_no int, sheet string, row_no long, cells array<string>")
    got = _rows(records.sheet_blocks(df, cap=3), "kind", "text", "page_number", "section_title")
    assert got == [
        ("heading", "S", 1, "S"), ("table", "x |  | 0\nx |  | 1\nx |  | 2\n... (truncated after 3 rows)", 1, "S"),
        ("heading", "Empty", 2, "Empty"), ("heading", "B", 3, "B"),
    ]
    lines = spark.range(4).select(F.col("id").alias("n"), F.lit("v").alias("line"))
    count = lambda cap, at: records.capped_lines(lines, "n", "line", cap, "cut", at).count()
    assert (count(4, False), count(4, True), count(3, False), count(5, True)) == (4, 5, 4, 4)


def test_styled_paragraphs(spark):
    paragraphs = spark.createDataFrame(
        [("d", 0, "Normal", "pre"), ("d", 1, "Title", " Top "), ("d", 2, "List Bullet", "i"), ("d", 3, "Heading 2", "Sub"),
         ("d", 4, "Normal", "  "), ("d", 5, "heading", "H"), ("d", 6, None, "t")], "doc_id string, n int, style string, text string")
    tables = spark.createDataFrame([("d", 0, [[" a ", "b"], ["c", ""]]), ("d", 1, [["", ""]])], "doc_id string, n int, rows array<array<string>>")
    got = _rows(layout.styled_paragraph_blocks(paragraphs, tables), "kind", "text", "heading_level", "section_title")
    assert got == [
        ("paragraph", "pre", None, None), ("heading", "Top", 1, "Top"), ("list_item", "i", None, "Top"), ("heading", "Sub", 2, "Sub"),
        ("heading", "H", 1, "H"), ("paragraph", "t", None, "H"), ("table", "a | b\nc | ", None, "H"), ("table", " | ", None, "H"),
    ]


def test_slides(spark):
    shapes = spark.createDataFrame(
        [("d", 1, 0, 0, "body", "before"), ("d", 1, 1, 0, "title", "Top"), ("d", 1, 2, 1, "body", "b"), ("d", 1, 2, 0, "body", "a"),
         ("d", 1, 9, 0, "notes", "say"), ("d", 2, 0, 0, "body", "alone")],
        "doc_id string, slide int, shape_no int, para_no int, role string, text string")
    assert _rows(layout.slide_blocks(shapes), "kind", "text", "page_number", "section_title") == [
        ("heading", "Top", 1, "Top"), ("paragraph", "before", 1, "Top"), ("paragraph", "a", 1, "Top"), ("paragraph", "b", 1, "Top"),
        ("paragraph", "[Speaker notes] say", 1, "Top"), ("paragraph", "alone", 2, None)]


def test_spans_carry_section_over_pages(spark):
    spans = spark.createDataFrame(
        [("d", 1, 0, 0, 0, 16.0, "Big"), ("d", 1, 0, 1, 0, 10.0, "te"), ("d", 1, 0, 1, 1, 10.4, "xt "), ("d", 1, 1, 0, 0, 13.0, "Mid"),
         ("d", 1, 1, 1, 0, 10.0, " "), ("d", 2, 0, 0, 0, 9.0, "x"), ("d", 2, 0, 1, 0, 10.0, "y")],
        "doc_id string, page int, block int, line int, span int, size double, text string")
    assert _rows(layout.span_blocks(spans), "kind", "text", "heading_level", "page_number", "section_title") == [
        ("heading", "Big", 1, 1, "Big"), ("paragraph", "text", None, 1, "Big"), ("heading", "Mid", 2, 1, "Mid"),
        ("paragraph", "x", None, 2, "Mid"), ("paragraph", "y", None, 2, "Mid")]
    assert {(r["page"], r["body_size"]) for r in layout.body_sizes(spans).collect()} == {(1, 10), (2, 9)}


def test_votes_and_confidence(spark):
    pages = spark.createDataFrame([("a", 1, "hi"), ("a", 2, "en"), ("a", 3, "native"), ("b", 1, "native")], "doc string, page int, lang string")
    assert dict(layout.language_votes(pages, ["doc"]).collect()) == {"a": "hi", "b": None}
    words = spark.createDataFrame([("a", -1.0), ("a", 80.0), ("a", 90.0), ("b", -1.0)], "doc string, conf double")
    assert dict(layout.mean_confidence(words, ["doc"]).collect()) == {"a": 85.0, "b": 0.0}


def test_transcripts(spark):
    frame = lambda **e: "data: " + json.dumps(e) + "\n\n"
    body = (frame(type="delta", delta="a") + "data: {bad\n\n" + ": note\n\n" + "data:\n\n" + frame(type="no_answer", delta="none", confidence=0.0)
            + frame(type="delta", delta="!") + frame(type="done", citations=[{"document_id": "d", "similarity_score": 0.5}], confidence=0.9)
            + 'data: {"type":"delta","delta":"cut"}')
    failing = frame(type="delta", delta="x") + frame(type="error", error="")
    df = spark.createDataFrame([("1", body), ("2", failing)], "turn_id string, body string")
    out = {r["turn_id"]: r for r in transcripts.assemble_answers(transcripts.event_rows(df)).collect()}
    assert out["1"]["answer"] == "none!" and out["1"]["outcome"] == "no_answer" and out["1"]["citations"][0]["document_id"] == "d"
    assert out["1"]["confidence"] == 0.9
    assert out["2"]["outcome"] == "error" and out["2"]["error"] == transcripts.DEFAULT_ERROR and out["2"]["citations"] == []


def test_folder_routing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.TXT": b"one\n\ntwo \xff", "sub/b.markdown": b"# h\nx", "c.html": b"<p>para", "d.doc": b"x", "e": b"x", "f.csv": b"a,b\n1,2\n",
             "g.xml": b"<r>t</r>", "h.json": b"[1]", "i.png": b"\x89PNG"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    blocks, failed = registry.read_folder(spark, str(tmp_path))
    names = {r["doc_id"]: r["name"] for r in manifest.list_files(spark, str(tmp_path)).withColumn("doc_id", F.sha2("path", 256)).collect()}
    got = {}
    for r in blocks.orderBy("doc_id", "seq").collect():
        got.setdefault(names[r["doc_id"]], []).append((r["kind"], r["text"]))
    assert got == {
        "a.TXT": [("paragraph", "one"), ("paragraph", "two " + chr(0xFFFD))], "b.markdown": [("heading", "h"), ("paragraph", "x")],
        "c.html": [("paragraph", "para")], "f.csv": [("table", "a | b\n1 | 2")], "g.xml": [("paragraph", "r: t")], "h.json": [("table", "[0]: 1")]}
    why = {names[r["doc_id"]]: r["reason"] for r in failed.collect()}
    assert set(why) == {"d.doc", "e", "i.png"} and why["e"] == "no extension"


def test_rules(spark):
    df = spark.createDataFrame([("a.b.PDF", bytearray(b"%PDF-1.7")), ("x", bytearray(b"RIFF\x00\x00\x00\x00WEBP")), ("y.", bytearray(b""))], "n string, c binary")
    got = df.select(rules.extension("n"), rules.file_type("n"), rules.sniffed_type("c"), rules.storage_key("p", F.lit("o"), F.lit("d"), F.lit("a/b\\c"))).collect()
    assert [tuple(r) for r in got] == [("pdf", "pdf", "pdf", "p/o/d/a_b_c"), (None, None, "webp", "p/o/d/a_b_c"), ("", None, None, "p/o/d/a_b_c")]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1048576,), (5 * 1024 ** 4 * 1000,)], "n long")
    from lorewell.functions.display import human_bytes
    assert [r[0] for r in sizes.select(human_bytes("n")).collect()] == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1.0 MB", "5000.0 TB"]
