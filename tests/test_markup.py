"""Page shapes read by the extractors."""

import pyarrow as pa

from docloom.operators import markup as mk

META = """<html><p class="DocumentTitle">Document 32024R0001</p><p id="title"> A title </p><p id="originalTitle">x</p><p>C/2024/77</p>
<a href="http://data.europa.eu/eli/reg/2024/1">eli</a><dl class="NMetadata"><dt>Date of document: </dt><dd>10/01/2024; signed</dd><dt>Date of effect: </dt><dd>2024-02-01</dd>
<dt>Author: </dt><dd>Body A, Body B</dd><dt>Form: </dt><dd> Regulation </dd><dt>Subject matter: </dt><dd><ul><li>fish</li><li>sea</li></ul></dd>
<dt>Directory code: </dt><dd><ul><li>04.10 <span>Fisheries</span><span>General</span></li></ul></dd></dl></html>"""

SECTIONED = """<div class="eli-main-title"><p>Main act</p></div><div class="eli-preamble">Having regard</div>
<div class="eli-container"><div class="eli-subdivision"><p class="oj-normal">Point one</p><table><col width="4%"><col width="96%"><tr><td>(1)</td><td>numbered text<span class="oj-note-tag">9</span></td></tr></table></div>
<p class="oj-normal">Loose end</p><p class="oj-normal">12 34</p></div>
<div><p class="oj-ti-art">Article 1</p><p>Alpha beta</p><p>Alpha beta</p><p class="oj-note">note text</p><p class="oj-ti-art">Article 2</p>
<table><tr><td>cell one</td><td>7</td><td>cell two</td></tr></table><p class="oj-doc-ti oj-ti-section">ANNEX II</p><p>hidden from titles</p><p class="oj-ti-section">Section A</p><p>Gamma delta</p></div>
<p class="oj-signatory">Signed</p>"""


def parsed(spark, html, drop=()):
    return mk.parse_pages(spark.createDataFrame([(1, html)], "page_id int, html string"), drop=drop)


def test_pages_are_parsed_a_slice_at_a_time():
    """A batch of any size is Python objects only by the slice; no page is cut or left out."""
    pages = ["<p>x</p>" * n for n in (20_000, 10, 0, 90_000, 1, *[5_000] * 40)]
    pages[2] = None
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["page_id", "html"])
    parts = list(mk._slices(batch))
    assert len(parts) > 5 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    sizes = [[len(x or "") for x in p.column(1).to_pylist()] for p in parts]
    assert all(sum(x) - max(x) < 2 * mk.SLICE_BYTES for x in sizes)


def test_pages_of_a_long_batch_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(mk, "SLICE_BYTES", 64)
    rows = [(i if i % 7 else None, f"<div class='a'><p>t{i}</p></div>" * (i % 4) if i % 5 else None) for i in range(300)]
    got = mk.parse_pages(spark.createDataFrame(rows, "page_id int, html string").coalesce(1)).selectExpr("page_id", "size(nodes)", "concat_ws('', pieces.s)", "error").collect()
    assert [tuple(r) for r in got] == [(i, 2 * (n := (h or "").count("<p>")), f"t{k}" * n, None) for k, (i, h) in enumerate(rows)]


def test_metadata_record(spark):
    r = mk.with_dates(mk.metadata(parsed(spark, META))).first()
    assert (r.celex_number, r.title, r.identifier, r.form) == ("32024R0001", "A title", "C/2024/77", "Regulation")
    assert r.authors == ["Body A", "Body B"] and r.subject_matters == ["fish", "sea"]
    assert (r.directory_codes, r.directory_descriptions) == (["04.10"], ["Fisheries / General"])
    assert str(r.date_of_document) == "2024-01-10" and str(r.date_of_effect) == "2024-02-01" and r.date_of_end_validity is None
    assert r.error is None


def test_metadata_error_row(spark):
    r = mk.metadata(parsed(spark, "<p>nothing</p>")).first()
    assert r.error == "no document key" and r.celex_number is None


def test_main_text_once_per_piece(spark):
    html = '<div id="text"><div>outer<p>inner <b>bold</b></p></div><div class="metadata">skip</div><script>no()</script></div>'
    assert mk.main_text(parsed(spark, html)).first().full_text == "outer\ninnerbold"
    nested = mk.main_text(parsed(spark, html), leaf_only=False).first().full_text
    assert nested == "outerinnerbold\ninnerbold"


def test_container_priority_and_missing(spark):
    html = '<div id="text"><p>b</p></div><div id="document-content"><p>a</p></div>'
    assert mk.main_text(parsed(spark, html)).first().full_text == "a"
    assert mk.main_text(parsed(spark, "<p>x</p>")).first().error == "no main content"


def test_links(spark):
    html = """<a href="/legal-content/EN/TXT/?uri=OJ:L_202400001">out</a><div id="MainContent"><a href="./../legal-content/EN/TXT/?uri=OJ:L_202400002&x=1">two</a>
    <p>around <a href="https://h.example/legal-content/EN/TXT/?uri=OJ:L_202400003"></a></p><a href="/legal-content/EN/TXT/?uri=OJ:L_202490001">corr</a><a href="/x">no</a></div>"""
    rows = sorted(map(tuple, mk.document_links(parsed(spark, html), base="https://b.example").collect()))
    assert rows == [(1, "202400002", "https://b.example/legal-content/EN/TXT/?uri=OJ:L_202400002&x=1", "two"),
                    (1, "202400003", "https://h.example/legal-content/EN/TXT/?uri=OJ:L_202400003", "around")]


def test_sections(spark):
    rows = mk.sections(parsed(spark, SECTIONED, mk.UNWANTED_CLASSES)).orderBy("section_order").collect()
    got = [(r.section_type, r.title, r.content) for r in rows]
    assert got == [
        ("header", "Document Title", "Main act"), ("preamble", "Preamble", "Having regard"),
        ("main", "Main Content", "Point one\n(1) numbered text\nLoose end"),
        ("oj-ti-art", "Article 1", "Alpha beta"), ("oj-ti-art", "Article 2", "cell one cell two"),
        ("oj-ti-section", "Section A", "Gamma delta"),
    ]
    assert [r.section_order for r in rows] == list(range(6))


def test_broken_page_is_a_row(spark):
    rows = mk.parse_pages(spark.createDataFrame([(1, None), (2, "<p><b>x<br></p></i>")], "page_id int, html string")).collect()
    assert len(rows) == 2 and all(r.error is None for r in rows)


def test_validation_split(spark):
    df = spark.createDataFrame([("k", "t", "C/2024/1", "http://a/b"), (None, " ", "odd", "none")], "celex_number string, title string, identifier string, eli_uri string")
    good, bad = mk.split_valid(mk.validate(df))
    assert good.first().identifier == "C/2024/1"
    r = bad.first()
    assert r.identifier == "" and r.reasons == ["celex_number missing", "title missing", "eli_uri is no address"]
