"""Pages to text, metadata, links and sections.

One small parser turns a page into its elements and text pieces (the only Python step, Arrow-batched). Everything
after that is column work over those arrays, inside the same stage: an element is an interval of text pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as dt
from ..functions import keys as ky
from ..functions import text as tx
from ..functions.text import let

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = ("p", "div", "table")

# Ids, classes and labels looked for in pages.
CONTENT_IDS = ("document-content", "TexteOnly", "text")
SKIPPED_CLASSES = ("hidden-print", "navigation", "metadata")
UNWANTED_CLASSES = ("oj-signatory", "oj-note", "oj-hd-lg", "oj-final", "oj-hd-coll", "oj-hd-uniq", "oj-hd-date")
TITLE_CLASSES = ("oj-ti-grseq-1", "oj-ti-art", "oj-ti-section", "oj-ti-chapter")
NOTE_CLASS = "oj-note-tag"
ELI_PREFIX = "http://data.europa.eu/eli/"
LABELS = {
    "form": "Form", "authors": "Author", "responsible_body": "Responsible body", "eurovoc": "EUROVOC descriptor",
    "subjects": "Subject matter", "directory": "Directory code", "date_of_document": "Date of document",
    "date_of_effect": "Date of effect", "date_of_end_validity": "Date of end of validity",
}

ELEMENT = (
    "struct<seq:int,last:int,parent:int,tag:string,id:string,classes:array<string>,href:string,style:string,"
    "width:string,t0:int,t1:int>"
)
PIECE = "struct<s:string,block:int>"
SLICE_BYTES = 256 << 10  # of pages held as Python objects at a time, which take some hundred times this; a longer page is one slice


class _Flattener(HTMLParser):
    """Elements in document order, each with the span of elements and text pieces below it."""

    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.drop = drop
        self.elements: list[dict] = []
        self.pieces: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else None
        classes = a.get("class", "").split()
        hidden = bool(parent and parent["_hidden"]) or bool(self.drop.intersection(classes)) or tag in ("script", "style")
        seq = len(self.elements) + 1  # shown elements are numbered without gaps: seq is the array position
        block = seq if tag in BLOCKS else (parent["_block"] if parent else 0)
        e = {
            "seq": seq, "last": seq, "parent": parent["seq"] if parent else 0, "tag": tag, "id": a.get("id"),
            "classes": classes, "href": a.get("href"), "style": a.get("style"), "width": a.get("width"),
            "t0": len(self.pieces), "t1": len(self.pieces), "_hidden": hidden, "_block": block,
        }
        if not hidden:
            self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            while self._close()["tag"] != tag:
                pass

    def handle_data(self, data):
        if not (self.open and self.open[-1]["_hidden"]):
            self.pieces.append({"s": data, "block": self.open[-1]["_block"] if self.open else 0})

    def _close(self):
        e = self.open.pop()
        e["last"], e["t1"] = len(self.elements), len(self.pieces)
        return e

    def result(self):
        self.close()
        while self.open:
            self._close()
        keep = [{k: v for k, v in e.items() if k[0] != "_"} for e in self.elements]
        return keep, self.pieces


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html", drop: Sequence[str] = ()) -> DataFrame:
    """(key, nodes, pieces, error). Classes in ``drop`` are cut out with everything below them."""
    dropped = frozenset(drop)
    pages = pages.select(key, html)
    kind = pages.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{key} {kind}, nodes array<{ELEMENT}>, pieces array<{PIECE}>, error string")
    names = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                nodes, pieces, errors = [], [], []
                for page in part.column(1).to_pylist():
                    try:
                        f = _Flattener(dropped)
                        f.feed(page or "")
                        n, t = f.result()
                        nodes.append(n), pieces.append(t), errors.append(None)
                    except Exception as e:  # a page that cannot be read becomes a row with its reason
                        nodes.append([]), pieces.append([]), errors.append(str(e))
                made = (pa.array(x, names.field(i).type) for i, x in enumerate((nodes, pieces, errors), 1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(names.field(0).type), *made], schema=names)

    return pages.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (key, html) in pieces of about SLICE_BYTES of pages, whole pages each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


# -- reading elements ----------------------------------------------------------------------------------------


def _below(pieces: Column, e: Column) -> Column:
    return F.slice(pieces, e["t0"] + 1, F.greatest(e["t1"] - e["t0"], F.lit(0)))


def text_of(pieces: Column, e: Column) -> Column:
    """All text below an element, pieces joined as they stand."""
    return F.array_join(F.transform(_below(pieces, e), lambda p: p["s"]), "")


def stripped_of(pieces: Column, e: Column) -> Column:
    """Non-blank text pieces below an element, each stripped."""
    return F.filter(F.transform(_below(pieces, e), lambda p: tx.strip(p["s"])), lambda s: s != "")


def has_class(e: Column, *names: str) -> Column:
    return F.arrays_overlap(e["classes"], F.array(*(F.lit(n) for n in names)))


def inside(e: Column, outer: Column) -> Column:
    return (e["seq"] > outer["seq"]) & (e["seq"] <= outer["last"])


def first(nodes: Column, test) -> Column:
    return F.get(F.filter(nodes, test), F.lit(0))


# -- main text -----------------------------------------------------------------------------------------------

def main_text(parsed: DataFrame, key: str = "page_id", ids: Sequence[str] = CONTENT_IDS,
              fallback_tags: Sequence[str] = (), leaf_only: bool = True, joiner: str = "") -> DataFrame:
    """Text of the content container, one line per ``p``/``div``/``table``; rows without a container carry an error.

    The container is the first ``div`` with one of ``ids``, in that order, else the first of ``fallback_tags``.
    ``leaf_only`` gives every piece of text once, to its innermost block; otherwise each block repeats what is below.
    """

    def by_id(wanted: str) -> Column:
        return first(F.col("nodes"), lambda e: (e["tag"] == "div") & (e["id"] == wanted))

    def by_tag(wanted: str) -> Column:
        return first(F.col("nodes"), lambda e: e["tag"] == wanted)

    options = [*map(by_id, ids), *map(by_tag, fallback_tags)]
    held = parsed.withColumn("box", F.coalesce(*options))
    lead = lambda e: F.coalesce(F.get(e["classes"], F.lit(0)), F.lit(""))
    blocks = F.filter(
        F.col("nodes"),
        lambda e: e["tag"].isin(*BLOCKS) & ~lead(e).isin(*SKIPPED_CLASSES)
        & (inside(e, F.col("box")) | (F.lit(leaf_only) & (e["seq"] == F.col("box.seq")))),
    )

    def line(e: Column) -> Column:
        own = _below(F.col("pieces"), e)
        own = F.filter(own, lambda p: p["block"] == e["seq"]) if leaf_only else own
        return F.array_join(F.filter(F.transform(own, lambda p: tx.strip(p["s"])), lambda s: s != ""), joiner)

    text = F.array_join(F.filter(F.transform(blocks, line), lambda s: s != ""), "\n")
    return held.select(
        key, F.when(F.col("box").isNotNull(), text).alias("full_text"),
        F.coalesce("error", F.when(F.col("box").isNull(), F.lit("no main content"))).alias("error"),
    )


# -- metadata ------------------------------------------------------------------------------------------------

def metadata(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Metadata record of every page; ``error`` where key, title or address is missing."""
    nodes, pieces = F.col("nodes"), F.col("pieces")

    def labelled(label: str) -> Column:
        mark = first(nodes, lambda e: (e["tag"] == "dt") & text_of(pieces, e).contains(label))
        return let(mark, lambda m: first(nodes, lambda e: (e["tag"] == "dd") & (e["seq"] > m["seq"])))

    def items(box: Column) -> Column:
        lis = F.filter(nodes, lambda e: (e["tag"] == "li") & inside(e, box))
        return F.transform(lis, lambda e: F.array_join(stripped_of(pieces, e), ""))

    boxes = {f"_{name}": labelled(label) for name, label in LABELS.items()}
    p_title = first(nodes, lambda e: (e["tag"] == "p") & (e["id"] == "title"))
    p_key = first(nodes, lambda e: (e["tag"] == "p") & has_class(e, "DocumentTitle"))
    eli = first(nodes, lambda e: (e["tag"] == "a") & e["href"].startswith(ELI_PREFIX))
    staged = parsed.withColumns({**boxes, "_t": p_title, "_k": p_key, "_eli": eli["href"]})
    after = F.filter(nodes, lambda e: (e["tag"] == "p") & (e["parent"] == F.col("_t.parent")) & (e["seq"] > F.col("_t.seq"))
                     & ~e["id"].eqNullSafe(F.lit("originalTitle")))
    staged = staged.withColumn("_id", F.get(after, F.lit(0)))

    def value(name: str) -> Column:
        return tx.strip(text_of(pieces, F.col(f"_{name}")))

    def before_semicolon(name: str) -> Column:
        return F.coalesce(tx.strip(F.split_part(value(name), F.lit(";"), F.lit(1))), F.lit(""))

    title = tx.strip(text_of(pieces, F.col("_t")))
    celex = F.element_at(tx.words(text_of(pieces, F.col("_k"))), -1)
    empty = F.array().cast("array<string>")
    directory = F.filter(nodes, lambda e: (e["tag"] == "li") & inside(e, F.col("_directory")))
    codes = F.transform(directory, lambda e: F.split_part(tx.strip(text_of(pieces, e)), F.lit(" "), F.lit(1)))
    labels = F.transform(
        directory,
        lambda li: F.array_join(
            F.transform(
                F.filter(nodes, lambda e: (e["tag"] == "span") & inside(e, li)),
                lambda e: F.array_join(stripped_of(pieces, e), ""),
            ),
            " / ",
        ),
    )
    return staged.select(
        key,
        celex.alias("celex_number"), title.alias("title"),
        F.coalesce(F.nullif(tx.strip(text_of(pieces, F.col("_id"))), F.lit("")), title).alias("identifier"),
        F.col("_eli").alias("eli_uri"),
        F.coalesce(value("form"), F.lit("")).alias("form"),
        F.coalesce(F.transform(F.split(value("authors"), ","), tx.strip), empty).alias("authors"),
        F.coalesce(value("responsible_body"), F.lit("")).alias("responsible_body"),
        F.coalesce(items(F.col("_eurovoc")), empty).alias("eurovoc_descriptors"),
        F.coalesce(items(F.col("_subjects")), empty).alias("subject_matters"),
        F.coalesce(codes, empty).alias("directory_codes"),
        F.coalesce(labels, empty).alias("directory_descriptions"),
        *(before_semicolon(n).alias(n) for n in ("date_of_document", "date_of_effect", "date_of_end_validity")),
        F.coalesce(
            "error",
            F.when(F.col("_k").isNull(), "no document key").when(F.col("_t").isNull(), "no title")
            .when(F.col("_eli").isNull(), "no address"),
        ).alias("error"),
    )


def with_dates(records: DataFrame) -> DataFrame:
    names = ("date_of_document", "date_of_effect", "date_of_end_validity")
    return records.withColumns({n: dt.parse_date(F.col(n)) for n in names})


def validate(records: DataFrame) -> DataFrame:
    """Records with a cleaned identifier and the list of broken rules (empty when good)."""
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("celex_number"), F.lit("")) == "", F.lit("celex_number missing")),
            F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.lit("title missing")),
            F.when(F.col("eli_uri").isNotNull() & ~F.col("eli_uri").rlike(r"^[a-z]+://\S+$"), F.lit("eli_uri is no address")),
        )
    )
    return records.withColumns({"identifier": ky.clean_identifier(F.col("identifier")), "reasons": rules})


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.size("reasons") == 0), checked.filter(F.size("reasons") > 0)


# -- links ---------------------------------------------------------------------------------------------------

def all_links(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Every anchor with an address: (key, position, href, title)."""
    nodes, pieces = F.col("nodes"), F.col("pieces")
    anchors = F.filter(nodes, lambda e: (e["tag"] == "a") & e["href"].isNotNull())
    rows = parsed.select(key, F.posexplode(F.transform(anchors, lambda e: F.struct(
        e["href"].alias("href"), tx.strip(text_of(pieces, e)).alias("title"),
        e["parent"].alias("parent"), e["seq"].alias("seq")))).alias("position", "a"))
    return rows.select(key, "position", "a.href", "a.title")


def document_links(parsed: DataFrame, key: str = "page_id", base: str = ky.BASE_URL, box_id: str = "MainContent") -> DataFrame:
    """Links to documents inside the main content: (key, document_id, url, title); corrigenda and odd ids left out."""
    nodes, pieces = F.col("nodes"), F.col("pieces")
    held = parsed.withColumn("box", first(nodes, lambda e: (e["tag"] == "div") & (e["id"] == box_id)))
    wanted = F.filter(
        nodes,
        lambda e: (e["tag"] == "a") & inside(e, F.col("box")) & e["href"].contains("legal-content/EN/")
        & e["href"].contains("uri=OJ:L_"),
    )

    def entry(e: Column) -> Column:
        own = tx.strip(text_of(pieces, e))
        around = first(nodes, lambda p: p["seq"] == e["parent"])
        return F.struct(e["href"].alias("href"), F.when(own != "", own).otherwise(tx.strip(text_of(pieces, around))).alias("title"))

    rows = held.select(key, F.explode(F.transform(wanted, entry)).alias("a"))
    path = F.regexp_replace("a.href", r"^(?:\.{1,2}/)+|^/?", "/")
    url = F.when(F.col("a.href").rlike("^https?://"), F.col("a.href")).otherwise(F.concat(F.lit(base), path))
    return rows.select(
        key, F.regexp_extract("a.href", r"uri=OJ:L_([^&]*)", 1).alias("document_id"), url.alias("url"),
        F.col("a.title").alias("title"),
    ).filter(ky.is_document_id(F.col("document_id")))


# -- sections ------------------------------------------------------------------------------------------------

def below(nodes: Column, e: Column) -> Column:
    """Elements inside ``e``: they follow it in document order, so they are one slice, whatever else the page holds."""
    return F.slice(nodes, e["seq"] + 1, F.greatest(e["last"] - e["seq"], F.lit(0)))


def table_text(nodes: Column, pieces: Column, table: Column) -> Column:
    """Text of a table: ``n text`` for a numbered-paragraph table, else its rows line by line."""

    def cell_text(c: Column) -> Column:
        notes = F.filter(below(nodes, c), lambda e: e["tag"].isin("a", "span") & has_class(e, NOTE_CLASS))
        kept = F.filter(
            F.transform(F.sequence(c["t0"], c["t1"]), lambda i: F.when(
                (i < c["t1"]) & ~F.exists(notes, lambda n: (i >= n["t0"]) & (i < n["t1"])), F.get(pieces, i)["s"])),
            lambda s: s.isNotNull(),
        )
        return F.array_join(kept, "")

    own = below(nodes, table)
    cols = F.filter(own, lambda e: e["tag"] == "col")
    cells = F.filter(own, lambda e: e["tag"] == "td")
    numbered = (F.size(cols) == 2) & F.exists(cols, lambda c: F.coalesce(c["width"], F.lit("")).contains("4%"))
    body = tx.strip(cell_text(F.get(cells, F.lit(1))))
    numbered_text = F.when((F.size(cells) > 1) & (body != ""), F.concat_ws(" ", tx.strip(cell_text(F.get(cells, F.lit(0)))), body)).otherwise("")

    def row_text(tr: Column) -> Column:
        def build(cs: Column) -> Column:
            ok = lambda c: (F.size(cs) > 1) | F.exists(below(nodes, c), lambda e: (e["tag"] == "span") | ((e["tag"] == "p") & has_class(e, "oj-normal")))
            texts = F.transform(F.filter(cs, ok), lambda c: tx.clean_legal_text(cell_text(c)))
            return F.array_join(F.filter(texts, lambda s: (s != "") & ~s.rlike(r"^\d+$")), " ")

        return let(F.filter(below(nodes, tr), lambda e: e["tag"].isin("td", "th")), build)

    lines = F.transform(F.filter(own, lambda e: e["tag"] == "tr"), row_text)
    plain = F.array_join(F.filter(lines, lambda s: s != ""), "\n")
    return F.when(numbered, numbered_text).otherwise(plain)


def sections(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Ordered sections (key, section_order, title, content, section_type, word_count) of parsed pages.

    Header, preamble and main content first, then titled sections class by class. Pages are to be parsed with
    ``drop=UNWANTED_CLASSES``.
    """
    nodes, pieces = F.col("nodes"), F.col("pieces")
    clean = lambda e: tx.clean_legal_text(text_of(pieces, e))
    div = lambda name: first(nodes, lambda e: (e["tag"] == "div") & has_class(e, name))
    held = parsed.withColumns({"_head": div("eli-main-title"), "_pre": div("eli-preamble"), "_box": div("eli-container")})

    def child_text(parent: Column) -> Column:
        """Texts of the direct paragraphs, tables and spans of a subdivision, in that order."""
        kids = lambda tag: F.filter(below(nodes, parent), lambda e: (e["parent"] == parent["seq"]) & (e["tag"] == tag))
        paragraphs = F.transform(F.filter(kids("p"), lambda e: has_class(e, "oj-normal")), clean)
        tables = F.transform(kids("table"), lambda t: table_text(nodes, pieces, t))
        return F.concat(paragraphs, tables, F.transform(kids("span"), clean))

    def inline_text(e: Column) -> Column:
        ps = F.filter(below(nodes, e), lambda p: (p["tag"] == "p") & (p["style"] == "display: inline;"))
        return F.array_join(F.filter(F.transform(ps, clean), lambda s: s != ""), " ")

    box = F.col("_box")
    in_box = lambda name: F.filter(below(nodes, box), lambda e: (e["tag"] == "div") & has_class(e, name))
    loose = F.filter(below(nodes, box), lambda e: (e["tag"] == "p") & has_class(e, "oj-normal") & (e["parent"] == box["seq"]))
    main_parts = F.concat(
        F.transform(in_box("oj-enumeration-spacing"), inline_text),
        F.flatten(F.transform(in_box("eli-subdivision"), child_text)),
        F.transform(loose, clean),
    )
    joined = lambda parts: F.array_join(F.filter(parts, lambda s: s != ""), "\n")

    # Titled sections: every heading with what follows it on its own level, up to the next heading there.
    order = lambda e: F.array_min(F.transform(e["classes"], lambda c: F.nullif(F.array_position(titles, c), F.lit(0))))
    titles = F.array(*(F.lit(n) for n in TITLE_CLASSES))
    annex = lambda e: has_class(e, "oj-doc-ti") & tx.strip(text_of(pieces, e)).rlike("^ANNEX [IVX]+$")
    # Sorted by level and place, the next heading of a heading's level stands right after it.
    marks = F.sort_array(F.transform(F.filter(nodes, lambda e: has_class(e, *TITLE_CLASSES)), lambda e: F.struct(e["parent"].alias("parent"), e["seq"].alias("seq"), e.alias("e"))))
    after = F.zip_with(F.col("_marks"), F.slice(F.col("_marks"), 2, F.greatest(F.size("_marks") - 1, F.lit(0))), lambda m, n: F.struct(
        order(m["e"]).alias("o"), m["seq"].alias("seq"), m["e"].alias("e"), F.when(n["parent"] == m["parent"], n["seq"]).alias("next")))
    held = held.withColumn("_marks", marks).withColumn("_heads", F.sort_array(F.filter(after, lambda h: ~annex(h["e"]))))

    def body(h: Column, following_head: Column) -> Column:
        level_end = F.when(h["parent"] > 0, F.get(nodes, h["parent"] - 1)["last"]).otherwise(F.size(nodes))
        stop = F.least(level_end, following_head - 1)
        following = F.filter(F.slice(nodes, h["seq"] + 1, F.greatest(stop - h["seq"], F.lit(0))), lambda e: e["parent"] == h["parent"])
        parts = F.flatten(F.transform(
            following,
            lambda e: F.when(e["tag"] == "table", F.array(table_text(nodes, pieces, e))).otherwise(
                F.transform(stripped_of(pieces, e), tx.clean_legal_text)),
        ))
        return joined(F.array_distinct(parts))

    titled = F.transform("_heads", lambda h: F.struct(
        clean(h["e"]).alias("title"), body(h["e"], h["next"]).alias("content"), F.element_at(titles, h["o"].cast("int")).alias("section_type")))

    def fixed(title: str, content: Column, kind: str) -> Column:
        return F.array(F.struct(F.lit(title).alias("title"), content.alias("content"), F.lit(kind).alias("section_type")))

    everything = F.concat(
        fixed("Document Title", F.coalesce(clean(F.col("_head")), F.lit("")), "header"),
        fixed("Preamble", F.coalesce(clean(F.col("_pre")), F.lit("")), "preamble"),
        fixed("Main Content", F.coalesce(joined(main_parts), F.lit("")), "main"),
        titled,
    )
    good = F.filter(everything, lambda s: tx.is_valid_section(s["content"]) & (s["title"] != ""))
    # Exploded as an expression: on a named column the optimizer would add a size check that evaluates it again.
    return held.select(key, F.posexplode(good).alias("section_order", "s")).select(
        key, "section_order", "s.title", "s.content", "s.section_type", tx.word_count(F.col("s.content")).alias("word_count")
    )
