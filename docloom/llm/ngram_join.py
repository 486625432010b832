"""Exact Jaccard self-join of documents on word shingles, by rare-first prefixes; the links' connected components.

Steps, all over whole texts:

1. One pass gives each document the size and digest of its shingle set, the set's counts in 16 hash ranges, and adds its
   shingles to a count table of a fixed number of cells. Equal sets become one class, stood for by its smallest doc_id.
2. The count table orders shingles, rarest first (ties by hash). Of a class with n shingles only the first
   ``n - ceil(t n) + 1`` are kept: sets that reach the threshold share one of them.
3. Kept shingles meet. Each class is paired with the smallest doc_id of its shingle's group rather than with every other
   member, in groups of more than 256 also with the 4 that have the shingle earliest, the copies least changed. Length and positional filters apply at the meeting; the suffix filter (a bound on the difference of two
   sets from their counts in hash ranges) once per distinct pair; what is left is verified once, on the whole sets.
4. Links are contracted. Only members of a group that are still apart can be linked by a pair not looked at. In groups of
   more than 256 the first 16, then 64 members meet those that are apart from them, with a contraction after each round,
   until few of the pairs link.
5. Of the pairs still apart the ones that pass the length and positional filters from the smaller set's side are formed,
   in bands of length, then filtered and verified in the same way.

A group of near copies is thus verified against a fixed number of members each, never all against all, and no link
between documents in different components is left out. Shingles that very many documents share are split by salt in step 3.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import spans
from docloom.llm.components import components
from docloom.llm.shared import written

CELLS = 1 << 20  # of the count table: 8 MB as a broadcast, whatever the corpus
SLICES = 256
ID_CELLS = 1 << 22  # of the broadcast filter of documents to verify; a full filter only lets more rows pass
RANGES = 16
BLOCK = 128  # members verified against one pivot in one group
SMALL = 256  # members of a group that may all meet each other
PIVOTS = (4, 16, 64)  # members of a larger group that all others meet, at first and in later rounds
HOT = 4096  # cells that count more than this (and eight times the mean) have their shingles' groups salted
_WORD = spans.byte_class(bytes(c for c in range(128) if c != 32 and not 9 <= c <= 13), high=True)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each text; of the whole sequence if it has fewer words."""
    data, offsets = spans.text_buffer(column)
    data = spans.ascii_lower(data)
    words = spans.runs(_WORD[data], offsets)
    grams, bounds = spans.hash_grams(spans.hash_spans(data, words), words.first, k)
    cuts = bounds.tolist()
    return [np.unique(grams[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 20)).astype(np.int64)


def _first_pass(docs: DataFrame, k: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        names = ["doc_id", "n", "d1", "d2", "ranges", "slice", "counts"]
        for batch in batches:
            for part in spans.slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                total += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
                ranges = [np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=RANGES).tolist() for s in sets]
                m = len(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(ranges, pa.list_(pa.int32())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if total.any():
            parts = [x.astype("<i4").tobytes() for x in total.reshape(SLICES, -1)]
            m = SLICES
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.array(range(m), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(step, "doc_id bigint, n bigint, d1 bigint, d2 bigint, ranges array<int>, slice int, counts binary")


def _count_table(passed: DataFrame) -> np.ndarray:
    """Occurrences per cell over all documents: 256 rows of 32 KB reach the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(c.as_buffer(), "<i4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    rows = passed.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, counts binary").collect()
    table = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for r in rows:
        table[r.slice] += np.frombuffer(r.counts, np.int64)
    return table.reshape(-1)


def _prefixes(docs: DataFrame, k: int, percent: int, table: Broadcast, limit: float) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            for part in spans.slices(batch, "text"):
                kept, salts, sizes = [], [], []
                for s in shingle_sets(part.column("text"), k):
                    n = len(s)
                    c = counts[_cell(s)]
                    first = np.lexsort((s, c))[: n - -(-percent * n // 100) + 1] if n else []
                    kept.append(s[first].astype(np.int64))
                    many = np.ceil(c[first] / limit).astype(np.int32) if n else np.zeros(0, np.int32)
                    salts.append(many if n and many.max() > 1 else None)
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32()))], ["id", "n", "prefix", "salts"])

    return docs.mapInArrow(step, "id bigint, n bigint, prefix array<bigint>, salts array<int>")


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs: a, an, ap, b, bn, bp (size and 0-based prefix place of the shared shingle). Length and positional filter."""
    least = F.least("an", "bn")
    rest = F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp"))
    return (pairs.where((100 * least >= percent * F.greatest("an", "bn")) & ((100 + percent) * rest >= percent * (F.col("an") + F.col("bn"))))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _suffix_filter(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Sets differ at least by the sum of the differences of their counts in each hash range."""
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("doc_id").alias(side), F.col("n").alias(f"{side}n"), F.col("ranges").alias(f"{side}r")).hint("merge"), side)
    apart = F.aggregate(F.zip_with("ar", "br", lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    both = F.col("an") + F.col("bn")
    return pairs.where((100 + percent) * (both - apart) >= 2 * percent * both).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold. Members of a much used pivot are dealt out in blocks, each with a copy of it."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block"))
    wanted = dealt.select("a", "block", F.col("b").alias("id"), F.lit(1).alias("role")).union(
        dealt.select("a", "block", F.col("a").alias("id"), F.lit(0).alias("role")).distinct())
    cell = F.pmod(F.xxhash64("id"), F.lit(ID_CELLS))
    used = np.zeros(ID_CELLS, bool)
    used[wanted.select(cell.cast("int").alias("cell")).distinct().toArrow()["cell"].to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(used))  # 512 KB

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(held[batch.column("cell").to_numpy()]))
            for part in spans.slices(batch, "text"):
                packed = [s.tobytes() for s in shingle_sets(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], ["id", "shingles"])

    whole = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").withColumn("cell", cell).mapInArrow(sets, "id bigint, shingles binary")
    dealt_sets = whole.join(wanted.hint("merge"), "id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pivots = None, []
        for batch in batches:
            links = set()
            for a, block, b, role, packed in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "id", "role", "shingles")), strict=True):
                s = np.frombuffer(packed, np.uint64)
                if role == 0:
                    pivots = [*pivots, s] if held == (a, block) else [s]
                    held = (a, block)
                    continue
                for p in pivots:
                    if not len(p) or not len(s):
                        continue
                    at = np.minimum(np.searchsorted(p, s), len(p) - 1)
                    common = int((p[at] == s).sum())
                    if 100 * common >= percent * (len(p) + len(s) - common):
                        links.add((a, b))
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt_sets.select("a", "block", "role", "id", "shingles").repartition("a", "block").sortWithinPartitions("a", "block", "role").mapInArrow(step, "u bigint, v bigint")


def _stars(found: DataFrame) -> DataFrame:
    """Components as links u, v."""
    return found.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _open_groups(met: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the shingles' groups with their component c, and groups that hold several: h, size, most (the largest one)."""
    apart = met.select("h", "id", "n", "pos").join(found.hint("merge"), F.col("id") == F.col("node"), "left").select("h", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
    apart = written(apart, "members")
    parts = apart.groupBy("h", "c").agg(F.count(F.lit(1)).alias("size"))
    groups = parts.groupBy("h").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.max_by("c", F.struct("size", "c")).alias("most"))
    return apart, written(groups.where("parts > 1 AND size > 2").drop("parts"), "groups")


def _pivot_pairs(apart: DataFrame, groups: DataFrame, pivots: int, percent: int) -> DataFrame:
    """Members (h, id, n, pos, c) of a large group (h, size) with its pivots, where they are still apart."""
    open_ = apart.join(groups.where(F.col("size") > SMALL).select("h").hint("merge"), "h")
    in_order = Window.partitionBy("h").orderBy("pos", "id")
    first = open_.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= pivots)
    first = first.select("h", F.col("id").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"), F.col("c").alias("ac"))
    others = open_.select("h", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("c").alias("bc"))
    return _possible(first.join(others, "h").where("ac <> bc"), percent)


def _all_pairs(apart: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of a group's members that are still apart; members of its largest component do not meet each other."""
    open_ = apart.join(groups.select("h", "most").hint("merge"), "h")
    # The smaller set of a pair stands at the shared shingle early enough for a partner as large as itself; a template
    # that its instances share to less than the threshold stands too late in all of them, so its group forms no pair.
    light = (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)))  # a larger partner's is the same or the next; one more for rounding
    inside = F.col("c") == F.col("most")
    ways = lambda own, other: F.explode(F.when(inside, F.array(F.lit(other))).otherwise(F.array(F.lit("both"), F.lit(own))))
    smaller = open_.where(light).withColumn("way", ways("smaller out", "larger out")).select("h", "way", F.col("id").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"), F.col("c").alias("ac"), F.explode(F.array(band, band + 1, band + 2)).alias("band"))
    larger = open_.withColumn("way", ways("larger out", "smaller out")).select("h", "way", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("c").alias("bc"), band.alias("band"))
    near = ((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))) & (F.col("ac") != F.col("bc")) & (100 * F.col("an") >= percent * F.col("bn"))
    return _possible(smaller.join(larger, ["h", "way", "band"]).where(near), percent)


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id (integer), text. Returns doc_id, n_shingles, component_id, a row for each input row.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Two documents link when
    100 * intersection >= percent * union of their shingle sets. Null, empty and blank texts have no shingles and are
    their own component. Rows that share a doc_id are one document with several texts: it links as any of them does. A
    null doc_id links with nothing and keeps a null component. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    passed = written(_first_pass(docs, k), "sets")
    counts = _count_table(passed)
    limit = max(HOT, 8 * counts.mean())
    table = docs.sparkSession.sparkContext.broadcast(counts)
    rows = passed.where("slice IS NULL").drop("slice", "counts")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    named = written(full.select("doc_id", "d1", "d2").distinct().join(classes, ["d1", "d2"]).select("doc_id", "rep").distinct(), "classes")
    reps = named.select("rep").distinct()
    sizes = full.groupBy("doc_id", "d1", "d2").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"))

    kept = _prefixes(docs, k, percent, table, limit).join(reps.hint("merge"), F.col("id") == F.col("rep"), "left_semi")
    many = F.coalesce(F.try_element_at("salts", F.col("pos") + 1), F.lit(1))
    entries = (kept.select("id", "n", "salts", F.posexplode("prefix").alias("pos", "h"))
               .select("h", "id", "n", "pos", many.alias("many"), F.pmod(F.xxhash64("id"), many).alias("salt")))
    in_order = Window.partitionBy("h", "salt").orderBy("id")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = (entries.withColumns({"a": F.first("id").over(running), "an": F.first("n").over(running), "ap": F.first("pos").over(running), "nth": F.row_number().over(in_order), "next": F.lead("id").over(in_order)})
           .where("many > 1 OR nth > 1 OR next IS NOT NULL").drop("next", "nth", "salt"))
    met = written(met, "meetings")
    member = [F.col("id").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp")]
    star = met.where("id <> a").select("a", "an", "ap", *member)
    by_shingle = Window.partitionBy("h").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = met.where("many > 1 AND id = a").select("h", "id", "n", "pos", F.first("id").over(by_shingle).alias("a"), F.first("n").over(by_shingle).alias("an"), F.first("pos").over(by_shingle).alias("ap"))
    pairs = _possible(star.union(heads.where("id <> a").select("a", "an", "ap", *member)), percent)
    in_group = met.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    pairs = pairs.union(_pivot_pairs(met.select("h", "id", "n", "pos", F.col("id").alias("c")), in_group, PIVOTS[0], percent)).distinct()
    tried = written(_suffix_filter(pairs, sizes, percent).distinct(), "pairs")
    shared_id = named.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = written(_verified(tried, docs, k, percent).union(shared_id), "links")

    found = components(links)
    apart, groups = _open_groups(met, found)
    joined = _stars(found)
    for pivots in PIVOTS[1:]:
        if groups.where(F.col("size") > SMALL).isEmpty():
            break
        more = _suffix_filter(_pivot_pairs(apart, groups, pivots, percent), sizes, percent).distinct().join(tried, ["a", "b"], "left_anti")
        more = written(more, "pairs")
        linked = written(_verified(more, docs, k, percent), "links")
        tried, joined = tried.union(more), joined.union(linked)
        if 10 * linked.count() <= more.count():  # those still apart hardly link: no use in more pivots
            break
        found = components(joined)
        joined = _stars(found)
        apart, groups = _open_groups(met, found)
    rest = _suffix_filter(_all_pairs(apart, groups, percent), sizes, percent).distinct().join(tried, ["a", "b"], "left_anti")
    final = components(joined.union(written(_verified(written(rest, "rest"), docs, k, percent), "links")))
    named_final = (named.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(final, F.col("rep") == F.col("node"), "left")
                   .select("doc_id", F.coalesce("component", "rep").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(named_final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
