"""URL filter: hand-written host and path rules, then association rules mined from labelled URLs by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import written

BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end. Both empty without ://."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def url_tokens(url: str, host: str, path: str) -> Column:
    """Distinct tokens of a URL: host labels, their parts and the whole domain ending, path and query words; numbers are one token. A URL without a host has none but those of its path."""
    labels = F.split(F.col(host), r"\.")
    query = F.when(F.col(host) != "", F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)).otherwise("")

    def words(text: Column, kind: str) -> Column:
        lower = F.translate(text, UPPER, LOWER)
        return F.transform(F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.when(x.rlike(r"^\d+$"), F.lit("#")).otherwise(x)))

    return F.array_distinct(F.concat(
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)), words(F.col(host), "part:"),
        words(F.col(path), "path:"), words(query, "query:")))


def needed_share(base: float, lift: float) -> float:
    """Share of bad URLs that stands out from the share ``base`` of all: ``lift`` times as many bad or as few good ones.

    The lower of both is taken; the second is below 1 as long as any URL is good.
    """
    return min(lift * base, 1 - (1 - base) / lift)


def mine_rules(labelled: DataFrame, support: float, least: int, confidence: float, lift: float) -> DataFrame:
    """labelled: tokens array<string>, bad boolean. Returns tokens, rare (the token the rule is indexed by), confidence, hits.

    Kept are token sets on at least ``support`` of the labelled URLs (and ``least``), of which at least ``confidence``
    and ``needed_share`` are bad; a set with a subset that does as well is left out. Tokens on the same
    URLs exactly are mined as one item, so copies of a long URL do not multiply into all subsets of its tokens.
    """
    numbered = written(labelled.where(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    total, bad = numbered.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("int"))).first()
    if not total or not bad:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, rare string, confidence double, hits bigint")
    used = (numbered.select("row", F.explode("tokens").alias("token")).groupBy("token")
            .agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(row))").alias("where")).where((F.col("n") >= max(least, support * total)) & (F.col("n") < 0.98 * total)))
    items = written(used.withColumn("item", F.min("token").over(Window.partitionBy("n", "where"))), "items")
    rows = numbered.select("row", "bad", F.explode("tokens").alias("token")).join(items.where("token = item").select("item", "n"), F.col("token") == F.col("item"))
    baskets = rows.groupBy("row").agg(F.collect_set("item").alias("found"), F.first("bad").alias("bad"))
    baskets = written(baskets.select(F.when(F.col("bad"), F.array_append("found", F.lit(BAD))).otherwise(F.col("found")).alias("items")), "baskets")
    n = baskets.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, rare string, confidence double, hits bigint")
    sure = max(confidence, needed_share(bad / total, lift))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, sure * max(least, support * total) / n), minConfidence=sure).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD))
    hits = F.round(F.col("support") * n / F.col("confidence")).cast("bigint")
    rules = written(rules.select(F.array_sort("antecedent").alias("items"), "confidence", hits.alias("hits")).where(F.col("hits") >= max(least, support * total)), "rules")
    smaller = rules.select(F.col("items").alias("sub"), F.col("confidence").alias("as_good"))
    by_item = rules.select("items", "confidence", F.explode("items").alias("item")).join(smaller.withColumn("item", F.element_at("sub", 1)), "item")
    worse = by_item.where((F.size("sub") < F.size("items")) & (F.col("as_good") >= F.col("confidence")) & (F.size(F.array_except("sub", "items")) == 0)).select("items").distinct()
    kept = rules.join(worse, "items", "left_anti")
    rare = kept.select("items", "confidence", "hits", F.explode("items").alias("item")).join(items.where("token = item").select("item", "n"), "item")
    return rare.groupBy("items", "confidence", "hits").agg(F.min_by("item", F.struct("n", "item")).alias("rare")).select(F.col("items").alias("tokens"), "rare", "confidence", "hits")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], *, support: float = 0.001, least: int = 10, confidence: float = 0.5, lift: float = 2.0) -> DataFrame:
    """pages: page_id, url; labels: page_id, bad boolean; rules: (verdict, host, path).

    Returns page_id, host, path, rule (host and path of the rule that decided, else null), verdict (allow or block),
    confidence (of the best mined rule met, else null), a row for each page. A rule fits its host and all subdomains if
    the URL's path starts with the rule's; the longest wins, of equals the first given. Where none fits, a mined rule
    blocks and otherwise the page is allowed. Null and malformed URLs have an empty host and path and are allowed.
    Labels that are null or of unknown pages are ignored; a page with several is bad if one says so.
    """
    host, path = host_and_path("url")
    parsed = written(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", host.alias("host"), path.alias("path"))
                     .withColumn("tokens", url_tokens("url", "host", "path")).drop("url"), "urls")
    known = labels.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined = written(mine_rules(parsed.join(known, "page_id"), support, least, confidence, lift), "mined")
    met = (parsed.select("row", "tokens", F.explode("tokens").alias("rare")).join(mined.withColumnRenamed("tokens", "needed"), "rare")
           .where(F.size(F.array_except("needed", "tokens")) == 0).groupBy("row").agg(F.max("confidence").alias("confidence")))
    hand = verdict = None
    for decision, where, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == where) | F.col("host").endswith("." + where)) & F.col("path").startswith(start)
        hand = F.when(fits, where + start) if hand is None else hand.when(fits, where + start)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    hand = F.lit(None).cast("string") if hand is None else hand
    verdict = F.lit(None).cast("string") if verdict is None else verdict
    by_method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return parsed.join(met, "row", "left").select("page_id", "host", "path", hand.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "confidence")
