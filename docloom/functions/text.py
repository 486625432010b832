"""Text measures, cleaning, tokens and sentence splitting as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Document-length tiers (upper bounds in words).
TIER_BOUNDS = (600, 2500, 20000)

# Summary length ranges (words) by input length.
SHORT_RANGES = ((150, 15, 50), (300, 50, 100), (600, 100, 200))
LONG_RANGES = ((20000, 480, 600), (None, 600, 800))

# English function words left out of token statistics; pass another list where needed.
STOP_WORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below
    between both but by can did do does doing down during each few for from further had has have having he
    her here hers him his how i if in into is it its itself just me more most my no nor not now of off on
    once only or other our ours out over own same she should so some such than that the their theirs them
    then there these they this those through to too under until up very was we were what when where which
    while who whom why will with you your yours""".split()
)

BLANKS = " \t\r\n"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def word_count(c: Column) -> Column:
    """Whitespace-separated tokens; empty or missing text counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def tier(n: Column) -> Column:
    small, medium, large = TIER_BOUNDS
    return F.when(n <= small, 1).when(n <= medium, 2).when(n <= large, 3).otherwise(4)


def tier_range(t: int, open_top: int | None = None) -> tuple[int, int | None]:
    """Inclusive word range of a tier; the top tier is open unless a bound is given."""
    edges = (0, *(b + 1 for b in TIER_BOUNDS))
    tops = (*TIER_BOUNDS, open_top)
    return edges[t - 1], tops[t - 1]


def in_tier(n: Column, t: int, open_top: int | None = None) -> Column:
    low, high = tier_range(t, open_top)
    return n >= low if high is None else n.between(low, high)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def is_valid_section(c: Column) -> Column:
    """Text with at least one run of two Latin letters; that also rules out digits-and-punctuation text."""
    return F.coalesce(c.rlike("[a-zA-Z]{2,}"), F.lit(False))


def clean_legal_text(c: Column) -> Column:
    """Drop web addresses and control characters, collapse blanks and empty lines, blank out invalid text."""
    # Fixed value: characters that may follow the start of a web address.
    address = r"[!$-_a-z]+"
    steps = (
        (r"https?://" + address, ""),
        (r"www\." + address, ""),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
        (r"[ \t]+", " "),
        (r"\n\s*\n", "\n\n"),
        (r"\n\s+", "\n"),
    )
    out = F.coalesce(c, F.lit(""))
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return let(strip(out), lambda t: F.when(is_valid_section(t), t).otherwise(F.lit("")))


def distinct_lines(c: Column) -> Column:
    """Strip every line, drop blank and repeated lines, keep first order."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.array_join(F.array_distinct(lines), "\n")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def summary_range(n: Column) -> tuple[Column, Column]:
    """(min, max) summary words for an input of n words."""
    low = high = None
    for top, a, b in SHORT_RANGES:
        low = F.when(n <= top, a) if low is None else low.when(n <= top, a)
        high = F.when(n <= top, b) if high is None else high.when(n <= top, b)
    k = extraction_target(n)
    low = low.when(n <= TIER_BOUNDS[1], F.floor(k * 0.6).cast("int"))
    high = high.when(n <= TIER_BOUNDS[1], F.floor(k * 0.8).cast("int"))
    (top, a, b), (_, c, d) = LONG_RANGES
    return low.when(n <= top, a).otherwise(c), high.when(n <= top, b).otherwise(d)


def extraction_target(n: Column) -> Column:
    """Second-tier extract length: 30 % of the words, held within 300..600."""
    return F.greatest(F.lit(300), F.least(F.floor(n * 0.3), F.lit(600))).cast("int")


def keyword_budget(n: Column) -> Column:
    """Keywords to keep for n words: 2.5 ln n - 4.77, clipped to 2..15, then truncated."""
    raw = F.lit(2.5) * F.ln(F.greatest(n, F.lit(1)).cast("double")) - F.lit(4.77)
    return F.greatest(F.lit(2.0), F.least(F.lit(15.0), raw)).cast("int")


def balanced_chunk_size(n: Column, smallest: int = 100, largest: int = 400) -> Column:
    pieces = F.greatest(F.lit(1), F.floor(n / largest))
    size = F.greatest(F.lit(smallest), F.least(F.floor(n / pieces), F.lit(largest)))
    return F.when(n <= smallest, n).otherwise(size).cast("int")


def tokens(c: Column, stop: Sequence[str] | None = STOP_WORDS, min_len: int = 1) -> Column:
    """Lower-cased runs of letters and digits, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if min_len > 1:
        found = F.filter(found, lambda t: F.length(t) >= min_len)
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found



def alphabetic_tokens(c: Column, stop: Sequence[str] | None = STOP_WORDS) -> Column:
    return F.filter(tokens(c, stop), lambda t: t.rlike(r"^\p{L}+$"))


def keyword_words(c: Column, stop: Sequence[str] | None = STOP_WORDS) -> Column:
    """Distinct words of a comma-separated keyword string."""
    return F.array_distinct(tokens(F.regexp_replace(c, ",", " "), stop))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once. A lambda re-evaluates every outer expression per element; this binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(toks: Column, n: int) -> Column:
    """Adjacent n-grams of a token array, in order."""
    if n == 1:
        return toks

    def build(t: Column) -> Column:
        last = F.size(t) - n
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(t, i, n), " ")
        )
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    return let(toks, build)


def sentences(c: Column) -> Column:
    """Split after sentence-ending punctuation followed by white space; punctuation is kept."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def term_counts(toks: Column, kind: str = "string") -> Column:
    """array<struct<term,tf>> of an array: sort once, mark where runs start, read off run lengths (no shuffle)."""

    def runs(o: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast(kind)), o)
        marks = F.zip_with(o, F.slice(before, 1, F.size(o)), lambda cur, prev: ~cur.eqNullSafe(prev))
        flagged = F.transform(marks, lambda new, i: F.when(new, i + 1))
        return let(F.array_compact(flagged), lambda starts: spans(o, starts))

    def spans(o: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(o) + 1))
        return F.zip_with(
            starts, ends, lambda a, b: F.struct(F.element_at(o, a).alias("term"), (b - a).alias("tf"))
        )

    empty = F.array().cast(f"array<struct<term:{kind},tf:int>>")
    return let(F.sort_array(toks), lambda o: F.when(F.size(o) > 0, runs(o)).otherwise(empty))
