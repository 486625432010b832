"""Document keys, identifiers, addresses and what can be read off them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_words, let

# Letters in a key, tried in this order.
KEY_LETTERS = (("R", "regulation"), ("L", "directive"), ("D", "decision"), ("Q", "recommendation"))

# Subject and form words looked for in keywords and summary.
SUBJECT_TERMS = {
    "data protection": ("data protection", "gdpr"),
    "privacy": ("privacy",),
    "financial": ("financial", "banking", "credit", "loan", "investment"),
    "environment": ("environment", "climate", "emission", "pollution"),
    "health": ("health", "medical", "medicine", "patient"),
}
FORM_TERMS = ("regulation", "directive", "decision")
DEFAULT_FORM = "legal text"

# Subjects looked for in document text, in this order.
KNOWN_SUBJECTS = (
    "Agriculture", "Fisheries", "Environment", "Climate Change", "Energy", "Transport", "Competition",
    "Internal Market", "Taxation", "Economic Policy", "Foreign Policy", "Justice", "Migration", "Health",
    "Consumer Protection", "Education", "Culture", "Employment", "Social Policy", "Research", "Technology",
    "Digital", "Food Safety", "Financial Services", "Trade", "Industrial Policy", "Regional Development",
    "Human Rights", "Security", "Defence", "Customs", "Banking", "Insurance", "Telecommunications",
    "Data Protection", "Intellectual Property",
)

# Defaults by first character of the key.
TITLE_PREFIX = {"3": "EU Regulation", "1": "EU Treaty", "2": "EU Directive", "4": "EU Agreement"}
SUBJECT_PREFIX = {"3": "Legal Affairs", "5": "External Relations"}
OTHER_TITLE, OTHER_SUBJECT = "EU Legal Document", "EU Legislation"

# Address of the publisher; pass your own as ``base``.
BASE_URL = "https://publisher.example"


def contains_any(c: Column, terms) -> Column:
    test = F.lit(False)
    for term in terms:
        test = test | c.contains(term)
    return test


def document_type(key: Column) -> Column:
    out = F.when(key.contains(KEY_LETTERS[0][0]), KEY_LETTERS[0][1])
    for letter, name in KEY_LETTERS[1:]:
        out = out.when(key.contains(letter), name)
    return out.otherwise("other")


def subjects(keywords: Column, summary: Column, terms: dict[str, tuple[str, ...]] = SUBJECT_TERMS) -> Column:
    """Subjects whose terms occur in the keywords or the summary; ``general`` when there is none."""

    def look(both: Column) -> Column:
        hits = F.array_compact(F.array(*(F.when(contains_any(both, ts), F.lit(s)) for s, ts in terms.items())))
        return let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.lit("general"))))

    return let(F.lower(F.concat_ws("\n", keywords, summary)), look)


def form_of(summary: Column) -> Column:
    low = F.lower(F.coalesce(summary, F.lit("")))
    out = F.when(low.contains(FORM_TERMS[0]), FORM_TERMS[0])
    for term in FORM_TERMS[1:]:
        out = out.when(low.contains(term), term)
    return out.otherwise(DEFAULT_FORM)


def title_or_fallback(title: Column, summary: Column, key: Column) -> Column:
    """Given title, else first non-blank summary line, else a first sentence over 10 characters, else the key."""
    lines = F.filter(F.transform(F.split(summary, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    sentence = F.split_part(summary, F.lit("."), F.lit(1))
    return F.coalesce(
        F.when(F.trim(title) != "", title),
        F.get(lines, 0),
        F.when(F.length(sentence) > 10, F.concat(sentence, F.lit("."))),
        F.concat(F.lit("Document "), key),
    )


def default_title(title: Column, key: Column) -> Column:
    prefix = None
    for digit, name in TITLE_PREFIX.items():
        test = key.startswith(digit)
        prefix = F.when(test, name) if prefix is None else prefix.when(test, name)
    prefix = prefix.otherwise(OTHER_TITLE)
    return F.coalesce(F.when(F.trim(title) != "", title), F.concat_ws(" ", prefix, key))


def default_subject(key: Column) -> Column:
    return (
        F.when(key.startswith("3"), SUBJECT_PREFIX["3"])
        .when(key.startswith("5"), SUBJECT_PREFIX["5"])
        .otherwise(OTHER_SUBJECT)
    )


def matched_subjects(text: Column, known=KNOWN_SUBJECTS, limit: int = 5) -> Column:
    """Known subjects named in the text, first ``limit`` in list order."""
    hits = lambda low: F.array_compact(F.array(*(F.when(low.contains(s.lower()), F.lit(s)) for s in known)))
    return F.slice(let(F.lower(text), hits), 1, limit)


def key_year(key: Column) -> Column:
    """Year at characters 2-5 when plausible, else the first 19xx/20xx found."""
    own = F.try_to_number(F.when(F.substring(key, 2, 4).rlike(r"^\d{4}$"), F.substring(key, 2, 4)), F.lit("9999")).cast("int")
    found = F.nullif(F.regexp_extract(key, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    return F.coalesce(F.when(own.between(1950, 2030), own), found)


def key_url(key: Column, base: str = BASE_URL) -> Column:
    return F.concat(F.lit(f"{base}/legal-content/EN/TXT/?uri=CELEX:"), key)


def journal_url(d: Column, base: str = BASE_URL) -> Column:
    return F.concat(F.lit(f"{base}/oj/daily-view/L-series/default.html?ojDate="), F.date_format(d, "ddMMyyyy"))


def document_url(doc_id: Column, view: str = "ALL", base: str = BASE_URL) -> Column:
    part = "ALL" if view == "ALL" else "TXT/PDF" if view == "PDF" else "TXT"
    return F.concat(F.lit(f"{base}/legal-content/EN/{part}/?uri=OJ:L_"), doc_id)


def is_document_id(c: Column) -> Column:
    """Nine characters after an optional ``L_``, four leading digits, and no corrigendum mark (9) in fifth place."""
    bare = F.regexp_replace(c, "^L_", "")
    good = (F.length(bare) == 9) & bare.rlike(r"^\d{4}") & (F.substring(bare, 5, 1) != "9")
    return F.coalesce(good, F.lit(False))


def clean_identifier(c: Column) -> Column:
    """Identifier kept only in its standard form, else blank."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return F.when(bare.rlike(r"^[A-Z]/\d{4}/\d+(/[A-Z]+)?$"), bare).otherwise(F.lit(""))


def is_test_row(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.upper(c.cast("string")).startswith("TEST"), F.lit(False))
    return out


def request_key(params: Column) -> Column:
    """Stable text key of a parameter map: sorted ``k:v`` pairs joined by ``|``."""
    pairs = F.transform(F.map_entries(params), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return F.array_join(F.sort_array(pairs), "|")


def industry(client: Column) -> Column:
    return F.split_part(client, F.lit("_"), F.lit(1))


def profile_query(description: Column, categories: Column) -> Column:
    """First 20 words of the expert text, else the first three categories."""
    words = first_words(description, 20)
    return F.coalesce(F.when(words != "", words), F.array_join(F.slice(categories, 1, 3), " "))


def default_description(description: Column, client: Column) -> Column:
    made = F.format_string("Client profile for %s in the %s industry", client, industry(client))
    return F.coalesce(F.when(F.trim(description) != "", description), made)
