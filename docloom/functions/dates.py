"""Date parsing cascades and date display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats, in order of preference.
INGEST_FORMATS = ("dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd")
RANKER_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy", "yyyy-MM", "MMM d, yyyy", "d MMM yyyy",
)
RESULT_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd")
INGEST_START = "2023-10-02"


def parse_date(c: Column, formats: Sequence[str] = INGEST_FORMATS) -> Column:
    """First format that fits; NULL when none does."""
    return F.coalesce(*(F.try_to_date(c, f) for f in formats))


def first_date(columns: Sequence[Column], formats: Sequence[str] = RESULT_FORMATS) -> Column:
    """First column, in order, holding a readable date."""
    return F.coalesce(*(parse_date(c, formats) for c in columns))


def display_date(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.lit("N/A"))


def date_from_path(path: Column, modified: Column | None = None) -> Column:
    """Date of a stored file: y/m/d folders, else an 8-digit folder, else modification time, else 1970-01-01."""
    folders = r"(?:^|/)(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$)"
    ymd = F.concat_ws(
        "-",
        F.regexp_extract(path, folders, 1),
        F.lpad(F.regexp_extract(path, folders, 2), 2, "0"),
        F.lpad(F.regexp_extract(path, folders, 3), 2, "0"),
    )
    compact = F.regexp_extract(path, r"(?:^|/)(\d{8})(?:/|$)", 1)
    options = [F.try_to_date(ymd, "yyyy-MM-dd"), F.try_to_date(compact, "yyyyMMdd")]
    if modified is not None:
        options.append(F.to_date(modified))
    return F.coalesce(*options, F.lit("1970-01-01").cast("date"))


def check_range(start: str, end: str, earliest: str = INGEST_START) -> None:
    if start < earliest:
        raise ValueError(f"start {start} lies before {earliest}")
    if end < start:
        raise ValueError(f"end {end} lies before start {start}")
