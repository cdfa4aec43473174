"""Dates as the lists print them; strings in, ISO strings out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
NAMED = r"(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),\s*(\d{4})"


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def slash_date(s: Column) -> Column:
    """M/D/YYYY to ISO without a check of the ranges; other text as it is, cleaned; null if empty."""
    c, p = clean(s), r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    return F.when(c.rlike(p), _iso(F.regexp_extract(c, p, 3), F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2))).otherwise(c)


def named_date(s: Column) -> Column:
    """The first "Month D, YYYY" of a text, or null."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(s, NAMED, 1)).cast("string")
    return F.when(s.rlike(NAMED), _iso(F.regexp_extract(s, NAMED, 3), month, F.regexp_extract(s, NAMED, 2)))


def day_month_date(s: Column) -> Column:
    """"16 Dec 2021" to ISO, null if it is no date."""
    return F.date_format(F.try_to_date(s, "d MMM yyyy"), "yyyy-MM-dd")


def checked_date(s: Column) -> Column:
    """M/D/YYYY or M/D/YY (69 to 99 are 19xx) to ISO, null if it is no date."""
    p = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
    year = F.regexp_extract(s, p, 3)
    full = F.when(F.length(year) == 4, year).when(year >= "69", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    iso = _iso(full, F.regexp_extract(s, p, 1), F.regexp_extract(s, p, 2))
    return F.when(s.rlike(p), F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))


def updates(s: Column) -> Column:
    """Number and last of the dates in a cell beyond the first, as a note; null for one date or none."""
    every = F.regexp_extract_all(s, F.lit(f"({NAMED})"), F.lit(1))
    last = F.regexp_replace(F.element_at(every, -1), NAMED, "$1 $2, $3")
    return F.when(F.size(every) > 1, F.concat(F.lit("[Entry updated "), (F.size(every) - 1).cast("string"), F.lit(" time(s), most recently "), last, F.lit("]")))
