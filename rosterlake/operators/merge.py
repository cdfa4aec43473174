"""Merges of records that keep first-appearance order. Rows carry `ord`, their place in the source.

A group is one party's records, so its arrays are short; only a party that fills the source could make one long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_value(c: str, ord: str = "ord") -> Column:
    """The value of the first row."""
    return F.min_by(c, ord)


def first_filled(c: str, ord: str = "ord") -> Column:
    """The first value that is neither null nor empty."""
    return F.min_by(c, F.when(F.col(c) != "", F.col(ord)))


def last_filled(c: str, ord: str = "ord") -> Column:
    """The last value that is neither null nor empty."""
    return F.max_by(c, F.when(F.col(c) != "", F.col(ord)))


def longest(c: str, ord: str = "ord") -> Column:
    """The longest value, the first of them on ties."""
    return F.max_by(c, F.struct(F.length(c), -F.col(ord)))


def in_order(c: Column | str, ord: str = "ord") -> Column:
    """All values as an array, by ord."""
    value = F.col(c) if isinstance(c, str) else c
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(ord).alias("o"), value.alias("v")))), lambda x: x["v"])


def joined(c: str, sep: str, ord: str = "ord") -> Column:
    return F.array_join(in_order(c, ord), sep)


def distinct_ignoring_case(a: Column) -> Column:
    """Distinct by lower case, the first spelling kept, in order of appearance."""
    return F.aggregate(a, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def notes_not_contained(notes: Column, sep: str = " | ") -> Column:
    """Notes joined in order, one left out where the text so far contains it."""
    return F.nullif(F.aggregate(notes, F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.contains(acc, x), acc).otherwise(F.concat(acc, F.lit(sep), x))), F.lit(""))


def set_key(a: Column) -> Column:
    """The distinct members, sorted: equal for equal sets."""
    return F.array_sort(F.array_distinct(a))


def merge_saved(rows: DataFrame) -> DataFrame:
    """One record for each lower-cased name: aliases united, notes appended unless contained. rows: name, aliases, notes (array), ord."""
    return rows.groupBy(F.lower("name").alias("k")).agg(
        F.min("ord").alias("ord"), first_value("name").alias("name"), F.array_distinct(F.flatten(in_order("aliases"))).alias("aliases"), notes_not_contained(F.flatten(in_order("notes"))).alias("notes")
    ).drop("k")


def merge_live(rows: DataFrame) -> DataFrame:
    """One record for each lower-cased name: distinct aliases, then categories and extras as notes. rows: name, aliases, category, extra, effective_date, ord."""
    filled = lambda c: F.filter(F.array_distinct(in_order(c)), lambda x: x != "")
    return rows.groupBy(F.lower("name").alias("k")).agg(
        F.min("ord").alias("ord"), first_value("name").alias("name"), F.array_distinct(F.flatten(in_order("aliases"))).alias("aliases"), first_value("effective_date").alias("effective_date"),
        F.nullif(F.array_join(F.concat(filled("category"), filled("extra")), "; "), F.lit("")).alias("notes"),
    ).drop("k")


def merge_actions(actions: DataFrame, key: Column) -> DataFrame:
    """One record for each party over its sanction actions. actions: name, aliases, location, date, fr, note, extra, ord."""
    return actions.groupBy(key.alias("k")).agg(
        F.min("ord").alias("ord"), first_value("name").alias("name"), distinct_ignoring_case(F.flatten(in_order("aliases"))).alias("aliases"), first_filled("location").alias("location"),
        first_value("date").alias("date"), first_value("fr").alias("federal_register"), in_order("note").alias("notes"), first_filled("extra").alias("extra"),
    ).drop("k")
