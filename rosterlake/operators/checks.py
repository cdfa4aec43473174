"""Checks of an extract as DataFrames: each gives the rows or counts that a person would look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SourceError(RuntimeError):
    """A source is missing, empty or not of the form it must have."""


def quality(entities: DataFrame) -> DataFrame:
    multi = F.length(F.regexp_replace(F.coalesce("notes", F.lit("")), "UFLPA Sec\\.", "")) + 2 * len("UFLPA Sec.") <= F.length(F.coalesce("notes", F.lit("")))
    return entities.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("country").alias("countries"), F.count_if(F.size("aliases") > 0).alias("with_alias"), F.count_if(F.col("name").rlike(r"\s\d{1,2}$")).alias("ends_in_digits"),
        F.count_if(F.coalesce("notes", F.lit("")).startswith("Subordinate institution of")).alias("subordinate"), F.count_if(multi).alias("several_categories"),
    )


def countries(entities: DataFrame) -> DataFrame:
    return entities.agg(F.array_sort(F.collect_set("country")).alias("countries"))


def probes(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """How often each expected name (a table of names) occurs, 0 included."""
    hits = entities.groupBy("name").agg(F.count(F.lit(1)).alias("hits"))
    return asked.select("name").distinct().join(hits, "name", "left").select("name", F.coalesce("hits", F.lit(0)).alias("hits"))


def repeated(entities: DataFrame, *keys: str) -> DataFrame:
    return entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def document_frequency(docs: DataFrame, id: str, words: Column) -> DataFrame:
    """(w, df): in how many ids each word stands. Whether ids repeat is asked of their column alone; if none does, words are counted map-side as
    they are read. Only rows of ids that do repeat are made distinct by (id, word) first."""
    each = docs.select(F.col(id).alias("id"), F.array_distinct(words).alias("ws"))
    again = docs.groupBy(F.col(id).alias("id")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id")
    count = lambda rows: rows.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    if again.isEmpty():
        return count(each.select(F.explode("ws").alias("w")))
    same = each["id"].eqNullSafe(again["id"])
    single = each.join(again, same, "left_anti").select(F.explode("ws").alias("w"))
    many = each.join(again, same, "left_semi").select("id", F.explode("ws").alias("w")).distinct().select("w")
    return count(single.unionByName(many))


def with_repeated(rows: DataFrame, name: str, key: Column, *within: Column, match: Column | None = None) -> DataFrame:
    """Adds whether `match` (default: the key) is a key that occurs more than once together with equal values of `within` anywhere."""
    keyed = rows.withColumn("_key", key).withColumn("_match", key if match is None else match).withColumns({f"_w{i}": w for i, w in enumerate(within)})
    again = keyed.groupBy("_key", *[f"_w{i}" for i in range(len(within))]).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_key").alias("_match")).distinct().withColumn(name, F.lit(True))
    return keyed.join(again, "_match", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_key", "_match", *[f"_w{i}" for i in range(len(within))])


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise SourceError(f"nothing was extracted from {what}")
    return df


def sample(entities: DataFrame, n: int = 6, seed: int = 4, *, key: Column | None = None) -> DataFrame:
    """n rows drawn by the hash of `key` (default: the whole row) with the seed: the same ones for any partitioning and order of the rows.

    Each task keeps n rows at most, and these meet in one.
    """
    own = F.to_json(F.struct(*entities.columns)) if key is None else key.cast("string")
    return entities.withColumns({"_h": F.md5(F.concat(F.lit(f"{seed}|"), own).cast("binary")), "_k": own}).orderBy("_h", "_k").limit(n).drop("_h", "_k")


def ends(entities: DataFrame, n: int = 3, *, ord: str = "ord") -> DataFrame:
    """The first and the last n rows in order, with the end (first, last) that they are at: two top-n, no sort of all."""
    of = lambda name, by: entities.orderBy(by).limit(n).withColumn("end", F.lit(name))
    return of("first", F.asc(ord)).unionByName(of("last", F.desc(ord)))
