"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations alone.

Targets: the budget is shared by weight; a source never gets more than `cap` times its size, and what it cannot take
goes to the others by weight until none is above. In closed form, sources by the ratio of cap to weight are filled
up to the first that the common level does not fill.

Curriculum: source i has the weight schedule w_i(t) = 1 + a_i (1 - 2t) over the training time t in 0..1, with a_i in
[-1, 1]. Its integral t + a_i t (1 - t), times the target, is the source's cumulative demand. A source's documents lie
in the order of their hashes, one pass after another; inverting the demand where a pass of a document begins and ends
gives the times at which its words are asked for, and what is asked for between them is what the mix takes: all of
its words, some where training ends inside it, none behind that. Documents are range-sorted by position.

Skew: texts are reduced to counts, and rows equal in source, id and size to one with their number, before anything is
shuffled. Words are cumulated in two levels, inside hashed buckets of a source and over the bucket sums, so no source's
rows meet in one task.

Defined cases: null and blank texts have size 0 and are never taken; null sources come last and count as a source;
sources without words have target 0; repeated rows are rows of their own; ties are broken by hash, id and size, and
rows equal in all three are interchangeable; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import native_words, stored, table

#: Equal rows that one array holds.
COPIES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """From (source, size): source_no, source_size, weight and target of each source; one row for each."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1))
    full = F.col("source_size") * F.lit(float(cap))
    filled = Window.orderBy(full / F.col("weight"), F.col("source_no"))
    whole = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    left = F.col("budget") - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    weigh = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weigh).withColumn("fits", F.col("level") * F.col("weight") < full)
    common = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0))
    return per.select("source", "source_no", "source_size", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(common * F.col("weight"), full)).alias("target"))


def training_time(share: Column, slope: Column) -> Column:
    """t in 0..1 with t + a t (1 - t) = share, in the form that is steady for slopes near 0; 1 for shares above 1."""
    b = 1 + slope
    g = F.least(F.lit(1.0), share)
    t = F.try_divide(2 * g, b + F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * slope * g)))
    return F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0)))


def words_by(t: Column, target: Column, slope: Column) -> Column:
    """Whole words that a source is asked for by time t."""
    return F.least(F.round(target * (t + slope * t * (1 - t))), F.floor(target)).cast("long")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, slopes: tuple[float, ...] = (0.5, -0.5, 0.0), digits: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the passes over the document in which words are taken:
    places (position and words of each), and the first and last position."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(native_words(F.col(text))).cast("long").alias("size"))
    plain = plain.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("b", F.substring("h", 1, digits))
    named = plain.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # never null
    cells = stored(named.groupBy("s", "source", "b", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    words = F.col("size") * F.col("n")
    targets = stored(source_targets(cells.select("source", words.alias("size")), weights, share, cap).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source", "weight"), "mix-targets")
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("s", "b").agg(F.sum(words).alias("words")).select("s", "b", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("start"))
    within = Window.partitionBy("s", "b").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = cells.withColumn("into", F.coalesce(F.sum(words).over(within), F.lit(0))).join(starts.join(targets, "s"), ["s", "b"])
    # equal rows are told apart in parts, so that no array is as long as there are of them
    laid = laid.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    copies = F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)
    laid = laid.withColumn("copy", F.explode(copies)).withColumn("at", F.col("start") + F.col("into") + F.col("copy") * F.col("size"))
    laid = laid.withColumn("slope", F.element_at(F.array(*[F.lit(float(a)) for a in slopes]), (F.col("source_no") % len(slopes) + 1).cast("int")))
    time = lambda words: training_time(F.try_divide(words, F.col("target")), F.col("slope"))
    asked = lambda words: words_by(time(words), F.col("target"), F.col("slope"))

    def one(k: Column) -> Column:
        begins = k * F.col("source_size") + F.col("at")
        return F.struct(time(begins).alias("position"), (asked(begins + F.col("size")) - asked(begins)).alias("words"))

    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int") - 1))
    laid = laid.withColumn("places", F.filter(F.transform(passes, one), lambda p: p["words"] > 0))
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "places", F.get("places", F.lit(0))["position"].alias("position"), F.try_element_at("places", F.lit(-1))["position"].alias("last_position"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mix in training order: range-partitioned and sorted by position; what is not taken comes last."""
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("size")]
    return mix(docs, **options).repartitionByRange(*order).sortWithinPartitions(*order)


def passes_in_order(docs: DataFrame, **options) -> DataFrame:
    """A row for each pass over a document in which words are taken, at its own place in training: position and words."""
    order = [F.col("position"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    rows = mix(docs, **options).select("doc_id", "source", "size", F.inline("places"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    places = [F.round(c, 9).alias(c) for c in ("position", "last_position")]
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", *places)


#: Takes whole passes and a part of one, and inverts the integral for the first and the last of them.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT source, n, 2.0::DOUBLE * n AS full_, [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight,
  row_number() OVER (ORDER BY encode(source) NULLS LAST) AS no, 1.5::DOUBLE * sum(n) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(full_) OVER (ORDER BY full_ / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_ / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
c AS (SELECT source, n, full_, weight, no, first_value(CASE WHEN level * weight < full_ THEN level END IGNORE NULLS) OVER (ORDER BY full_ / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS common FROM l),
t AS (SELECT source, n, CASE WHEN n = 0 THEN 0 ELSE coalesce(common * weight, full_) END AS target, [0.5::DOUBLE, -0.5, 0.0][(no - 1) % 3 + 1] AS a FROM c),
p AS (SELECT d.doc_id, d.size, t.n AS source_size, t.target, t.a, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_, CASE WHEN t.n > 0 THEN floor(t.target / t.n) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, least(size, greatest(0, floor(target) - passes * source_size - at_)) AS part FROM p),
r AS (SELECT *, CAST(passes * size + part AS BIGINT) AS taken, CASE WHEN part > 0 THEN passes ELSE passes - 1 END AS last_ FROM q)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(2 * (at_ / target) / (1 + a + sqrt(greatest(0, (1 + a) * (1 + a) - 4 * a * (at_ / target)))), 9) END AS position,
  CASE WHEN taken > 0 THEN round(2 * ((last_ * source_size + at_) / target) / (1 + a + sqrt(greatest(0, (1 + a) * (1 + a) - 4 * a * ((last_ * source_size + at_) / target)))), 9) END AS last_position
FROM r
"""
