"""Order-dependent operators: carry-forward, blocks, clusters and segments, as windows within a file, page or block.

Every window is partitioned by what the caller names (a file, page or block), so a task holds one of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.folds import scanned


def _upto(by: list[str], ord: list):
    return Window.partitionBy(*by).orderBy(*ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def block_number(df: DataFrame, starts: Column, *, by: list[str], ord: list, name: str = "blk") -> DataFrame:
    """Adds the running number of rows where `starts` holds: 0 before the first."""
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(_upto(by, ord)))


def block_number_in_chunks(df: DataFrame, starts: Column, *, by: list[str], ord: str, name: str = "blk", chunk: int = 1024) -> DataFrame:
    """As block_number, for a group of any size: rows are counted in chunks of ord (a number), and the chunks before a chunk are added."""
    whole = df.withColumn("_s", F.coalesce(starts, F.lit(False)).cast("long")).withColumn("_c", F.floor(F.col(ord) / chunk))
    sums = whole.groupBy(*by, "_c").agg(F.sum("_s").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("_s").over(_upto([*by, "_c"], [ord]))
    return whole.join(sums, [*by, "_c"]).withColumn(name, F.col("_before") + inside).drop("_s", "_c", "_before")


def carry_forward(df: DataFrame, value: Column, *, by: list[str], ord: list, name: str) -> DataFrame:
    """Adds the last non-null `value` up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_upto(by, ord)))


def first_members(df: DataFrame, member: Column, limit: Column, *, by: list[str], ord: list, name: str = "tagged") -> DataFrame:
    """Adds whether a row is among the first `limit` member rows of its block."""
    rank = F.sum(member.cast("int")).over(_upto(by, ord))
    return df.withColumn(name, member & (rank <= limit))


def gap_clusters(df: DataFrame, position: str, gap: float, *, by: list[str], name: str = "cluster") -> DataFrame:
    """Adds a number that grows where a row lies more than `gap` below the one before; positions fall."""
    order = Window.partitionBy(*by).orderBy(F.col(position).desc())
    wide = F.coalesce(F.lag(position).over(order) - F.col(position) > gap, F.lit(False))
    return df.withColumn("_wide", wide.cast("int")).withColumn(name, F.sum("_wide").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_wide")


def anchor_clusters(df: DataFrame, position: str, tolerance: float, *, by: list[str], name: str = "cluster") -> DataFrame:
    """Adds a number for rows within `tolerance` of their cluster's first row, its anchor; positions fall.

    Which rows are anchors is sequential: a fold over each page's distinct positions, linear in them, keeps the anchor in force and its number.
    """
    state = "struct<anchor:double,no:int>"
    places = df.groupBy(*by).agg(F.sort_array(F.collect_set(F.col(position).cast("double")), asc=False).alias("_all"))

    def step(s: Column, p: Column) -> Column:
        return F.when((s["no"] == 0) | (s["anchor"] - p >= tolerance), F.struct(p.alias("anchor"), (s["no"] + 1).alias("no"))).otherwise(s)

    start = F.struct(F.lit(0.0).alias("anchor"), F.lit(0).alias("no"))
    numbers = F.transform(scanned(F.col("_all"), start, step, state), lambda s: s["no"])
    numbered = places.select(*by, F.inline(F.arrays_zip(F.col("_all").alias("_at"), numbers.alias(name))))
    keyed = df.withColumn("_at", F.col(position).cast("double"))
    return keyed.join(numbered, [*by, "_at"], "left").drop("_at")


def run_machine(df: DataFrame, kind: Column, table: list[list[int]], *, by: list[str], ord: str, name: str = "state", chunk: int = 1024) -> DataFrame:
    """(by, ord, kind, state): the state before each row of a finite machine that begins in state 0 with each group's first row; table[kind][state] is the next.

    What a stretch of rows does to every state is a short array, and such arrays compose, so a group need not be in one task: each chunk of
    rows (by ord, a number) gives its array; the arrays of a group's chunks, a thousandth of its rows, give the state that each chunk begins in; chunks are
    then walked from there.
    """
    states = len(table[0])
    flat = F.array(*[F.lit(x) for row in table for x in row])
    after = lambda k, s: F.get(flat, k * states + s)
    whole = df.withColumn("_k", kind).withColumn("_c", F.floor(F.col(ord) / chunk))
    kinds = F.sort_array(F.collect_list(F.struct(F.col(ord).alias("o"), F.col("_k").alias("k"))))
    chunks = whole.groupBy(*by, "_c").agg(kinds.alias("_rows"))
    each = F.array(*[F.lit(s) for s in range(states)])
    effect = F.aggregate("_rows", each, lambda acc, r: F.transform(acc, lambda s: after(r["k"], s)))
    effects = chunks.select(*by, "_c", effect.alias("_does"))
    in_order = effects.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_c", "_does"))).alias("_all"))
    behind = scanned(F.transform("_all", lambda x: x["_does"]), F.lit(0), lambda s, does: F.get(does, s), "int")
    begins = in_order.select(*by, F.inline(F.arrays_zip(F.transform("_all", lambda x: x["_c"]).alias("_c"), F.concat(F.array(F.lit(0)), behind).alias("_begin")))).filter("_c IS NOT NULL")
    walked = chunks.join(begins, [*by, "_c"])
    states_behind = scanned(F.transform("_rows", lambda r: r["k"]), F.col("_begin"), lambda s, k: after(k, s), "int")
    before = F.concat(F.array("_begin"), states_behind)
    columns = F.arrays_zip(F.transform("_rows", lambda r: r["o"]).alias(ord), F.transform("_rows", lambda r: r["k"]).alias("kind"), before.alias(name))
    return walked.select(*by, F.inline(columns)).filter(F.col(ord).isNotNull())


def largest_gap(df: DataFrame, position: str, anchor: Column, *, by: list[str]) -> DataFrame:
    """For each anchor row and the next one below: the middle of the widest gap between neighbouring rows in between, the first on ties."""
    order = Window.partitionBy(*by).orderBy(F.col(position).desc())
    numbered = df.withColumn("_next", F.lead(position).over(order)).withColumn("_a", F.sum(anchor.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = Window.partitionBy(*by)
    inside = numbered.withColumn("_n", F.max("_a").over(last)).filter((F.col("_a") > 0) & (F.col("_a") < F.col("_n")) & F.col("_next").isNotNull())
    return inside.groupBy(*by, F.col("_a").alias("anchor_no")).agg(F.max_by((F.col(position) + F.col("_next")) / 2, F.struct(F.col(position) - F.col("_next"), F.col(position))).alias("boundary"))


def cells(lines: DataFrame, *, by: list[str], ord: str = "ord", line: str = "line") -> DataFrame:
    """Table cells of tabbed text: a line that begins with a tab opens one, others go on; what comes before the first is dropped."""
    numbered = block_number(lines, F.col(line).startswith("\t"), by=by, ord=[ord], name="cell")
    text = F.trim(F.regexp_replace(line, r"[\t\r]", " "))
    kept = numbered.filter((F.col("cell") > 0)).withColumn("_t", text)
    rows = F.transform(F.sort_array(F.collect_list(F.when(F.col("_t") != "", F.struct(F.col(ord).alias("o"), F.col("_t").alias("t"))))), lambda x: x["t"])
    return kept.groupBy(*by, "cell").agg(rows.alias("lines")).withColumn("text", F.array_join("lines", "\n"))


def bullets(df: DataFrame, text: str, *, mark: str = "•") -> DataFrame:
    """Adds (pos, bullet, heading) for each part between marks: the bullet ends at the last ").", the next heading follows. The first part is a heading alone."""
    out = df.select("*", F.posexplode(F.split(text, mark, -1)).alias("pos", "_part"))
    ends = r"(?s)^(.*\)\.)(.*)$"
    whole = F.regexp_extract("_part", ends, 1)
    return out.withColumn("bullet", F.when(F.col("pos") == 0, "").when(whole != "", F.trim(whole)).otherwise(F.trim("_part"))).withColumn("heading", F.when(F.col("pos") == 0, F.trim("_part")).otherwise(F.trim(F.regexp_extract("_part", ends, 2)))).drop("_part")


def segments(df: DataFrame, text: str, end: str) -> DataFrame:
    """Adds (pos, segment) for each stretch up to a match of `end`, inclusive; what follows the last is left out."""
    return df.select("*", F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s)(.*?(?:{end}))"), F.lit(1))).alias("pos", "segment"))
