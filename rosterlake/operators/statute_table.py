"""Rows of a six-column table from positioned characters, whose columns move from header to header.

Input: lines (path, page, y0, x0, text, chars array<struct<x0 double, ch string>>), x0 null for layout characters. A line
without path, page or place is left out; one that is there twice is read twice.
Header bands are found among the lines near by, in windows of pages; lines are cut into cells page by page, so that only those
above a page's first header take their characters on; which header holds for these, where rows begin and what continues the
row before are windows within a file. Nothing is joined, so no estimate of a size can send lines to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlake.functions.text import collapse_ws, let
from rosterlake.operators import ordered
from rosterlake.session import ship

FIELDS = ["statute", "entity", "location", "date", "status", "fr"]
#: Header words in column order; the first column's place is the line's own. Fixed values.
_WORDS = ["Entity", "Location", "Date", "Status", "Federal"]
ROW_GAP, BOUND, DATE = 17.5, 3.0, r"\d{1,2}/\d{1,2}/\d{2,4}"
#: How far a header's band reaches above and below the line that begins it.
ABOVE, BELOW = 9, 18
_SPACE = r"[\s\x1c-\x1f]"


def _places(chars: Column, y0: Column) -> Column:
    """(y0, and for each header word the x of its occurrences) of a line, white space ignored."""
    seen = F.filter(chars, lambda c: ~c["ch"].rlike(f"(?U)^{_SPACE}+$"))
    line = lambda cs: F.array_join(F.transform(cs, lambda c: c["ch"]), "")
    at = lambda cs, s, w: F.filter(F.transform(cs, lambda c, i: F.when(F.substr(s, i + 1, F.lit(len(w))) == w, c["x0"])), lambda x: x.isNotNull())
    found = let(seen, lambda cs: let(line(cs), lambda s: F.struct(y0.alias("y0"), *[at(cs, s, w).alias(w) for w in _WORDS])))
    return F.when(chars.isNotNull(), found)


def _columns(band: Column, x0: Column) -> Column:
    """Left edges of the six columns from the lines of a header band, null if one is not there."""
    found = {w: F.flatten(F.transform(band, lambda b: b[w])) for w in _WORDS}
    first = {w: F.array_min(x) for w, x in found.items()}
    first["Date"] = F.array_min(F.filter(found["Date"], lambda x: (x > first["Location"] + 20) & (x < first["Status"] - 5)))
    edges = F.array(x0, *[first[w] for w in _WORDS])
    return F.when(F.forall(edges, lambda x: x.isNotNull()), edges)


def _mark_headers(lines: DataFrame) -> DataFrame:
    """Adds the columns that a header's first line states, and whether a line is in a header's band."""
    page, y0 = Window.partitionBy("path", "page").orderBy("y0"), F.col("y0")
    # frames reach one further than bands, whose ends are then compared as they are
    heads, lines_of = page.rangeBetween(-ABOVE - 1, BELOW + 1), page.rangeBetween(-BELOW - 1, ABOVE + 1)
    within = lambda line, head: (F.abs(line - head) <= BELOW) & (line <= head + ABOVE)
    below = lambda is_head: F.exists(F.collect_list(F.when(is_head, y0)).over(heads), lambda head: within(y0, head))
    df = lines.withColumn("begins", F.coalesce(F.col("text").rlike(rf"(?U)^{_SPACE}*Sanction({_SPACE}|\z)"), F.lit(False)))
    df = df.withColumn("near", below(F.col("begins"))).withColumn("places", F.when(F.col("near"), _places(F.col("chars"), y0)))
    df = df.withColumn("band", F.collect_list("places").over(lines_of))
    band = F.filter("band", lambda b: within(b["y0"], y0))
    df = df.withColumn("cols", F.when(F.col("begins"), let(band, lambda b: _columns(b, F.col("x0"))))).drop("places", "band", "near", "begins")
    return df.withColumn("header", below(F.col("cols").isNotNull()))


def _dealt(chars: pa.Array, cols: pa.Array) -> pa.Array:
    """Texts of the columns: a character belongs to the last column that begins at most BOUND right of it; layout characters to the current one."""
    lengths = pc.list_value_length(chars).to_numpy(zero_copy_only=False)
    line, begin = np.repeat(np.arange(len(chars)), lengths), np.repeat(np.cumsum(lengths) - lengths, lengths)
    parts = chars.flatten()
    x0, ch = (dict(zip((f.name for f in parts.type), parts.flatten(), strict=True))[k] for k in ("x0", "ch"))
    x, edges = x0.fill_null(0.0).to_numpy(zero_copy_only=False), cols.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FIELDS))
    at = np.maximum(sum(~(x < edges[line, k] - BOUND) for k in range(len(FIELDS))) - 1, 0)
    last = np.maximum.accumulate(np.where(x0.is_valid().to_numpy(zero_copy_only=False), np.arange(len(x)), -1))
    key = line * len(FIELDS) + np.where(last >= begin, at[last], 0)
    ends = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(chars) * len(FIELDS)))])
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ch.fill_null("").take(pa.array(np.argsort(key, kind="stable")))), "")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(chars) + 1) * len(FIELDS), pa.int32()), texts)


def _cut_lines(df: DataFrame, edges: str) -> DataFrame:
    """Fills cells where there are chars and edges, and leaves no chars there; the edges go."""
    ship(df.sparkSession)
    schema = StructType([f for f in df.schema if f.name != edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, cols, each = b.column("chars"), b.column(edges), np.arange(len(b))
            done = pc.and_(chars.is_valid(), cols.is_valid()).to_numpy(zero_copy_only=False)
            out = {f: b.column(f) for f in schema.names}
            if done.any():
                these = pa.array(np.flatnonzero(done))
                cells = pa.concat_arrays([out["cells"], _dealt(chars.take(these), cols.take(these)).cast(out["cells"].type)])
                out["cells"] = cells.take(pa.array(np.where(done, len(b) + np.cumsum(done) - 1, each)))
                out["chars"] = chars.take(pa.array(each, mask=done))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=schema.names)

    return df.mapInArrow(run, schema)


def _cut(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds k, a line's part of its cluster: parts end in the middle of the widest gap between an anchor and the next one below, the first on ties."""
    down, y0 = Window.partitionBy(*by).orderBy(F.desc("y0")), F.col("y0")
    peers = down.rangeBetween(Window.currentRow, Window.currentRow)
    new = F.coalesce(F.lag("y0").over(down) != y0, F.lit(True))
    df = df.withColumn("_h", (F.max("anchor").over(peers) & new).cast("int")).withColumn("_next", F.lead("y0").over(down))
    df = df.withColumn("_a", F.sum("_h").over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    df = df.withColumn("_n", F.max("_a").over(Window.partitionBy(*by)))
    df = df.withColumn("_b", F.max_by((y0 + F.col("_next")) / 2, F.struct(y0 - F.col("_next"), y0)).over(Window.partitionBy(*by, "_a")))
    under = (F.col("_a") > 0) & (F.col("_a") < F.col("_n")) & (y0 < F.col("_b"))
    return df.withColumn("k", F.greatest(F.col("_a") - 1, F.lit(0)) + under.cast("int")).drop("_h", "_next", "_a", "_n", "_b")


def table_rows(lines: DataFrame) -> DataFrame:
    """(path, ord, page, statute, entity, location, date, status, fr): one row for each row of the table."""
    order = ["page", F.desc("y0"), "x0", "text"]
    df = lines.select("path", F.col("page").cast("int"), F.col("y0").cast("double"), F.col("x0").cast("double"), "text", "chars").filter("path IS NOT NULL AND page IS NOT NULL AND y0 IS NOT NULL AND x0 IS NOT NULL")
    df = _mark_headers(df)
    df = ordered.carry_forward(df, F.col("cols"), by=["path", "page"], ord=order[1:], name="here")
    df = _cut_lines(df.withColumn("cells", F.lit(None).cast("array<string>")), "here")
    is_ = lambda pattern: F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    df = df.withColumn("table", is_(r"^Table \d+\s*[:.]")).withColumn("furniture", is_(r"^Page \d+ of \d+$|^Master Sanctions List|^Updated \w+ \d+, \d{4}$"))
    df = ordered.carry_forward(df, F.col("cols"), by=["path"], ord=order, name="in_force")
    df = ordered.block_number(df, F.col("table") | F.col("cols").isNotNull(), by=["path"], ord=order, name="segment")
    df = ordered.block_number(df, F.col("table"), by=["path"], ord=order, name="table_no")
    df = df.filter(~F.col("header") & ~F.col("table") & ~F.col("furniture") & F.col("in_force").isNotNull())
    df = _cut_lines(df.drop("header", "table", "furniture", "cols"), "in_force").drop("chars").repartition("path")
    df = df.withColumn("cells", F.transform("cells", collapse_ws))
    df = ordered.gap_clusters(df, "y0", ROW_GAP, by=["path", "page", "segment"])
    # the statute's first line, repeated for every row of a table, is where rows are anchored
    first = Window.partitionBy("path", "table_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("marker", F.first(F.nullif(F.col("cells")[0], F.lit("")), ignorenulls=True).over(first))
    df = df.withColumn("anchor", F.coalesce(F.col("cells")[0] == F.col("marker"), F.lit(False)))
    cluster = ["path", "page", "segment", "cluster"]
    df = _cut(df, cluster)
    joined = lambda i: F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("y0")).alias("y"), "x0", F.col("cells")[i].alias("v")))), lambda c: c["v"]), lambda v: v != ""), " ")
    rows = df.groupBy(*cluster, "k").agg(F.max("anchor").alias("anchored"), F.max("y0").alias("y"), *[joined(i).alias(f) for i, f in enumerate(FIELDS)])
    # a cluster without an anchor is a row of its own if it is whole and the row before is; else it continues that row
    down = Window.partitionBy("path").orderBy("page", F.desc("y"))
    dated = F.col("date").rlike(DATE)
    own = F.col("anchored") | ((F.col("statute") != "") & dated & F.coalesce(F.lag(dated).over(down), F.lit(False)))
    rows = rows.withColumn("own", own.cast("int")).withColumn("no", F.sum("own").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("no > 0")
    parts = lambda f: F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("page", (-F.col("y")).alias("y"), F.col(f).alias("v")))), lambda c: c["v"]), lambda v: v != ""), " ")
    return rows.groupBy("path", F.col("no").alias("ord")).agg(F.min("page").alias("page"), *[parts(f).alias(f) for f in FIELDS])
