"""What the operators of this package share: byte-level tokens, text scans and shared storage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rosterlake.session import ship, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own = threading.local()  # tables that this thread of the driver has written to the shared folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def as_uri(folder: str) -> str:
    """With its scheme and, for local files, the two slashes that Arrow's file systems want."""
    return "file://" + folder.removeprefix("file:").removeprefix("//") if folder.startswith(("/", "file:")) else folder


def prepare(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Sends the package to the executors, and bounds this session's Arrow batches, so that a task's memory follows neither
    rows nor the length of texts; a smaller setting stays."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    noted(path)
    return spark.read.schema(df.schema).parquet(path)


def _written() -> list[str]:
    if not hasattr(_own, "written"):
        _own.written = []
    return _own.written


def noted(path: str) -> None:
    """Remembers what was written to the shared folder, so that sweep() may remove it."""
    _written().append(path)


def written() -> int:
    """How many tables this thread wrote so far and did not remove."""
    return len(_written())


def sweep(keep: DataFrame, since: int) -> None:
    """Removes the tables that this thread wrote after its first `since`, but those that `keep` reads; no one may need them any more. What
    runs in other threads is left alone."""
    needed = {f.rsplit("/", 1)[0] for f in keep.inputFiles()}
    for path in [p for p in _written()[since:] if not any(n.endswith(p.split(":", 1)[-1]) for n in needed)]:
        store, base = fs.FileSystem.from_uri(as_uri(path))
        store.delete_dir(base)
        _written().remove(path)


def hot_keys(rows: DataFrame, key: str, *, parts: int = 4096) -> DataFrame:
    """The keys that hold more than 1 / parts of the rows (a written table) each: fewer than `parts`, so they may be broadcast."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    least = rows.agg((F.count(F.lit(1)) / parts).alias("n")).scalar()
    return counts.filter((F.col("n") > 1) & (F.col("n") > least)).select(key)


def hot_join(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join of rows with values (one for each key), where keys in `hot` (few, see hot_keys) are joined by broadcast."""
    few = F.broadcast(hot)
    near = rows.join(few, key, "left_semi").join(F.broadcast(values.join(few, key, "left_semi")), key, "left")
    return near.unionByName(rows.join(few, key, "left_anti").join(values, key, "left"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column, combine: Callable[[Column, Column], Column], *, block: int = 256) -> Column:
    """For an int array, 0 and the combination of 0 with the members up to each: one more than there are members.

    An array is copied when it grows, so members are combined in blocks, and the blocks' totals before: linear for all that
    memory holds.
    """
    grown = lambda xs, first: F.aggregate(xs, F.array(first), lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x)))

    def two_levels(parts: Column) -> Column:
        bases = grown(F.transform(parts, lambda x: F.aggregate(x, F.lit(0), combine)), F.lit(0))
        return F.flatten(F.zip_with(parts, F.slice(bases, 1, F.size(parts)), lambda x, base: F.slice(grown(x, base), 2, F.size(x))))

    def whole(s: Column) -> Column:
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), F.lit(block))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(F.lit(0)), let(F.transform(starts, lambda i: F.slice(s, i, F.lit(block))), two_levels))

    return let(steps, whole)


def pieces(text: Column, cuts: Column, *, block: int = 512) -> Column:
    """The text from start to end (code points, exclusive) for each struct of cuts; a text is walked through once, not for each cut."""

    def of(blocks: Column) -> Column:
        first = lambda c: F.floor(c["start"] / block).cast("int")
        last = lambda c: F.floor((c["end"] - 1) / block).cast("int")
        near = lambda c: F.array_join(F.slice(blocks, first(c) + 1, last(c) - first(c) + 1), "")
        return F.transform(cuts, lambda c: F.when(c["end"] > c["start"], near(c).substr(c["start"] % block + 1, c["end"] - c["start"])).otherwise(""))

    return let(F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{block}}})"), F.lit(1)), of)


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words `[^\\x20\\x09-\\x0D]+`; bytes.lower and bytes.split know ASCII only, as wanted."""
    return text.lower().split() if text else []


def native_words(text: Column) -> Column:
    """As words(), in the JVM: an array, empty for null or blank text."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of texts with about `limit` bytes each, with their start; a longer text is a run of its own.

    Only one run at a time is turned into Python objects.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, texts.slice(start, end - start).to_pylist()
        start = end


def map_texts(df: DataFrame, text: str, make: Callable, fields: str, *, keep: list[Column] | None = None, limit: int = 4 << 20) -> DataFrame:
    """`keep` (default: every column of df) plus the columns `fields` that `make()(texts)` gives.

    make is called once in each task and returns f: list of UTF-8 texts (bytes or None) -> one list or array for
    each field. f gets about `limit` bytes at a time, so memory does not follow the partition's size. No shuffle.
    """
    prepare(df.sparkSession)
    keep = [df[c] for c in df.columns] if keep is None else keep
    given = df.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("text"))
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([given.schema["row"], *added])
    types = [to_arrow_type(f.dataType) for f in added]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at, texts in slices(batch.column(1), limit):
                out = [pa.array(x, type=t) for x, t in zip(f(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *out], names=names)

    return given.mapInArrow(run, schema).select("row.*", *added.names)
