"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Tables with long texts, where a row costs far more than its way to another core.
TEXTS = {"documents", "pages"}


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores, where the files have fewer parts than these; a table of many parts is left as it is, so that no texts are shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores, however the files are cut: for short rows, each of which becomes a page to be read."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def query(name: str, sql: str | None = None):
    """Registers f(t) -> DataFrame, where t(name) is a table, under a name and with the SQL that must give the same rows."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def table(spark: SparkSession, sf_dir: str, t: str) -> DataFrame:
            df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            return spread(df) if t in TEXTS else df

        QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
