"""Refresh of lists as a stream: documents that arrive replace their list's rows in the store. An extension; the site refreshes by hand."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterlake.schema import DOCUMENT


def refresh(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Reads list documents as they land in `incoming`; each batch overwrites the partitions of its lists only, and none that is newer."""
    docs = spark.readStream.schema(DOCUMENT).option("multiLine", True).json(incoming)
    rows = docs.select("list_id", "extracted", F.posexplode("entities").alias("ord", "e")).select("list_id", "extracted", "ord", "e.*")

    def replace(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("list_id").agg(F.max("extracted").alias("extracted"))
        try:
            held = spark.read.parquet(store).groupBy("list_id").agg(F.max("extracted").alias("held"))
        except AnalysisException:  # nothing is in the store yet
            held = spark.createDataFrame([], "list_id string, held string")
        newer = latest.join(held, "list_id", "left").filter("held IS NULL OR extracted >= held").select("list_id", "extracted")
        known = f"{checkpoint}/newer/{number}"  # the store is not read while it is written
        newer.write.mode("overwrite").parquet(known)
        batch.join(spark.read.schema(newer.schema).parquet(known), ["list_id", "extracted"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list_id").parquet(store)

    return rows.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
