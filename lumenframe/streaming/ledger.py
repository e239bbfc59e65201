"""Incremental work: what a ledger has seen is skipped, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unseen(work: DataFrame, ledger: DataFrame, key: list[str], limit: int | None = None) -> DataFrame:
    """Work that the ledger lacks, up to a session's budget."""
    left = work.join(ledger.select(*key).distinct(), key, "left_anti")
    return left if limit is None else left.orderBy(*key).limit(limit)


def marks(results: DataFrame, key: list[str]) -> DataFrame:
    """Ledger entries for what gave a result; what gave none is tried again."""
    return results.select(*key).distinct()


def with_status(work: DataFrame, found: DataFrame, key: list[str], id_column: str) -> DataFrame:
    """All work with the id found and a status: found, not_found or error."""
    failed = F.coalesce(F.col("__failed"), F.lit(False))
    joined = work.join(found.withColumn("__seen", F.lit(True)).withColumnRenamed("failed", "__failed"), key, "left")
    return joined.withColumn("status", F.when(failed, "error").when(F.col(id_column).isNull(), "not_found").otherwise("found")).drop("__seen", "__failed")


def upsert_stream(spark: SparkSession, source: str, ddl: str, checkpoint: str, apply: Callable[[DataFrame, int], None], files_per_batch: int = 64) -> StreamingQuery:
    """New files of a folder, each processed once, in micro-batches given to `apply`; runs until all present files are done."""
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, time: str, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as repeats come within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
