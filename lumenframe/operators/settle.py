"""Cutting lineage: a frame written once to the folder that driver and executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may leave it unset; it gets a folder of this process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lumenframe-"))
    return f"file://{_own[0]}"


def settled(df: DataFrame) -> DataFrame:
    """df as a table of its own: what follows neither repeats nor depends on how it was made."""
    path = f"{shared_folder(df.sparkSession)}/settled/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsettled(spark: SparkSession) -> None:
    """Deletes all tables that this application settled; for when results have been taken."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
