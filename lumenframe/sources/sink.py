"""Append sinks that take each batch once: delimited files with one header, and tables, both with a manifest of the batches that they hold.

A batch has a number. Its rows are written to a folder of their own and then named by a manifest under that number, which is put in place only if there is none: a
batch that comes again, because a job or a stream was stopped after writing it, changes nothing, and what a stopped job left behind is
never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenframe.operators import upsert as U
from lumenframe.sources.files import as_json_cells


def batches(spark: SparkSession, path: str) -> dict[int, dict]:
    """number -> manifest (folder, header, format, schema) of the batches that the sink holds. Batch n has the version n + 1 of the folder's descriptions."""
    _, _, fs = U._files(spark, path)
    return {v - 1: U._read(fs, at) for v, at in sorted(U._versions(spark, path).items())}


def append(df: DataFrame, path: str, batch: int, format: str = "parquet") -> bool:
    """Appends a batch (numbered from 0) unless the sink holds it; whether it did. Columns must be those of the batches before, in any order."""
    spark = df.sparkSession
    held = batches(spark, path)
    if batch in held:
        return False
    if format == "csv":
        df = as_json_cells(df)
    first = held[min(held)] if held else None
    if first:
        if sorted(first["header"]) != sorted(df.columns) or first["format"] != format:
            raise ValueError(f"the sink holds {first['format']} of {', '.join(first['header'])}")
        df = df.select(*[F.col(f"`{c}`") for c in first["header"]])
    folder = f"{path}/data/{uuid.uuid4().hex}"
    if format == "csv":
        df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).write.option("header", False).option("escape", '"').option("nullValue", None).csv(folder)
    else:
        df.write.format(format).save(folder)
    manifest = {"folder": folder, "header": df.columns, "format": format, "schema": df.schema.json()}
    return U._put_if_absent(spark, path, batch + 1, json.dumps(manifest))


def rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All batches' rows, of delimited files as text; None if the sink holds none."""
    held = batches(spark, path)
    if not held:
        return None
    first = held[min(held)]
    folders = [m["folder"] for m in held.values()]
    if first["format"] == "csv":
        return spark.read.schema(", ".join(f"`{c}` string" for c in first["header"])).option("header", False).option("escape", '"').option("multiLine", True).csv(folders)
    return spark.read.schema(StructType.fromJson(json.loads(first["schema"]))).format(first["format"]).load(folders)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value) of a delimited sink as one file would have them: the header once, as batch -1, then the batches' lines."""
    held = batches(spark, path)
    header = held[min(held)]["header"]
    out = spark.createDataFrame([(-1, ",".join(f'"{c}"' if any(x in c for x in ',"') else c for c in header))], "batch long, value string")
    for n, m in held.items():
        out = out.unionByName(spark.read.text(m["folder"]).select(F.lit(n).cast("long").alias("batch"), "value"))
    return out


def stream_into(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet"):
    """Writes a stream to the sink until all that is there now is done; stopped and started again, each row is in it once."""
    return stream.writeStream.foreachBatch(lambda df, n: append(df, path, n, format) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
