"""Readers and writers of files and tables. Schemas are given, not inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenframe.fixed import SHEET_COLUMNS


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def database_table(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational database, read in parts by ranges of a number column if one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """An ad-hoc query with named parameters."""
    return spark.sql(sql, args=parameters)


def text_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """A delimited file with a header whose cells are all text."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def typed_csv(spark: SparkSession, path: str, ddl: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).schema(ddl).csv(path)


def lookup_csv(spark: SparkSession, path: str, key: str, columns: Sequence[str]) -> DataFrame:
    """A small lookup file, its key trimmed."""
    return text_csv(spark, path, columns).withColumn(key, F.trim(key)).dropDuplicates([key])


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("escape", chr(34)).csv(path)


def numbered(df: DataFrame, column: str = "row_id") -> DataFrame:
    """Rows read from files with their number, from 1, in the order of the files' names and of the lines in them."""
    from lumenframe.operators.upsert import with_ids

    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    return with_ids(placed, df.limit(0).select(F.lit(0).alias(column)), ["__file", "__block", "__at"], column, kind="long").drop("__file", "__block", "__at")


def as_json_cells(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for a delimited file."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in nested})


def sheets(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Yearly sheets (their names' digits are the year) under each other, columns renamed; sheets without digits are left out, missing columns are null."""
    kept = []
    for name, df in frames.items():
        if name.isdigit():
            if "PAYANT" in df.columns and "PAYANTE" not in df.columns:
                df = df.withColumnRenamed("PAYANT", "PAYANTE")
            kept.append(df.withColumn("year", F.lit(int(name))))
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
    return joined.withColumnsRenamed({a: b for a, b in SHEET_COLUMNS.items() if a in joined.columns})


def normalized_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns without any value go. Counts them all in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if counts[c]])


def media(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Poster or trailer files as bytes."""
    if kind not in ("poster", "trailer"):
        raise ValueError(f"{kind} is neither a poster nor a trailer")
    return spark.read.format("binaryFile").load(path)


def json_files(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def crawl_plan(spark: SparkSession, first_year: int, last_year: int, first_page: int, last_page: int) -> DataFrame:
    """(year, page) of every page to fetch."""
    return spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(first_page), F.lit(last_page))).alias("page"))


def batches(df: DataFrame, order: str, size: int = 100) -> DataFrame:
    """df with the number of the batch of `size` rows that each is in, in order."""
    from lumenframe.operators.upsert import with_ids

    rows = with_ids(df, df.limit(0).select(F.lit(0).alias("__row")), [order], "__row", kind="long")
    return rows.withColumn("batch", F.floor((F.col("__row") - 1) / size).cast("int")).drop("__row")
