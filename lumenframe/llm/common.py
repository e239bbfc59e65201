"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The same as a separator for split().
SPACE = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset; it gets a folder of this process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lumenframe-"))
    return f"file://{_own_dir[0]}"


def stored(df: DataFrame, name: str) -> str:
    """Writes df once as Parquet in the shared folder, under this application's id; where it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """A frame that reads what stored() wrote: lineage is cut, and no executor's loss undoes it."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def removed(spark: SparkSession, path: str | None = None) -> None:
    """Deletes a table that stored() wrote, or all that this application wrote; for when results have been taken."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path or f"{shared_dir(spark)}/lumenframe/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, as a long, without an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_key(column: str = "doc_id") -> Column:
    """A key by which rows are put in ascending order of an id; null comes first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def block_bounds(df: DataFrame, key: Column, blocks: int) -> list[int]:
    """Ascending keys that cut df into at most so many ranges of about as many rows. The list is as long as `blocks`, whatever df holds."""
    if blocks < 2:
        return []
    accuracy = min(20 * blocks, max(10_000, 4 * blocks))
    got = df.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], accuracy).alias("q")).first()["q"]
    return sorted(set(got or []))


def block_of(key: Column, bounds: list[int]) -> Column:
    """The number of the range that holds key: how many bounds are not above it. A tree of comparisons, or for many bounds a binary search in one constant array."""
    if len(bounds) > 1024:
        sorted_ = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_, at + step - 1) <= key, at + step).otherwise(at))

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(bounds)).cast("int")
