"""Inserts, updates and deletes as whole-table functions: old rows and a change in, new rows out. `commit` makes results of several tables take effect together."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators.settle import settled


def with_ids(new: DataFrame, existing: DataFrame, order: list[str], id_column: str = "id", parts: int | None = None, kind: str = "int") -> DataFrame:
    """new with ids that go on from the largest of existing, without gaps, in the given order.

    Ids are dealt range by range: rows are numbered within ranges of the order and each range starts where the ones before it end. The
    ranges are settled first, so that a lost executor can't deal them anew. kind: the type of the ids; long for numbers of rows.
    """
    parts = parts or int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("__start"))
    dealt = settled(new.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    n = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = n.groupBy("__part").agg(F.max("__n").alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).drop("__size")
    return n.join(F.broadcast(before), "__part").join(F.broadcast(start)).withColumn(id_column, (F.col("__start") + F.col("__before") + F.col("__n")).cast(kind)).drop("__part", "__n", "__before", "__start")


def first_of(df: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """One row of each key: the first in order, or, where none is given, by the other columns from left to right, nulls first."""
    order = order or [c for c in df.columns if c not in key]
    if not order:
        return df.dropDuplicates(key)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def _keyed(incoming: DataFrame, key: list[str]) -> DataFrame:
    """incoming with all columns under names of their own, so that null-safe conditions stay clear."""
    return incoming.select(*[F.col(c).alias(f"__{c}") for c in incoming.columns])


def _same(existing: DataFrame, key: list[str]):
    """Keys are equal; nulls equal nulls."""
    return reduce(lambda a, b: a & b, [existing[k].eqNullSafe(F.col(f"__{k}")) for k in key])


def find_or_create(existing: DataFrame, incoming: DataFrame, key: list[str], id_column: str = "id") -> DataFrame:
    """existing and, with new ids, one row for each key of incoming that it lacks (see first_of). Null keys match null keys."""
    fresh = first_of(incoming, key)
    fresh = fresh.join(_keyed(existing.select(*key), key), _same(fresh, key), "left_anti")
    return existing.unionByName(with_ids(fresh, existing, key, id_column), allowMissingColumns=True)


def keep_first(existing: DataFrame, incoming: DataFrame, key: list[str], order: list) -> DataFrame:
    """existing, and of incoming the first row of each key that existing lacks. Null keys match null keys."""
    first = first_of(incoming, key, order)
    return existing.unionByName(first.join(_keyed(existing.select(*key), key), _same(first, key), "left_anti"), allowMissingColumns=True)


def create_or_update(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; where both have one the incoming row's values that are set win. incoming has one row a key. Null keys match null keys."""
    joined = existing.join(_keyed(incoming, key), _same(existing, key), "full_outer")
    return joined.select(*[F.coalesce(*((c, f"__{c}") if c in key else (f"__{c}", c))).alias(c) if c in incoming.columns else F.col(c) for c in existing.columns])


def update(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing with the incoming values that are set; incoming rows without a match are ignored. incoming has one row a key. Null keys match null keys."""
    joined = existing.join(_keyed(incoming, key), _same(existing, key), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in incoming.columns and c not in key else F.col(c) for c in existing.columns])


def delete_where(existing: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """existing without the rows whose key is in keys. Null keys match null keys."""
    return existing.join(_keyed(keys.select(*key).distinct(), key), _same(existing, key), "left_anti")


def reload(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Delete-then-insert: the incoming keys' old rows go, all incoming rows come. Running it twice gives the same table."""
    return delete_where(existing, incoming, key).unionByName(incoming, allowMissingColumns=True)


def replace(df: DataFrame, path: str) -> None:
    """Writes df beside path and moves it there. Between the two moves there is no table at path; readers that can't have that read through `current`."""
    spark: SparkSession = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged", f"{path}.old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(staged.toString())
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise OSError(f"{path} could not be put in place")
    fs.delete(old, True)


class Conflict(RuntimeError):
    """Another writer has changed what a change read or wrote."""


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(fs, path) -> dict:
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _versions(spark: SparkSession, root: str) -> dict[int, object]:
    """version -> the file that describes it."""
    _, at, fs = _files(spark, root)
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return {int(p.getName()[:-5]): p for p in found if p.getName()[:-5].isdigit() and p.getName().endswith(".json")}


def version(spark: SparkSession, root: str) -> int:
    """The newest version of the tables under root; 0 if nothing was committed yet."""
    return max(_versions(spark, root), default=0)


def _places(spark: SparkSession, root: str, at: int | None = None) -> dict[str, str]:
    files = _versions(spark, root)
    at = max(files, default=0) if at is None else at
    return _read(_files(spark, root)[2], files[at])["tables"] if at else {}


def _put_if_absent(spark: SparkSession, root: str, number: int, text: str) -> bool:
    """Writes the description of a version unless there is one: of several writers just one succeeds, and no reader sees half of it."""
    jvm, at, fs = _files(spark, root)
    name = f"{number:012d}.json"
    staged, target = jvm.org.apache.hadoop.fs.Path(at, f"{uuid.uuid4().hex}.staged"), jvm.org.apache.hadoop.fs.Path(at, name)
    stream = fs.create(staged)
    stream.write(text.encode())
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":  # a rename would replace the file there
            folder = at.toUri().getPath()
            os.link(f"{folder}/{staged.getName()}", f"{folder}/{name}")
            return True
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, target, none)
        return True
    except FileExistsError:
        return False
    except Exception:  # a rename onto a file that is there fails in ways that depend on the file system
        if fs.exists(target):
            return False
        raise
    finally:
        if fs.exists(staged):
            fs.delete(staged, False)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame | None], since: int | None = None, read: Iterable[str] = (), partition_by: dict[str, list[str]] | None = None) -> int:
    """Writes new tables under root and then one version that names them all: readers see all or none of a change, and a job that fails before leaves what was.
    Returns the version. Tables not named stay as they are; None drops one. What versions no longer name remains until `vacuum`.

    Writers that meet: a version is put in place only if its number is free, so none is overwritten. A change says by `since` which version it was made from; it
    is put on top of what others committed meanwhile, unless they changed a table that it writes or, by `read`, has read: then it raises Conflict and
    nothing takes effect. Without `since` the tables replace whatever is there.
    """
    written = {}
    for name, df in tables.items():
        written[name] = f"{root}/{name}/{uuid.uuid4().hex}" if df is not None else None
        if df is not None:
            df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(written[name])
    _, _, fs = _files(spark, root)
    while True:
        files = _versions(spark, root)
        newest = max(files, default=0)
        if since is not None:
            changed = {t for v in range(since + 1, newest + 1) for t in _read(fs, files[v])["changed"]}
            if clash := changed & (set(tables) | set(read)):
                raise Conflict(f"{', '.join(sorted(clash))} changed between version {since} and {newest}")
        places = (_read(fs, files[newest])["tables"] if newest else {}) | written
        text = json.dumps({"tables": {n: p for n, p in places.items() if p}, "changed": sorted(tables)})
        if _put_if_absent(spark, root, newest + 1, text):
            return newest + 1


def transaction(spark: SparkSession, root: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 10) -> int:
    """Commits what `change` makes of the current tables, as if nobody else wrote: if another writer came first, it is made anew from what is there then.
    Frames that `change` hands back as they came are not written."""
    for left in reversed(range(tries)):
        since = version(spark, root)
        old = current(spark, root, since)
        new = change(dict(old))
        try:
            return commit(spark, root, {n: df for n, df in new.items() if df is not old.get(n)}, since, old)
        except Conflict:
            if not left:
                raise
    raise ValueError("no tries")


def current(spark: SparkSession, root: str, at: int | None = None, kind: str = "") -> dict[str, DataFrame]:
    """The tables as last committed, or as they were at a version; only those whose names begin with kind are opened."""
    return {name: spark.read.parquet(path) for name, path in _places(spark, root, at).items() if name.startswith(kind)}


def committed(spark: SparkSession, root: str, at: int | None = None) -> set[str]:
    """The names of the tables as last committed, or at a version; none is opened."""
    return set(_places(spark, root, at))


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes what the newest `keep` versions don't name, and the older versions; how many folders of data went. For when no reader holds an older one and no
    writer is at work."""
    files = _versions(spark, root)
    jvm, at, fs = _files(spark, root)
    kept = sorted(files)[-keep:]
    held = {p.rsplit("/", 1)[-1] for v in kept for p in _read(fs, files[v])["tables"].values()}
    gone = 0
    for folder in fs.listStatus(at.getParent()):
        if folder.isDirectory() and folder.getPath().getName() != "_versions":
            for status in fs.listStatus(folder.getPath()):
                if status.getPath().getName() not in held:
                    gone += bool(fs.delete(status.getPath(), True))
    for v in files.keys() - set(kept):
        fs.delete(files[v], False)
    return gone
