"""A stored index of names by their trigrams: postings in buckets, kept up by deltas.

Under one root lie, as tables of one commit (see upsert.commit), sets of files: `names` (id, version, name), `postings` (bucket, gram, name, n) and
`grams` (gram, times). Postings lead to names, each different one once however many ids have it. A change adds a set that holds only what changed; of an id's
names the newest version counts, and the names that the postings bring up are looked for among these, so older postings can't mislead. `compact` makes
one set of all. Readers see a change whole or not at all.

A search opens the buckets of the trigrams that it needs, and in them, sorted by trigram, what it needs; then it takes the ids of the names found.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.text import trigrams
from lumenframe.operators import upsert as U
from lumenframe.operators.settle import settled, shared_folder
from lumenframe.operators.trigrams import least_shared, similar_pairs

BUCKETS = 64
#: Up to so many trigrams, names and ids are given to the scan as a list; beyond that they are joined.
LISTED = 500
_PARTS = {"postings": ["bucket"]}


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _entries(spark: SparkSession, names: DataFrame, gone: DataFrame | None, number: int) -> dict[str, DataFrame]:
    """The tables of one delta: names (id, version, name; null where it is gone), postings (bucket, gram, name, n), grams (gram, times)."""
    rows = names.select("id", F.lit(number).alias("version"), "name")
    if gone is not None:
        rows = rows.unionByName(gone.select("id").join(names.select("id"), "id", "left_anti").select("id", F.lit(number).alias("version"), F.lit(None).cast("string").alias("name")))
    rows = settled(rows)
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    different = rows.select("name").where("name is not null").repartition(shares, "name").distinct().withColumn("g", trigrams(F.col("name")))
    grams = settled(settled(different).select("name", F.size("g").alias("n"), F.explode("g").alias("gram")))
    postings = grams.withColumn("bucket", _bucket(F.col("gram"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram", "name")
    times = grams.groupBy("gram").agg(F.count("*").alias("times"))
    return {f"names.{number:06d}": rows.sort("id"), f"postings.{number:06d}": postings, f"grams.{number:06d}": times.sort("gram")}


def build(spark: SparkSession, root: str, names: DataFrame) -> int:
    """Stores the index of names (id, name) under root; the version. What was there is replaced at once."""
    return _commit(spark, root, lambda number: _entries(spark, names, None, number), keep=False)


def change(spark: SparkSession, root: str, names: DataFrame, gone: DataFrame | None = None) -> int:
    """Adds a delta: names (id, name) that are new or have changed, and ids that are gone. Only these are written."""
    return _commit(spark, root, lambda number: _entries(spark, names, gone, number), keep=True)


def compact(spark: SparkSession, root: str) -> int:
    """Makes one set of files of all deltas."""
    return _commit(spark, root, lambda number: _entries(spark, live(spark, root), None, number), keep=False)


def _commit(spark: SparkSession, root: str, made, keep: bool) -> int:
    since = U.version(spark, root)
    old = U.committed(spark, root, since)
    new = made(since + 1)
    gone = {} if keep else dict.fromkeys(old - set(new))
    return U.commit(spark, root, new | gone, since, old, {n: _PARTS["postings"] for n in new if n.startswith("postings")})


def _part(spark: SparkSession, root: str, kind: str) -> DataFrame:
    found = [df for _, df in sorted(U.current(spark, root, kind=f"{kind}.").items())]
    if not found:
        raise ValueError(f"no index under {root}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def live(spark: SparkSession, root: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, name) as they are now, of these ids if any are given."""
    rows = _part(spark, root, "names")
    if ids is not None:
        rows = _of(rows, ids.select("id").distinct())
    newest = rows.groupBy("id").agg(F.max(F.struct("version", "name")).alias("r"))
    return newest.select("id", "r.name").where("name is not null")


def _of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose value is among those of the one column of wanted."""
    (c,) = wanted.columns
    few = [r[c] for r in wanted.limit(LISTED + 1).collect()]
    return rows.where(F.col(c).isin(few)) if len(few) <= LISTED else rows.join(wanted, c, "left_semi").select(*rows.columns)


def _holders(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """(id, name) as they are now of those names (name, distinct)."""
    rows = _part(spark, root, "names")
    ids = settled(_of(rows, names).select("id").distinct())
    return _of(live(spark, root, ids), names)


def pattern_grams(spark: SparkSession, text: str) -> list[str]:
    """The trigrams that every name holding the text has: of its words, with the blanks of those word edges that the text shows. % and _ may stand for anything."""
    cut = spark.sql("SELECT lower(:t) AS t", args={"t": text}).first()["t"]
    grams: dict[str, None] = {}
    for run in cut.replace("_", "%").split("%"):
        at = 0
        while at < len(run):
            end = at
            while end < len(run) and run[end].isalnum():
                end += 1
            if end > at:
                shown = ("  " if at else "") + run[at:end] + (" " if end < len(run) else "")
                grams.update(dict.fromkeys(shown[i : i + 3] for i in range(len(shown) - 2)))
            at = max(end, at + 1)
    return list(grams)


def holding(spark: SparkSession, root: str, text: str, rarest: int = 3) -> DataFrame:
    """(id, name) of the names that hold the text in any case, % and _ being wildcards: the postings of its rarest trigrams are intersected, and what is in all is
    compared. A text without a whole trigram scans the names."""
    like = F.ilike("name", F.lit(f"%{text}%"))
    wanted = pattern_grams(spark, text)
    if not wanted:
        return live(spark, root).where(like)
    times = {r["gram"]: r["times"] for r in _part(spark, root, "grams").where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("times").alias("times")).collect()}
    if len(times) < len(wanted):
        return live(spark, root).limit(0)
    chosen = sorted(wanted, key=lambda g: (times[g], g))[:rarest]
    met = postings(spark, root, chosen).groupBy("name").agg(F.countDistinct("gram").alias("met")).where(F.col("met") == len(chosen))
    return _holders(spark, root, settled(met.where(like).select("name")))


def postings(spark: SparkSession, root: str, grams: list[str]) -> DataFrame:
    """The postings of these trigrams; other buckets are not opened."""
    buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct().collect()]
    return _part(spark, root, "postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))


def resembling(spark: SparkSession, root: str, queries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """queries (text) -> (text, id, name, score) of the names whose similarity exceeds the threshold; only the postings of each query's rarest trigrams are read."""
    texts = settled(queries.select("text").where("text is not null").distinct())
    counts = _part(spark, root, "grams").groupBy("gram").agg(F.sum("times").alias("times"))
    own = texts.select("text", F.explode(trigrams(F.col("text"))).alias("gram")).join(counts, "gram", "left")  # those that no name has come first and meet nothing
    ordered = own.groupBy("text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram"))).alias("g"))
    n = F.size("g")
    heads = settled(ordered.select("text", n.alias("n_text"), F.explode(F.slice("g", F.lit(1), n - least_shared(n, threshold) + 1)).alias("e")).select("text", "n_text", F.col("e.gram").alias("gram")))
    grams = heads.select("gram").distinct()
    few = [r["gram"] for r in grams.limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        read = postings(spark, root, few)
    else:
        buckets = [r["b"] for r in grams.select(_bucket(F.col("gram")).alias("b")).distinct().collect()]  # BUCKETS at most
        read = _part(spark, root, "postings").where(F.col("bucket").isin(buckets))
    fits = (F.col("n") >= least_shared(F.col("n_text"), threshold)) & (F.col("n_text") >= least_shared(F.col("n"), threshold))
    met = settled(read.join(heads.groupBy("gram", "n_text").agg(F.lit(1)), "gram").where(fits).select("name").distinct())
    found = settled(similar_pairs(texts, met.withColumnRenamed("name", "text"), [], threshold).select(F.col("a").alias("text"), F.col("b").alias("name"), "score"))
    return found.join(_holders(spark, root, found.select("name").distinct()), "name").select("text", "id", "name", "score")


def fresh_root(spark: SparkSession) -> str:
    """A place for an index of this session."""
    return f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
