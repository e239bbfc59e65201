"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. The sources' targets share `share` times all words by weight; none exceeds `cap` times its source's size, and what is
cut off there is shared again by weight (water-filling, in closed form over one row a source). A source of size S and quota q gives
floor(q / S) whole passes and a last partial one. A pass is made of blocks: a source's documents, permuted by a hash of their ids,
cut into runs, as many a source as about the square root of all rows. The exact numbers of blocks (one quota per source and pass) are divided
among output shards by a tree: at each node the left half of the shards draws its blocks from the quotas without replacement (multivariate
hypergeometric), the right half keeps the rest, and so on down. Each shard takes as many blocks of each quota as the tree gives it, consecutive
ones in the pass's own permutation: blocks are disjoint and all are used. A document is taken in a pass only if the tree dealt its block to
a shard. Within a shard rows are ordered by a hash. All draws come from the seed, so reruns agree.

The document at which a partial pass ends gives only its leading words, so that each source's words meet its rounded target exactly;
with whole=True it comes whole or not at all, whichever is nearer.

Defined cases: a null or empty text has size 0 and is never drawn; a null source is a source of its own, last in order; if all sizes are 0 so
are all targets; rows with equal ids are neighbours in the permutation and are drawn one by one (`drawn` deals out rows equal in id and text alike);
an empty table gives no rows. The driver holds a row per source (a corpus's list of sources), never one per document or block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import n_words, unused, written


def passes_of(cap: float) -> int:
    """Passes that a quota of at most cap times a source's size, rounded, can need: whole ones and a partial one."""
    return math.ceil(cap) + 1


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2)) -> DataFrame:
    """(source, source_size) in; (source, source_size, rank, weight, target) out."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    up = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    rows = Window.unboundedPreceding, Window.currentRow
    capped_before = F.sum("most").over(up.rowsBetween(*rows)) - F.col("most")
    weight_from = F.sum("weight").over(everything) - F.sum("weight").over(up.rowsBetween(*rows)) + F.col("weight")
    level = (F.sum("source_size").over(everything) * F.lit(share) - capped_before) / weight_from
    found = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything))
    return found.select("source", "source_size", "rank", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas: blocks per source and pass. Returns shards x len(quotas): how many of each a shard gets; columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(q: np.ndarray, low: int, high: int, node: int) -> None:
        if high - low == 1:
            out[low] = q
            return
        middle = (low + high) // 2
        total = int(q.sum())
        want = total * (middle - low) // (high - low)
        draw = np.random.Generator(np.random.PCG64([seed, node])).multivariate_hypergeometric(q, want, method="marginals") if total else q * 0
        split(draw, low, middle, 2 * node)
        split(q - draw, middle, high, 2 * node + 1)

    split(np.asarray(quotas, dtype=np.int64), 0, shards, 1)
    return out


def mix(df: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2), shards: int = 8, seed: int = 7, whole: bool = False, text: str = "text") -> DataFrame:
    """A row per row of df: doc_id, source, size, source_size, target, taken (words, all passes), draws (array of pass, words, shard, order), copy (digest of the text)."""
    spark, passes = df.sparkSession, passes_of(cap)
    docs = written(
        df.select("doc_id", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("copy"), F.col("source").cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(str(seed))).cast("binary")).alias("permuted")),
        "sized",
    )
    plan = written(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights), "targets")
    quota = F.floor(F.col("target") + 0.5)
    plan = plan.select("*", F.coalesce(F.floor(F.try_divide(quota, "source_size")), F.lit(0)).alias("full")).withColumn("rest", quota - F.col("full") * F.col("source_size"))
    digits = max(3, math.ceil(math.log(max(1, docs.count()), 16) / 2))  # 16 ** digits blocks a source
    known = docs.select("*", F.substring("permuted", 1, digits).alias("block"))
    blocks = known.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.join(plan, blocks["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    before = F.sum("words").over(Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    blocks = blocks.withColumn("before", before)
    for p in range(passes):
        active = (F.col("words") > 0) & ((F.lit(p) < F.col("full")) | ((F.lit(p) == F.col("full")) & (F.col("before") < F.col("rest"))))
        blocks = blocks.withColumn(f"active{p}", active)
        order = Window.partitionBy("rank", f"active{p}").orderBy(F.md5(F.concat_ws("|", "block", F.lit(str(p)), F.lit(str(seed))).cast("binary")), "block")
        blocks = blocks.withColumn(f"place{p}", F.row_number().over(order) - 1)
    blocks = written(blocks, "blocks")
    counts = blocks.groupBy("rank").agg(*[F.count_if(f"active{p}").alias(f"n{p}") for p in range(passes)]).orderBy("rank").toPandas()  # a row a source
    quotas = counts[[f"n{p}" for p in range(passes)]].to_numpy().reshape(-1)
    ends = np.cumsum(splitting_tree(quotas, shards, seed), axis=0).T.reshape(-1, passes, shards) if len(counts) else np.zeros((0, passes, shards), dtype=np.int64)
    table = spark.createDataFrame(pd.DataFrame({"rank": counts["rank"].astype("int64"), "ends": ends.tolist()}), "rank bigint, ends array<array<bigint>>")

    def shard_in(p: int):
        """The shard whose share of the quota holds the block's place; none if the tree dealt out fewer blocks."""
        shard = F.size(F.filter(F.get("ends", F.lit(p)), lambda e: e <= F.col(f"place{p}")))
        return F.when(F.col(f"active{p}") & (shard < shards), shard)

    at = F.array(*[shard_in(p) for p in range(passes)])
    dealt = blocks.join(table, "rank").select("rank", "source", "block", "before", "full", "rest", "source_size", "target", at.alias("shards"))

    inner = Window.partitionBy("rank", "block").orderBy("permuted", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = plan.select(F.col("source").alias("s"), "rank")
    ranked = known.join(ranks, known["source"].eqNullSafe(ranks["s"])).drop("s").withColumn("within", F.sum("size").over(inner) - F.col("size"))
    joined = ranked.join(dealt.drop("source"), ["rank", "block"])
    left = F.col("rest") - F.col("before") - F.col("within")
    part = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(left, F.col("size")))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(passes - 1)),
        lambda p: F.struct(
            p.alias("pass"), F.when(p < F.col("full"), F.col("size")).when(p == F.col("full"), part).otherwise(0).cast("long").alias("words"),
            F.get("shards", p).alias("shard"), F.xxhash64("permuted", p, F.lit(seed)).alias("order"),
        ),
    )
    out = joined.withColumn("draws", F.filter(draws, lambda d: (d["words"] > 0) & d["shard"].isNotNull()))
    return out.select("doc_id", "source", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws", "copy")


def drawn(df: DataFrame, mixed: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """What a mix (of whole documents) deals out, with df's columns: partition i holds shard i, its rows in the order drawn for them, one for each pass that draws them."""
    key, copy, draw = unused(df, "key", "copy", "draw")
    most = F.max(F.struct(F.size("draws").alias("n"), F.col("draws").alias("all")))  # rows equal in id and text are drawn alike
    draws = mixed.where(F.size("draws") > 0).groupBy("doc_id", "copy").agg(most.alias("m")).select(F.col("doc_id").alias(key), F.col("copy").alias(copy), F.explode("m.all").alias(draw))
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    dealt = df.join(draws, F.col("doc_id").eqNullSafe(F.col(key)) & (own == F.col(copy)))
    return dealt.repartitionById(shards, F.col(f"{draw}.shard").cast("int")).sortWithinPartitions(f"{draw}.order", f"{draw}.pass", "doc_id").select(*df.columns)


def listed(mixed: DataFrame) -> DataFrame:
    """A mix with its draws as text: passes, words of each, the shard that the tree dealt each to and the order there, comma-joined."""
    joined = lambda f: F.array_join(F.transform("draws", lambda d: d[f].cast("string")), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", joined("pass").alias("passes"), joined("words").alias("words"), joined("shard").alias("shards"), joined("order").alias("orders"))


#: The rows of query op8 in DuckDB's SQL, but for what the tree draws.
SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat_ws('|', doc_id::VARCHAR, '7')) AS h FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sizes
), levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(most) OVER u - most)) / (sum(weight) OVER () - sum(weight) OVER u + weight) AS level
    FROM ranked WINDOW u AS (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING)
), plan AS (SELECT source, source_size, least(most, coalesce((max(CASE WHEN level <= most / weight THEN level END) OVER ()) * weight, most)) AS target FROM levels
), quotas AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS whole_passes FROM plan
), placed AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM docs)
SELECT p.doc_id, p.size, q.source_size, q.target,
  (q.whole_passes * p.size + greatest(0, least(q.quota - q.whole_passes * q.source_size - p.before, p.size)))::BIGINT AS taken
FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
"""
