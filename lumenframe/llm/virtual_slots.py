"""Sharding by fixed virtual slots, in DataFrame functions only.

A record's id, a checksum and the size of its text, and its number among rows equal in these, are hashed into one of `slots` virtual slots, whose
number never changes. So a record's slot depends on nothing else in the corpus, and rows that are all equal (such as copies without an id) are
spread as others are. A map says which shard holds each slot. Bytes are aggregated per slot, and rebalancing edits the map: whole slots move from
shards that hold too much to those that hold too little, and everything else stays. Each edit is a new version; all versions are rows of
one small table (version, slot, shard, bytes, rows, first), kept as Parquet in the shared folder. A later call is given that table, edits its newest
version and stores one more. The law that holds is `bytes`: the shards' sizes are near equal, as close
as moving whole slots allows (a slot has some 1/8192 of the rows, whatever their ids, source, text or copies).

Defined cases: a null text has size 1 (no bytes plus 1) and crc32 0, as has an empty one; rows equal in
id and text get places of their own; null and repeated ids are spread as others are; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import written

SLOTS = 8192


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: even runs of slots, before any sizes are known."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(of_slot: Sequence[int], load: Sequence[int], shards: int) -> list[int]:
    """The map edited so that each shard's load is near the mean; shards may exceed those in use (growth) or fall short (removal).

    Slots come off shards above the mean, largest first, as long as the shard stays at or above it. They and the slots of removed
    shards go, largest first, to the shard with the least. Then single slots move from the fullest to the emptiest while that narrows the gap.
    """
    new, held = list(of_slot), [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    pool = []
    for s, k in enumerate(new):
        if k < shards:
            own[k].append(s)
            held[k] += load[s]
        else:
            pool.append(s)
    mean = sum(load) / shards
    for k in range(shards):
        for s in sorted(own[k], key=lambda s: -load[s]):
            if held[k] - load[s] >= mean and load[s]:
                held[k] -= load[s]
                pool.append(s)
    heap = [(h, k) for k, h in enumerate(held)]
    heapq.heapify(heap)
    for s in sorted(pool, key=lambda s: (-load[s], s)):
        h, k = heap[0]
        heapq.heapreplace(heap, (h + load[s], k))
        held[k] = h + load[s]
        new[s] = k
    for _ in range(len(new)):
        top, low = max(range(shards), key=held.__getitem__), min(range(shards), key=held.__getitem__)
        gap = held[top] - held[low]
        fits = [s for s, k in enumerate(new) if k == top and 0 < load[s] < gap]
        if not fits:
            break
        s = min(fits, key=lambda s: abs(2 * load[s] - gap))
        new[s] = low
        held[top] -= load[s]
        held[low] += load[s]
    return new


def stored_map(table: DataFrame, version: int | None = None) -> tuple[int, list[int]]:
    """(version, shard of each slot) of a map's newest version, or of the one asked for."""
    rows = table.where(F.col("version") == (F.lit(version) if version is not None else table.agg(F.max("version")).first()[0])).select("version", "slot", "shard").orderBy("slot").collect()  # a row a slot
    if not rows or [r["slot"] for r in rows] != list(range(len(rows))):
        raise ValueError("no such version, or slots are missing")
    return rows[0]["version"], [r["shard"] for r in rows]


def map_version(spark: SparkSession, version: int, of_slot: Sequence[int], load: Sequence[int], rows: Sequence[int]) -> DataFrame:
    """(version, slot, shard, bytes, rows, first) of one version; first: how many rows the shard has in its slots before this one."""

    def listed(x: Sequence[int]):
        return F.split(F.lit(",".join(map(str, x))), ",")

    seen: dict[int, int] = {}
    first = []
    for s, k in enumerate(of_slot):
        first.append(seen.get(k, 0))
        seen[k] = first[-1] + rows[s]
    at = F.col("id").cast("int") + 1
    return spark.range(len(of_slot)).select(
        F.lit(version).alias("version"), F.col("id").alias("slot"), F.element_at(listed(of_slot), at).cast("int").alias("shard"),
        F.element_at(listed(load), at).cast("long").alias("bytes"), F.element_at(listed(rows), at).cast("long").alias("rows"), F.element_at(listed(first), at).cast("long").alias("first"),
    )


def edited(spark: SparkSession, table: DataFrame | None, load: Sequence[int], rows: Sequence[int], shards: int) -> DataFrame:
    """A map with one more version: the newest one rebalanced for these loads and so many shards. Without a map the first version is even."""
    if table is None:
        even = first_map(shards, len(load))
        table, at, of_slot = map_version(spark, 1, even, load, rows), 1, even
    else:
        at, of_slot = stored_map(table)
        if len(of_slot) != len(load):
            raise ValueError(f"the map has {len(of_slot)} slots")
    return written(table.unionByName(map_version(spark, at + 1, rebalanced(of_slot, load, shards), load, rows)), "slot_map")


def slotted(df: DataFrame, slots: int = SLOTS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, number, virtual_slot) as a stored table; number: of the rows equal in the three before it, from 0.

    Equal rows are numbered within the partition that each was read in, and each partition's numbers start where those before it end, so that no group of
    equal rows meets in one task.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    same = ["doc_id", "size", "text_crc32"]
    keyed = written(df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "sized")
    counts = keyed.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("start", F.sum("n").over(Window.partitionBy(*same).orderBy("part")) - F.col("n")).where("start > 0").drop("n")  # a row a partition of the input at most
    before = before.withColumnsRenamed({c: f"its_{c}" for c in same} | {"part": "its_part"})
    local = keyed.withColumn("local", F.row_number().over(Window.partitionBy(*same, "part").orderBy("row")) - 1)
    met = local.join(before, (F.col("part") == F.col("its_part")) & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in same]), "left")
    numbered = met.select(*same, (F.col("local") + F.coalesce("start", F.lit(0))).cast("long").alias("number"))
    return written(numbered.withColumn("virtual_slot", F.pmod(F.xxhash64(*same, "number"), F.lit(slots))), "slotted")


def shard(df: DataFrame, shards: int = 8, slots: int = SLOTS, text: str = "text", doc_id: str = "doc_id", table: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version): slot is the row's place in its shard, without gaps from 0.

    table: the map that an earlier call stored; its newest version is edited for what df holds now.
    """
    sized = slotted(df, slots, text, doc_id)
    load, rows = [0] * slots, [0] * slots
    for r in sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # a row a slot
        load[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return placed(sized, edited(df.sparkSession, table, load, rows, shards))


def placed(sized: DataFrame, table: DataFrame) -> DataFrame:
    """What slotted() gave, in the shards of a map's newest version."""
    newest = table.agg(F.max("version")).first()[0]
    latest = table.where(F.col("version") == newest).select(F.col("slot").alias("virtual_slot"), "shard", "first", F.col("version").alias("map_version"))
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "number")
    inside = sized.withColumn("place", F.row_number().over(w) - 1).join(F.broadcast(latest), "virtual_slot")  # as many rows as slots
    return inside.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
