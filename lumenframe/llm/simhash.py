"""SimHash near-duplicate classes by the generalised pigeonhole principle.

1. fingerprint: 64 bits a text; a bit is set if it is set in over half the hashes (XXH64, seed 42) of the text's shingles.
2. Equal fingerprints are folded into one class before anything is compared.
3. plan: on a bounded sample of the distinct fingerprints (`SAMPLE`, smallest hashes first; it only steers cost, never the result)
   correlated bits are grouped into partitions, and a dynamic programme gives each partition i its own threshold t_i >= -1 with
   sum(t_i + 1) = T + 1, so that the estimated candidates plus probes are fewest. Two fingerprints within T bits then differ
   in at most t_i bits of some partition i.
4. probe: each fingerprint is sent to the bucket of its own value and of all values within t_i bits, for each partition.
5. verify: all members of a bucket are compared on all 64 bits, by search from member to member, so that no list of pairs is ever held. A bucket
   gives a spanning forest of its verified links; buckets past `HOT` are dealt out by runs of the bits outside their partition, and within a task
   groups past it are cut further by the same principle.
6. Components of the links by alternating large-star and small-star rounds on tables in the shared folder. Centres with more than an even share of
   the links are joined by broadcast (there are few of them), so none of them fills a task.

`deduplicate` takes loose groups of texts, linked by fingerprints and by bands, and settles each of them by the Jaccard likeness of whole sets of 5-word shingles.

Defined cases: a null, empty or blank text has fingerprint 0 and is linked like any other; a text with fewer words than a shingle is
hashed whole; equal texts and rows with equal ids are all returned; a null doc_id orders before all others and its component is null only
if the smallest member is null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import id_key, partitions, removed, stored, unused, written

BITS, SEED = 64, 42
SAMPLE = 20_000
#: Members of a bucket past which it is dealt out to finer ones, and which a task compares at once.
HOT = 20_000
#: Bands of a text's shingle minima and minima a band: at a likeness of 0.8 all but 0.02 % of pairs share a band (1 - (1 - 0.8**7)**36).
BANDS, BAND = 36, 7
_TURNS = np.random.default_rng(SEED).integers(0, 1 << 32, BANDS * BAND, dtype=np.uint32)[:, None] | np.uint32(1)
#: Texts and characters of a part of a loose group; a tile holds two parts.
HALF, HALF_CHARS = 500, 4_000_000
#: What one probe (a row to shuffle, sort and read) costs, in comparisons (a few nanoseconds each).
PROBE_COST = 500
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingles(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words joined by a space, repeats included; the whole sequence if it is shorter."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [joined]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    return [joined[a:b] for a, b in zip((ends - lengths).tolist(), ends[k - 1 :].tolist(), strict=False)]


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half the (big-endian) hashes; rows are summed in slices, so memory is bounded."""
    n, counts = len(hashes), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_of(text: str | None, k: int = 4) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    grams = _shingles(words, k)
    if not grams:
        return 0
    h = xxhash.xxh64_intdigest
    return _majority(np.fromiter((h(g, SEED) for g in grams), dtype=">u8", count=len(grams)))


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """The set of a text's k-word shingles as ascending 64-bit hashes."""
    grams = _shingles(_WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)), k)
    h = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((h(g, SEED) for g in grams), dtype=np.uint64, count=len(grams)))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """MinHash: the least of the hashes after each of BANDS * BAND multiplications, folded into a number a band; no hashes give no bands."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    low = hashes.astype(np.uint32)
    least = np.full(BANDS * BAND, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):  # stays in the cache, and memory is bounded
        np.minimum(least, (low[None, at : at + 1024] * _TURNS).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND).astype(np.uint64) * _ODD
    rows = rows ^ (rows >> np.uint64(29))
    return ((rows * _ODD[::-1]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def banded(df: DataFrame, text: str = "text") -> DataFrame:
    """(id, copy, fp, bands): the key of the doc_id, a digest of the text, its fingerprint (null without words), and the bands of its 5-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            copy = pa.array([hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            bands = pa.array([bands_of(shingle_hashes(t)) for t in texts], pa.list_(pa.int64()))
            fp = np.fromiter((fingerprint_of(t) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            fp = pa.array(fp, mask=np.fromiter((not n for n in pc.list_value_length(bands).to_pylist()), dtype=bool, count=len(texts)))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "copy": copy, "fp": fp, "bands": bands})

    return df.select(id_key().alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, copy binary, fp bigint, bands array<bigint>")


def with_least(rows: DataFrame, key: str, value: str, share: int) -> DataFrame:
    """rows (a stored table) with m, the least `value` among the rows of the same key. Keys with more than `share` rows, which are few, are joined by broadcast, so that none fills a task."""
    least = written(rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n")), "least")
    hot, cool = least.where(F.col("n") > share).select(key, "m"), least.where(F.col("n") <= share).select(key, "m")
    if hot.isEmpty():
        return rows.join(cool, key)
    hot = F.broadcast(hot)  # fewer than rows / share keys
    return rows.join(hot, key, "left").where("m is null").drop("m").join(cool, key).unionByName(rows.join(hot, key))


def even_share(spark, rows: int) -> int:
    """Rows of a key that are no more than a quarter of what a partition holds on average."""
    return max(1, rows // (4 * partitions(spark)))


def band_links(reps: DataFrame) -> DataFrame:
    """reps: (key, bands). (a, b), a < b: the members of a band, each with its least."""
    sent = written(reps.select("key", F.explode("bands").alias("band")), "sent")
    return with_least(sent, "band", "key", even_share(reps.sparkSession, sent.count())).where("key > m").select(F.col("m").alias("a"), F.col("key").alias("b")).distinct()


def print_links(reps: DataFrame, limit: int = 4) -> DataFrame:
    """reps: (key, fp). (a, b), a < b: links of fingerprints of limit or fewer differing bits; each of equal ones with the least key. A null fp links nothing."""
    prints = written(reps.select("key", "fp").where("fp is not null"), "prints")
    equal = with_least(prints, "fp", "key", even_share(reps.sparkSession, prints.count())).where("key > m").select(F.col("m").alias("a"), F.col("key").alias("b"))
    near = near_links(written(prints.groupBy("fp").agg(F.min("key").alias("id")), "folded"), limit)
    return equal if near is None else equal.unionByName(near)


def fingerprints(df: DataFrame, k: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, fp); fp is signed, as Spark's longs are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.fromiter((fingerprint_of(t, k) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(fp)})

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


# --- the plan ---------------------------------------------------------------------------------------------------------------------


def group_bits(sample: np.ndarray, parts: int) -> list[int]:
    """Masks of `parts` partitions of nearly equal width; each is grown from a bit by adding the bit most correlated with those it has."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    scale[scale == 0] = 1
    corr = np.abs(centred.T @ centred) / np.outer(scale, scale)
    free, masks = list(range(BITS)), []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        own = [free.pop(0)]
        while len(own) < width:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        masks.append(sum(1 << (BITS - 1 - b) for b in own))
    return masks


def ball(mask: int, radius: int) -> list[int]:
    """All subsets of the mask's bits of at most so many bits."""
    own = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(c) for r in range(radius + 1) for c in combinations(own, r)]


def bit_runs(mask: int, n: int) -> list[int]:
    """The mask's bits dealt into n masks."""
    own = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(own[r::n]) for r in range(n)]


def _near_share(values: np.ndarray, mask: int, radius: int) -> float:
    """The share of the sample's ordered pairs that differ in at most radius bits of the mask."""
    v, c = np.unique(values & np.uint64(mask), return_counts=True)
    hits = 0
    for x in ball(mask, radius):
        at = np.minimum(np.searchsorted(v, v ^ np.uint64(x)), len(v) - 1)
        hits += int((c * c[at] * (v[at] == (v ^ np.uint64(x)))).sum())
    return max(hits - len(values), 0.1) / (len(values) * max(len(values) - 1, 1)) if len(values) else 0.0


def allocate(cost: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds t_i from cost[i]'s keys (-1 costs 0) with sum(t_i + 1) = total and the least summed cost: dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, ts) in best.items():
            for t, x in ({-1: 0.0} | c).items():
                u = used + t + 1
                if u <= total and (u not in step or so_far + x < step[u][0]):
                    step[u] = (so_far + x, [*ts, t])
        best = step
    return best[total][1]


def plan(sample: np.ndarray, n: int, limit: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each probed partition, for n distinct fingerprints and links of at most `limit` bits."""
    found: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for parts in range(2, limit + 3):
        masks = group_bits(sample, parts)
        deepest = max(0, min(2, limit - parts + 2))
        cost = []
        for m in masks:
            width = m.bit_count()
            cost.append({t: PROBE_COST * sum(comb(width, r) for r in range(t + 1)) + n * _near_share(sample, m, t) for t in range(deepest + 1)})
        if parts * (deepest + 1) < limit + 1:
            continue
        ts = allocate(cost, limit + 1)
        total = sum(c[t] for c, t in zip(cost, ts, strict=True) if t >= 0)
        if total < found[0]:
            found = (total, [(m, t) for m, t in zip(masks, ts, strict=True) if t >= 0])
    return found[1]


# --- probing and verifying --------------------------------------------------------------------------------------------------------


def _roots(fp: np.ndarray, limit: int) -> np.ndarray:
    """For each fingerprint the place of one it is linked to, directly or not, the same for all of a component. Found members are left out of what is still compared."""
    label, rest = np.arange(len(fp)), np.arange(len(fp))
    while len(rest):
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            near = np.bitwise_count(fp[rest] ^ fp[todo.pop()]) <= limit
            if near.any():
                found, rest = rest[near], rest[~near]
                label[found] = root
                todo += found.tolist()
    return label


def linked(fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a spanning set of the links within limit bits; past HOT members by buckets of limit + 1 runs of bits, recursively."""

    def split(at: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if bits.bit_count() <= limit:  # they differ in no other bits
            return [(np.repeat(at[:1], len(at) - 1), at[1:])]
        if len(at) <= HOT:
            label = _roots(fp[at], limit)
            moved = np.flatnonzero(label != np.arange(len(at)))
            return [(at[label[moved]], at[moved])]
        out = []
        for run in bit_runs(bits, limit + 1):
            key = fp[at] & np.uint64(run)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > 1:
                    out += split(at[order[x:y]], bits & ~run)
        return out

    got = split(np.arange(len(fp)), (1 << BITS) - 1)
    return np.concatenate([a for a, _ in got] or [np.zeros(0, int)]), np.concatenate([b for _, b in got] or [np.zeros(0, int)])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place it is linked to, directly or not."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        rest = label[a] != label[b]
        a, b = a[rest], b[rest]
        if len(a):  # roots too, so that a chain takes few rounds
            np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
    while (label[label] != label).any():
        label = label[label]
    return label


def links(classes: DataFrame, chosen: list[tuple[int, int]], limit: int) -> DataFrame:
    """classes: (id, fp). (a, b) of a spanning forest of each bucket's verified links, a < b."""
    spark = classes.sparkSession
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    probes = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).bitwiseXOR(F.lit(signed(x)).cast("long")).alias("value")) for i, (m, t) in enumerate(chosen) for x in ball(m, t)]
    carried = ["id", "fp"]
    sent = classes.select(F.explode(F.array(*probes)).alias("key"), *carried).select(F.xxhash64("key.part", "key.value").alias("bucket"), "key.part", *carried)
    hot = written(sent.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("bucket"), "hot")
    if not hot.isEmpty():
        # a close pair also differs by `limit` bits at most outside the partition: of limit + 1 runs of those bits it shares one
        runs = F.array(*[F.array(*[F.lit(signed(r)).cast("long") for r in bit_runs(~m & ((1 << BITS) - 1), limit + 1)]) for m, _ in chosen])
        finer = F.explode(F.transform(F.get(runs, F.col("part")), lambda r, i: F.xxhash64("bucket", i, F.col("fp").bitwiseAND(r))))
        split = sent.join(hot, "bucket", "left_semi").select(finer.alias("bucket"), "part", *carried)
        sent = sent.join(hot, "bucket", "left_anti").unionByName(split)
    sent = sent.drop("part")

    def within(fp: np.ndarray, bucket: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = [], []
        size = np.diff(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]))
        start = np.repeat(np.cumsum(size) - size, size)
        size = np.repeat(size, size)
        few = size <= 64
        offset = 1
        at = np.flatnonzero(few & (size > 1))
        while len(at):
            at = at[at + offset < start[at] + size[at]]
            hit = at[np.bitwise_count(fp[at] ^ fp[at + offset]) <= limit]
            first.append(hit)
            second.append(hit + offset)
            offset += 1
        for s in np.unique(start[~few]):
            a, b = linked(fp[s : s + size[s]], limit)
            first.append(a + s)
            second.append(b + s)
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (first, second))
        root = _forest(len(fp), a, b)
        moved = np.flatnonzero((root != np.arange(len(fp))) & (ids[root] != ids))
        x, y = ids[root[moved]], ids[moved]
        return np.minimum(x, y), np.maximum(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            a, b = within(t.column("fp").to_numpy().view(np.uint64), t.column("bucket").to_numpy(), t.column("id").to_numpy())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if cut or (kept and kept[-1].column(0)[-1].as_py() != bucket[0]):
                yield out([*kept, batch.slice(0, cut)] if cut else kept)
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield out(kept)

    grouped = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return grouped.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), a < b. (id, component) of every linked id: the least id reachable. Alternating large-star and small-star, until nothing changes."""
    spark = edges.sparkSession
    path = stored(edges.select("a", "b"), "edges")
    edges = spark.read.schema("a bigint, b bigint").parquet(path)
    before, rows = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        share = even_share(spark, rows)
        large = written(with_least(both, "a", "b", 2 * share).where("b > a").select(F.least("m", "a").alias("a"), "b").where("a <> b").distinct(), "large")
        # now every row has a < b, and for small-star b is the centre
        small = with_least(large, "b", "a", share).select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old, path = path, stored(small, "edges")
        removed(spark, old)
        edges = spark.read.schema("a bigint, b bigint").parquet(path)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
        before, rows = now, now[0]


def near_links(prints: DataFrame, limit: int) -> DataFrame | None:
    """prints: (id, fp), both unique. (a, b), a < b: a spanning set of the links of fingerprints of limit or fewer differing bits; None if there are fewer than two."""
    n = prints.count()
    sample = np.array([r["fp"] for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    return None if n < 2 else links(prints, plan(sample, n, limit), limit)


def classes(prints: DataFrame, limit: int) -> DataFrame:
    """prints: (id, fp), both unique. (id, component) for the linked ones."""
    near = near_links(prints, limit)
    return prints.sparkSession.range(0).select(F.col("id"), F.col("id").alias("component")) if near is None else components(near)


def near_duplicates(df: DataFrame, k: int = 4, limit: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of df: fingerprints link at limit or fewer differing bits."""
    prints = written(fingerprints(df, k), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.min(id_key()).alias("id"), F.count("*").alias("n")), "classes")
    found = classes(reps.select("id", "fp"), limit)
    named = written(reps.join(found, "id", "left").select("fp", "n", F.coalesce("component", "id").alias("component")), "named")
    often = F.col("n") > even_share(df.sparkSession, prints.count())  # few, as they share the rows
    hot, cool = named.where(often).drop("n"), named.where(~often).drop("n")
    joined = prints.join(F.broadcast(hot), "fp").unionByName(prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cool, "fp"))
    return joined.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != F.lit(-(2**63)), F.col("component")).alias("component_id")
    )


class Sets:
    """Shingle sets of some texts, numbered so that overlaps are counted by array look-ups."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.cumsum(self.size) - self.size
        self.marked = np.zeros(len(names), dtype=bool)

    def likeness(self, u: int, others: np.ndarray) -> np.ndarray:
        """The Jaccard likeness of set u to each of the others, none of them empty."""
        own = self.flat[self.start[u] : self.start[u] + self.size[u]]
        self.marked[own] = True
        n = self.size[others]
        ends = np.cumsum(n)
        shared = np.add.reduceat(self.marked[self.flat[np.repeat(self.start[others] - ends + n, n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
        self.marked[own] = False
        return shared / (n + self.size[u] - shared)


EXACT = 1e-9  # quotients of whole numbers below 2**26 differ by more


def alike(sets: Sets, least: float) -> np.ndarray:
    """For each of the sets the least place of those it is linked to, directly or not, by a Jaccard likeness of `least` or more; empty sets resemble nothing."""
    size, label = sets.size, np.arange(len(sets.size))
    rest = np.flatnonzero(size > 0)
    while len(rest):
        root, rest, todo = rest[0], rest[1:], [rest[0]]
        while todo and len(rest):
            u = todo.pop()
            near = rest[np.minimum(size[rest], size[u]) >= least * np.maximum(size[rest], size[u]) - EXACT]
            if len(near):
                hit = near[sets.likeness(u, near) >= least - EXACT]
                label[hit] = root
                rest = rest[~np.isin(rest, hit)]
                todo += hit.tolist()
    return label


def _tiles(sent: DataFrame, similarity: float) -> DataFrame:
    """sent: (component, low, high, far, key, text). (a, b, far): links within each tile, and, where far is set, how far each text is from the tile's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(far: bool, keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            at, known = np.array(keys, dtype=np.int64), Sets(sets)
            x, y = at, at[alike(known, similarity)]
            moved = x != y
            a, b, d = np.minimum(x, y)[moved], np.maximum(x, y)[moved], np.full(moved.sum(), np.nan)
            if far:
                filled = np.flatnonzero(known.size > 0)
                away = np.ones(len(at))
                if known.size[0]:
                    away[filled] = 1 - known.likeness(0, filled)
                a, b, d = np.r_[a, np.full(len(at), at[0])], np.r_[b, at], np.r_[d, away]
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "far": pa.array(d, pa.float64(), mask=np.isnan(d))})

        tile, keys, sets = None, [], []
        for batch in batches:
            for c, low, high, far, key, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if tile != (c, low, high, far):
                    if len(keys) > 1:
                        yield out(tile[3], keys, sets)
                    tile, keys, sets = (c, low, high, far), [], []
                keys.append(key)
                sets.append(shingle_hashes(text))
        if len(keys) > 1:
            yield out(tile[3], keys, sets)

    grouped = sent.repartition(partitions(sent.sparkSession), "component", "low", "high").sortWithinPartitions("component", "low", "high", "key")
    return grouped.select("component", "low", "high", "far", "key", "text").mapInArrow(run, "a bigint, b bigint, far double")


def _parts(members: DataFrame) -> DataFrame:
    """(component, parts): how many parts of HALF texts or HALF_CHARS characters a group is dealt into by a hash of its keys."""
    parts = F.ceil(F.greatest(F.count("*") / F.lit(HALF), F.sum(F.length("text")) / F.lit(HALF_CHARS))).cast("int")
    return members.groupBy("component").agg(F.greatest(F.lit(1), parts).alias("parts"))


def settled(texts: DataFrame, loose: DataFrame, similarity: float) -> DataFrame:
    """texts: (key, text); loose: (key, component), a component being its least key. (a, b), a < b, of a spanning set of the links of each loose group by exact Jaccard likeness of 5-word shingles.

    First each part of a group meets the group's centre (its least key): work in proportion to the group. That settles groups of one part, and of the
    others all texts alike to the centre. As Jaccard distance is a metric, a text at distance y from the centre can't be alike to one at x > y + (1 -
    similarity). So only texts unlike the centre, and those far enough from it to be alike to the nearest of these, go on: every two parts of them meet in a
    tile, so all their pairs are decided and no task holds a group.
    """
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    members = texts.join(loose, "key")
    sized = members.join(_parts(members), "component")
    centre = (F.col("key") == F.col("component")) & (F.col("parts") > 1)
    sent = sized.withColumn("low", F.explode(F.when(centre, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    first = written(_tiles(sent.select("component", "low", F.lit(-1).alias("high"), (F.col("parts") > 1).alias("far"), "key", "text"), similarity), "first")
    away = first.where("far is not null").groupBy(F.col("a").alias("component"), F.col("b").alias("key")).agg(F.min("far").alias("far"))
    bound = 1 - similarity + EXACT
    unlike = away.where(F.col("far") > bound).groupBy("component").agg(F.min("far").alias("nearest"))
    again = written(away.join(unlike, "component").where(F.col("far") >= F.col("nearest") - bound).select("component", "key"), "again")
    found = first.where("far is null").select("a", "b").unionByName(away.where((F.col("far") <= bound) & (F.col("key") > F.col("component"))).select(F.col("component").alias("a"), F.col("key").alias("b")))
    if again.isEmpty():
        return found.distinct()
    members = texts.join(again, "key")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
    sent = members.join(_parts(members), "component").withColumn("own", own).withColumn("other", F.explode(others))
    sent = sent.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.lit(False).alias("far"), "key", "text")
    return found.unionByName(_tiles(sent, similarity).select("a", "b")).distinct()


def deduplicate(df: DataFrame, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of df less all but one of each near-duplicate group (that of the smallest doc_id stays, of those the text of smallest digest), with df's columns.

    Exact copies are folded first by a digest of the text, and each distinct text gets a number of its own, so rows that share an id but not a text are
    treated apart. Loose groups are texts linked by their SimHash fingerprints (4 or fewer differing bits, by the pigeonhole plan above), and, since an edit in one
    place can move a fingerprint further, by bands of MinHash values of their 5-word shingles, whose recall depends on the shingles' likeness alone. Within a loose group every pair is decided by the exact Jaccard likeness of the shingles. Of rows equal in id and text one stays; texts
    without words resemble only exact copies.
    """
    ident, copy = unused(df, "id", "copy")
    number = unused(df, "key")[0]
    prints = written(banded(df, text), "bands")
    reps = prints.groupBy("copy").agg(F.min(F.struct("id", "fp", "bands")).alias("r")).select("copy", "r.*")
    reps = written(reps.withColumn("key", F.monotonically_increasing_id()), "copies")  # kept as written, so a number stays its text's
    twice = written(prints.groupBy("id", "copy").count().where("count > 1").select(F.col("id").alias(ident), F.col("copy").alias(copy)), "twice")
    rows = df.withColumn(ident, id_key()).withColumn(copy, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))

    def once(some: DataFrame) -> DataFrame:
        return some.join(twice, [ident, copy], "left_anti").unionByName(some.join(twice, [ident, copy], "left_semi").dropDuplicates([ident, copy]))

    loose = components(print_links(reps).unionByName(band_links(reps)).distinct())
    loose = written(loose.unionByName(loose.select(F.col("component").alias("id"), "component")).distinct().withColumnRenamed("id", "key"), "loose")
    members = reps.join(loose, "key", "left_semi").select(F.col("key").alias(number), F.col("id").alias(ident), F.col("copy").alias(copy))
    texts = once(rows.join(members, [ident, copy])).select(F.col(number).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = components(settled(texts, loose, similarity))
    classes_ = reps.join(found.withColumnRenamed("id", "key"), "key", "left").groupBy(F.coalesce("component", "key")).agg(F.min(F.struct("id", "copy")).alias("r"))
    stay = classes_.select(F.col("r.id").alias(ident), F.col("r.copy").alias(copy))
    return once(rows.join(stay, [ident, copy], "left_semi")).select(*df.columns)
