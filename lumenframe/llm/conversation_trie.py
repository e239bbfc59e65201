"""Prefix trie of conversations, with subtree figures by the Euler-tour technique.

Conversations that begin with the same turns share a path of the trie; a shared prefix needs to be computed once, and what that saves is summed
over each subtree. The tour: each node has an arc in (2 * id) and an arc out (2 * id + 1). From an arc in it goes on to the first child's arc in, or,
at a leaf, to the node's own arc out; from an arc out to the next sibling's arc in, or, after the last one, to the parent's arc out. List ranking gives
each arc its position, prefix sums of the weights along positions are taken in blocks, and a subtree's sum is the difference of the sums at its
node's two arcs.

How it is dealt out:

* Turns are put in order by ranges of (conversation, turn), so a conversation of any length is split. Prefixes are told apart by four polynomial
  hashes modulo primes of 31 bits; hashes of parts combine, so each range is hashed on its own and what came before is added.
* Nodes are numbered by (least member, depth). A path that keeps its least member is a run of numbers, so most of the list stays within a
  range of numbers. List ranking contracts what lies within ranges, again and again until few segments are left, ranks these, and unwinds. Where ranges
  don't help (a list that jumps at random) a round by coins joins segments instead.
* What belongs to one node but grows with the data (children of a common first turn, conversations that end alike) is sorted by ranges, never
  collected; a join on a hot parent goes by (range, parent).

Defined cases: rows without conv_id belong to no conversation and are left out; a null role or text is empty, a null turn comes first; rows of one turn
come by role, then by XXH64 of the text; repeated rows are turns of their own; a conversation may end up without turns and is then a member of
the root only; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import block_bounds, block_of, n_words, partitions, written

#: Primes below 2^31 and a base for each: the four parts of a prefix hash.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525351, 1812433253, 1566083941)
LANES = range(4)
#: A conversation takes over fewer than so many turns of the one that its group of twenty begins with.
BORROWED, GROUP = 4, 20
#: Segments of the tour that one task may rank, and the most nodes of a range in the first round.
AT_ONCE, RANGE = 1 << 20, 1 << 17
#: Bytes of joined ids that are passed on as one piece.
PIECE = 1 << 20


def ranged(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df as a stored table in ranges of the order, with __part, the range, and __row, the place in it from 0."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    return written(dealt.withColumns({"__part": F.shiftright("__m", 33).cast("int"), "__row": F.col("__m").bitwiseAND((1 << 33) - 1)}).drop("__m"), name)


def _packed(lanes: list[Column]) -> tuple[Column, Column]:
    return tuple(F.shiftleft(lanes[j].cast("long"), 31).bitwiseOR(lanes[j + 1].cast("long")) for j in (0, 2))


# --- turns in order, with prefix hashes -----------------------------------------------------------------------------------------------


def _powers(n: int) -> np.ndarray:
    """B^0 .. B^(n-1) for each lane."""
    out = np.ones((4, max(n, 1)), dtype=np.int64)
    for j in LANES:
        done = 1
        while done < n:
            step = pow(BASES[j], done, PRIMES[j])
            more = min(done, n - done)
            out[j, done : done + more] = out[j, :more] * step % PRIMES[j]
            done += more
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, x, y, words) -> the same with the range, the place within the conversation's rows of the range, and the hash of these up to the row, before and with it."""
    part = TaskContext.get().partitionId()
    last, seen, total = None, 0, np.zeros(4, dtype=np.int64)
    powers = _powers(1 << 10)
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_numpy(zero_copy_only=False)
        x, y = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (1, 2))
        new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - (1 if new[0] else 0)  # 0: goes on from before, or the first run
        begins = starts if new[0] else np.concatenate([[0], starts])
        base = np.zeros(len(begins), dtype=np.int64)
        if not new[0]:
            base[0] = seen
        k = np.arange(len(conv)) - begins[run] + base[run] + 1
        if k.max() >= powers.shape[1]:
            powers = _powers(2 * int(k.max()))
        before, after = [], []
        for j, half in enumerate((x >> np.uint64(32), x & np.uint64(0xFFFFFFFF), y >> np.uint64(32), y & np.uint64(0xFFFFFFFF))):
            term = (half.astype(np.int64) % PRIMES[j]) * powers[j, k] % PRIMES[j]
            sums = np.cumsum(term)
            own = sums - (sums - term)[begins][run]
            if not new[0]:
                own = own + np.where(run == 0, total[j], 0)
            after.append(own % PRIMES[j])
            before.append((own - term) % PRIMES[j])
        last, seen, total = conv[-1], int(k[-1]), np.array([a[-1] for a in after])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(conv), part, dtype=np.int32)), b.column(0), pa.array(k, pa.int64()), b.column(3), *[pa.array(a, pa.int64()) for a in before], *[pa.array(a, pa.int64()) for a in after]],
            names=["part", "conv_id", "k", "words", *[f"b{j}" for j in LANES], *[f"a{j}" for j in LANES]],
        )


def _turns(conversations: DataFrame) -> DataFrame:
    """(part, conv_id, i, words, b0..b3, a0..a3): every turn with its place in its conversation and the hash of the turns before it and up to it."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(1), text, role).alias("y"), n_words(text).alias("words"), F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(text).alias("t")
    )
    order = ["conv_id", "turn", "role", "t"]
    schema = "part int, conv_id long, k long, words long, " + ", ".join(f"{c}{j} long" for c in "ba" for j in LANES)
    parts = partitions(conversations.sparkSession)
    local = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "x", "y", "words").mapInArrow(_hashed, schema), "trie_turns")
    # what a range's first conversation brings along from the ranges before it: a row a range
    ends = local.groupBy("part").agg(F.max(F.struct("conv_id", "k", *[f"a{j}" for j in LANES])).alias("e")).orderBy("part").collect()
    carried, held = [], None
    for part, e in ends:
        if held is not None:
            carried.append((part, held[0], held[1], *held[2], *[pow(BASES[j], held[1], PRIMES[j]) for j in LANES]))
        own = [e[2 + j] for j in LANES]
        if held is not None and held[0] == e["conv_id"]:
            own = [(held[2][j] + pow(BASES[j], held[1], PRIMES[j]) * own[j]) % PRIMES[j] for j in LANES]
            held = (e["conv_id"], held[1] + e["k"], own)
        else:
            held = (e["conv_id"], e["k"], own)
    brought = conversations.sparkSession.createDataFrame(carried, "part int, conv_id long, n long, " + ", ".join(f"{c}{j} long" for c in "cm" for j in LANES))
    whole = local.join(F.broadcast(brought), ["part", "conv_id"], "left")
    moved = lambda c, j: F.when(F.col("n").isNull(), F.col(f"{c}{j}")).otherwise((F.col(f"c{j}") + F.col(f"m{j}") * F.col(f"{c}{j}")) % PRIMES[j]).alias(f"{c}{j}")
    return whole.select("part", "conv_id", (F.col("k") + F.coalesce("n", F.lit(0))).alias("i"), "words", *[moved(c, j) for c in "ba" for j in LANES])


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations: conv_id, depth, k1, k2, p1, p2, words; the node at which each conversation ends: conv_id, depth, k1, k2)."""
    lanes = [f"a{j}" for j in LANES]
    heads = turns.where(F.col("i") <= BORROWED).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "words", *lanes))).alias("first"))  # four rows at most
    heads = written(heads, "trie_heads")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    wants = heads.where((F.col("conv_id") % GROUP != 0)).withColumn("h", h).where("h > 0").withColumn("source", F.col("conv_id") - F.col("conv_id") % GROUP)
    given = heads.select(F.col("conv_id").alias("source"), F.col("first").alias("theirs"))
    info = wants.join(given, "source", "left").withColumn("theirs", F.coalesce("theirs", F.array().cast(dict(heads.dtypes)["first"]))).withColumn("got", F.least(F.size("theirs"), F.col("h")))
    at = lambda c, n, f: F.coalesce(F.get(F.col(c), F.col(n) - 1)[f], F.lit(0))
    info = info.withColumn("cut", F.least(F.size("first"), F.col("h"))).withColumns({f"s{j}": at("theirs", "got", f"a{j}") for j in LANES} | {f"o{j}": at("first", "cut", f"a{j}") for j in LANES})
    info = written(info.select("conv_id", "h", "got", F.size("first").alias("n"), F.slice("theirs", F.lit(1), F.col("got")).alias("theirs"), *[f"{c}{j}" for c in "so" for j in LANES]), "trie_borrowed")

    # own turns: a conversation's row of info meets its turns by range, so that a long conversation is not one group
    runs = turns.select("part", "conv_id").distinct().join(info.drop("theirs", "n"), "conv_id")
    own = turns.join(runs, ["part", "conv_id"], "left").where(F.coalesce("h", F.lit(0)) < F.col("i"))

    def shifted(c: str, j: int) -> Column:
        back = [pow(BASES[j], -s, PRIMES[j]) for s in range(BORROWED)]
        shift = F.get(F.array(*[F.lit(x).cast("long") for x in back]), (F.col("h") - F.col("got")).cast("int"))
        rest = (F.col(f"{c}{j}") - F.col(f"o{j}") + PRIMES[j]) % PRIMES[j]
        return F.when(F.col("h").isNull(), F.col(f"{c}{j}")).otherwise((F.col(f"s{j}") + shift * rest) % PRIMES[j])

    key, parent = _packed([shifted("a", j) for j in LANES]), _packed([shifted("b", j) for j in LANES])
    depth = F.col("i") - F.coalesce("h", F.lit(0)) + F.coalesce("got", F.lit(0))
    own = own.select("conv_id", depth.alias("depth"), key[0].alias("k1"), key[1].alias("k2"), parent[0].alias("p1"), parent[1].alias("p2"), "words")

    zero = F.lit(0)
    taken = info.select("conv_id", "theirs", F.explode("theirs").alias("t")).withColumn("b", F.get("theirs", (F.col("t.i") - 2).cast("int")))
    k = _packed([F.col(f"t.a{j}") for j in LANES])
    p = _packed([F.coalesce(F.col(f"b.a{j}"), zero) for j in LANES])
    taken = taken.select("conv_id", F.col("t.i").alias("depth"), k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2"), F.col("t.words").alias("words"))
    rows = written(own.withColumn("own", F.lit(True)).unionByName(taken.withColumn("own", F.lit(False))), "trie_rows")

    stop = _packed([F.col(f"s{j}") for j in LANES])
    only = info.where("n <= h").select("conv_id", F.col("got").cast("long").alias("depth"), stop[0].alias("k1"), stop[1].alias("k2"))  # no turn of their own is left
    last = rows.where("own").groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("e")).select("conv_id", "e.*")
    return rows, last.unionByName(only)


# --- list ranking -----------------------------------------------------------------------------------------------------------------------


def _contracted(t: pa.Table) -> pa.Table:
    """Elements (id, size, next) of one range -> each with the head of its chain within the range and its offset there; a chain's last has the chain's size and what comes after."""
    ids, size, after = (t.column(c).to_numpy() for c in ("id", "size", "next"))
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids, after, sorter=order), len(ids) - 1)
    to = order[at]
    inside = ids[to] == after
    n = len(ids)
    head, offset = np.arange(n), np.zeros(n, dtype=np.int64)
    head[to[inside]] = np.flatnonzero(inside)
    offset[to[inside]] = size[inside]
    while True:
        up = head[head]
        if (up == head).all():
            break
        offset += offset[head]
        head = up
    tail = ~inside
    return pa.table({"id": ids, "head": ids[head], "offset": offset, "total": pa.array(offset + size, mask=~tail), "next": pa.array(after, mask=~tail)})


_CONTRACTED = "id long, head long, offset long, total long, next long"


def _by_coins(now: DataFrame, salt: int) -> DataFrame:
    """As a round of _contracted, by coins: a segment whose coin shows 0 joins the one before it if that shows 1. A quarter goes, whatever the list's order."""
    coin = lambda c: F.xxhash64(F.lit(salt), c).bitwiseAND(1)
    heads = now.where(coin(F.col("id")) == 1).select(F.col("id").alias("head"), F.col("size").alias("before"), F.col("next").alias("id"))
    met = now.join(heads.where(coin(F.col("id")) == 0), "id", "left")
    joined = met.where("head is not null").select("id", "head", F.col("before").alias("offset"), (F.col("before") + F.col("size")).alias("total"), "next")
    lone = met.where("head is null").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("offset"), F.col("size").alias("total"), "next")
    passed = joined.select(F.col("head").alias("id"), F.lit(True).alias("passed"))
    lone = lone.join(passed, "id", "left").select("id", "head", "offset", *[F.when(F.col("passed").isNull(), F.col(c)).alias(c) for c in ("total", "next")])
    return lone.unionByName(joined)


def list_ranks(elements: DataFrame, n: int, at_once: int = AT_ONCE, range_: int | None = None) -> DataFrame:
    """Elements (id, size, next; the last has a next of -1) of one list, ids below n -> (id, rank): the sizes of all before it.

    Rounds of contraction within ranges of ids, until at most `at_once` segments are left, which one task ranks; then back down by joins.
    """
    spark = elements.sparkSession
    width = range_ or min(2 * RANGE, max(1 << 13, -(-n // partitions(spark))))
    levels, now, block, count, salt = [], elements, F.floor(F.col("id") / width), n, 0
    while True:
        level = _by_coins(now, salt) if block is None else now.withColumn("block", block).groupBy("block").applyInArrow(_contracted, _CONTRACTED)
        level = written(level, "trie_ranks")
        levels.append(level)
        now = level.where("total is not null").select(F.col("head").alias("id"), F.col("total").alias("size"), "next")
        was, count, salt = count, now.count(), salt + 1
        if count <= at_once:
            break
        # ranges of as many segments as fit, unless the last round hardly helped
        block = None if count > 0.8 * was and len(levels) > 1 else block_of(F.col("id"), block_bounds(now, F.col("id"), max(2, -(-4 * count // at_once))))
        if block is None:
            now = written(now, "trie_segments")
    ranks = now.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: _contracted(t).select(["id", "offset"]), "id long, offset long").withColumnRenamed("offset", "rank")
    for level in reversed(levels):
        starts = ranks.select(F.col("id").alias("head"), F.col("rank").alias("start"))
        ranks = level.join(starts, "head").select("id", (F.col("start") + F.col("offset")).alias("rank"))
    return ranks


# --- the ids that end at a node ---------------------------------------------------------------------------------------------------------


_PIECES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("ids", pa.string()), ("sha", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    return itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in range(columns)), strict=True) for b in batches)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, depth, conv_id) -> a node's ids, comma-joined. Those of a node within the range are hashed; those at its edges, and very many, go on in pieces."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        key, held, length, piece, first = None, [], 0, 0, True
        for *k, c in _rows(batches, 4):
            if key != k:
                if key is not None:
                    text, alone = "".join(held), not first and not piece
                    yield *key, part, piece, None if alone else text, hashlib.sha256(text.encode()).hexdigest() if alone else None
                    first = False
                key, held, length, piece = k, [], 0, 0
            s = f",{c}" if held or piece else str(c)
            held.append(s)
            length += len(s)
            if length >= PIECE:
                yield *key, part, piece, "".join(held), None
                held, length, piece = [], 0, piece + 1
        if key is not None:
            yield *key, part, piece, "".join(held), None

    yield from _batched(rows(), _PIECES, 512)


def _hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (k1, k2, depth, part, piece, ids) -> each node's hash. One SHA-256 has to see its bytes in order; only its state is kept."""

    def rows() -> Iterator[tuple]:
        for key, pieces in itertools.groupby(_rows(batches, 6), key=lambda r: r[:3]):
            sha = hashlib.sha256()
            for n, r in enumerate(pieces):
                sha.update((b"," if n and not r[4] else b"") + r[5].encode())
            yield *key, sha.hexdigest()

    yield from _batched(rows(), pa.schema([*list(_PIECES)[:3], _PIECES.field("sha")]))


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2) -> (k1, k2, depth, ends_sha256)."""
    order = ["k1", "k2", "depth", "conv_id"]
    parts = partitions(ends.sparkSession)
    found = written(ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "k1 long, k2 long, depth long, part int, piece int, ids string, sha string"), "trie_ends")
    pieces = found.where("sha is null").repartition(parts, "k1", "k2", "depth").sortWithinPartitions("k1", "k2", "depth", "part", "piece")
    late = pieces.select("k1", "k2", "depth", "part", "piece", "ids").mapInArrow(_hashed_pieces, "k1 long, k2 long, depth long, sha string")
    return found.where("sha is not null").select("k1", "k2", "depth", "sha").unionByName(late).withColumnRenamed("sha", "ends_sha256")


# --- the trie ---------------------------------------------------------------------------------------------------------------------------


def _numbered(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes: id (from 0, by least member and depth), conv_id, depth, k1, k2, p1, p2, words, n_convs."""
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2")], "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    nodes = rows.groupBy("k1", "k2", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    dealt = ranged(nodes.unionByName(root), "trie_nodes", "conv_id", "depth")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))  # a row a range
    return dealt.join(F.broadcast(before), "__part").withColumn("id", F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def _relatives(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents: id, n_children, first_child), (children: id, parent, parent_conv_id, sibling: the next one)."""
    child = nodes.where("depth > 0")
    of = child.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("id").alias("first_child"))
    parents = written(nodes.select("id", "conv_id", "k1", "k2", "depth").join(of, ["k1", "k2", "depth"]), "trie_parents")
    # children of one parent lie side by side in ranges; of a parent with very many, in several
    dealt = ranged(child.select("p1", "p2", "depth", "id"), "trie_children", "p1", "p2", "depth", "id")
    key = ["p1", "p2", "depth"]
    firsts = dealt.where("__row = 0").select("__part", *[F.col(c).alias(f"n_{c}") for c in (*key, "id")])
    later = firsts.select((F.lag("__part").over(Window.orderBy("__part"))).alias("__part"), *[f"n_{c}" for c in (*key, "id")]).where("__part is not null")  # a row a range
    same = (F.col("n_p1") == F.col("p1")) & (F.col("n_p2") == F.col("p2")) & (F.col("n_depth") == F.col("depth"))
    within = dealt.withColumn("sibling", F.lead("id").over(Window.partitionBy("__part", *key).orderBy("__row"))).join(F.broadcast(later), "__part", "left")
    within = within.withColumn("sibling", F.coalesce("sibling", F.when(same, F.col("n_id")))).select("__part", *key, "id", "sibling")
    runs = dealt.select("__part", *key).distinct().join(parents.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), key)
    children = within.join(runs, ["__part", *key]).select("id", "sibling", "parent", "parent_conv_id")
    return parents.select("id", "n_children", "first_child"), children


def _prefix_sums(arcs: DataFrame, n: int, values: list[str]) -> DataFrame:
    """Arcs (position from 0 without gaps, values) with each value summed up to and with the position, block by block of positions."""
    width = max(1 << 12, min(1 << 18, -(-n // partitions(arcs.sparkSession))))
    dealt = arcs.withColumn("__block", F.floor(F.col("position") / width))
    sizes = dealt.groupBy("__block").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    before = sizes.select("__block", *[(F.sum(f"__{v}").over(Window.orderBy("__block")) - F.col(f"__{v}")).alias(f"__{v}") for v in values])  # a row a block
    up_to = Window.partitionBy("__block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumns({v: F.sum(v).over(up_to) for v in values}).join(before, "__block").withColumns({v: F.col(v) + F.col(f"__{v}") for v in values}).drop("__block", *[f"__{v}" for v in values])


def trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a row a node of the trie of the rebuilt conversations.

    Columns: conv_id (least member), depth, parent_conv_id (the parent's conv_id; the root has none), n_convs (members), n_children, n_leaves and saved_tokens
    (of the subtree, its top included), ends_sha256 (of the ids of the conversations that end here).
    """
    rows, ends = _rebuilt(_turns(conversations))
    ends = written(ends, "trie_stops")
    nodes = written(_numbered(rows, ends), "trie_numbered")
    n = nodes.count()
    parents, children = _relatives(nodes)
    family = nodes.join(parents, "id", "left").join(children, "id", "left")
    family = written(family.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("words")}).drop("p1", "p2", "words"), "trie_family")

    into = F.when(F.col("n_children") > 0, 2 * F.col("first_child")).otherwise(2 * F.col("id") + 1)
    out = F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1, F.lit(-1))
    arc = lambda id_, next_: F.struct(id_.alias("id"), F.lit(1).cast("long").alias("size"), next_.alias("next"))
    arcs = family.select(F.inline(F.array(arc(2 * F.col("id"), into), arc(2 * F.col("id") + 1, out))))
    places = list_ranks(arcs, 2 * n).select(F.shiftright("id", 1).alias("id"), (F.col("id") % 2).alias("side"), F.col("rank").alias("position"))

    weights = family.select("id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    enters = F.col("side") == 0
    weighed = places.join(weights, "id").withColumns({c: F.when(enters, F.col(c)).otherwise(0) for c in ("n_leaves", "saved_tokens")})
    sums = _prefix_sums(weighed, 2 * n, ["n_leaves", "saved_tokens"])
    # a subtree holds what the tour gathers from its node's arc in to its arc out
    signed = lambda c: F.sum(F.when(enters, -F.col(c)).otherwise(F.col(c)))
    within = sums.groupBy("id").agg(*[signed(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    full = family.join(within, "id").withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + F.col("saved")})
    none = hashlib.sha256(b"").hexdigest()
    full = full.join(_end_hashes(ends), ["k1", "k2", "depth"], "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
