"""Token-id shards compressed by Re-Pair grammars.

Documents in ascending id order are cut into shards of about SHARD_IDS ids (documents are never cut). In each shard frequent pairs
of neighbouring symbols are replaced by nonterminals, the most frequent first, until no pair is met LEAST times any more or the symbols run out
(they stay below 2**16). Pairs are taken by levels: all pairs met so often are replaced, from left to right where they do not overlap, then
the level is quartered, down to LEAST, where counting and replacing go on until no such pair is left. A shard's file holds the rules, the length each expands to, the
documents' ids and counts, and the final sequence; with the lengths any range of ids is expanded without the rest. Files are rows
(block, part, content) of a table in the shared folder.

Defined cases: a null or empty text is its end id alone; texts of any length are whole (a longer one makes a longer shard); rows with equal
ids follow one another, ordered by text; null ids come first; an empty table gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import block_bounds, block_of, id_key, partitions, written
from lumenframe.llm.tokens import default_path, encoder

SHARD_IDS, LEAST, END_ID = 1 << 20, 8, 0
_HEAD = struct.Struct("<4sHHIQQQQ")
_MAGIC, _VERSION = b"LFRP", 2
NO_ID = -(2**63)
_SLOT_BITS = 19
#: Pieces remembered here: a worker holds little else.
_REMEMBERED = 1_500_000


def compress(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """ids are below `first`. (sequence, rules as rows (left, right), where each round's rules end)."""
    seq, rules, ends, free, level, slot = ids.astype(np.uint16), [], [], (1 << 16) - first, None, None
    while free and len(seq) > 1:
        if slot is None:  # the sequence is new: a bound on each pair's count by slots that pairs may share
            pair = seq[:-1].astype(np.uint32)
            pair <<= np.uint32(16)
            pair |= seq[1:]
            slot = ((pair * np.uint32(2654435761)) >> np.uint32(32 - _SLOT_BITS)).astype(np.int32)
            bound = np.bincount(slot, minlength=1 << _SLOT_BITS)
        most = int(bound.max())
        level = most if level is None else min(level, most)
        if level < least:
            break
        some = np.flatnonzero((bound >= level)[slot])  # no pair met `level` times is missed
        pairs, code, count = np.unique(pair[some], return_inverse=True, return_counts=True)
        frequent = np.flatnonzero(count >= level)
        if not len(frequent):
            if level == least:
                break
            level = max(least, level // 4)
            continue
        frequent = frequent[np.argsort(-count[frequent], kind="stable")[:free]]
        for picked in (frequent, frequent[:1]):  # the most frequent one alone, should overlaps leave all together too little
            rank = np.full(len(pairs), -1, dtype=np.int32)
            rank[picked] = np.arange(len(picked), dtype=np.int32)
            which = rank[code]
            hit = which >= 0
            pos, which, chosen = some[hit], which[hit], pairs[picked]
            n = np.arange(len(pos))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(pos) != 1], n, 0))
            alternate = (n - run) % 2 == 0
            pos, which = pos[alternate], which[alternate]
            worth = np.bincount(which, minlength=len(chosen)) >= max(least // 2, level // 4)
            kept = worth[which]
            pos, which = pos[kept], which[kept]
            if len(pos):
                break
        level = max(least, level // 4)
        name = np.cumsum(worth) - 1 + first + (ends[-1] if ends else 0)
        seq[pos] = name[which].astype(np.uint16)
        stays = np.ones(len(seq), dtype=bool)
        stays[pos + 1] = False
        seq, slot = seq[stays], None
        new = chosen[worth]
        rules.append(np.stack([new >> np.uint32(16), new & np.uint32(0xFFFF)], axis=1).astype(np.uint16))
        ends.append((ends[-1] if ends else 0) + len(new))
        free -= len(new)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint16), ends


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    n = length[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(start[symbols] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Shard:
    """A shard's file, opened."""

    def __init__(self, content: bytes):
        magic, version, rounds, first, n_docs, self.n_ids, n_rules, n_seq = _HEAD.unpack_from(content)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a shard of this format")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(content, dtype=kind, count=n, offset=at)
            at += got.nbytes
            return got

        ends = take("<u4", rounds)
        self.doc_ids, self.counts = take("<i8", n_docs), take("<u4", n_docs)
        rules, self.lengths = take("<u2", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.seq = take("<u2", n_seq)
        self.length = np.concatenate([np.ones(first, dtype=np.int64), self.lengths.astype(np.int64)])
        self.flat, start = np.arange(first, dtype=np.uint16), np.arange(first)
        done = 0
        for e in ends.tolist():  # the rules of a round expand to what earlier rounds and the vocabulary give
            new = _gather(self.flat, start, self.length, rules[done:e].reshape(-1))
            size = self.length[first + done : first + e]
            start = np.concatenate([start, len(self.flat) + np.cumsum(size) - size])
            self.flat = np.concatenate([self.flat, new])
            done = e
        self.start = start

    def ids(self) -> np.ndarray:
        return _gather(self.flat, self.start, self.length, self.seq)

    def range(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.length[self.seq])
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, start + n, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return _gather(self.flat, self.start, self.length, self.seq[a:b])[start - before : start - before + n]


def shard_file(doc_ids: list[int], counts: list[int], ids: np.ndarray, first: int, least: int = LEAST) -> bytes:
    seq, rules, ends = compress(ids, first, least)
    length = np.ones(first + len(rules), dtype=np.uint32)
    done = 0
    for e in ends:
        length[first + done : first + e] = length[rules[done:e, 0]] + length[rules[done:e, 1]]
        done = e
    head = _HEAD.pack(_MAGIC, _VERSION, len(ends), first, len(doc_ids), len(ids), len(rules), len(seq))
    return b"".join([head, np.array(ends, "<u4").tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), rules.astype("<u2").tobytes(), length[first:].astype("<u4").tobytes(), seq.astype("<u2").tobytes()])


def write_shards(df: DataFrame, shard_ids: int = SHARD_IDS, end_id: int = END_ID, tokenizer: str | None = None, text: str = "text", least: int = LEAST) -> DataFrame:
    """Writes the shards and returns their table: block, part (ascending with the ids), n_docs, n_ids, content."""
    path = tokenizer or default_path()
    p = partitions(df.sparkSession)
    docs = df.select(id_key().alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = block_bounds(docs, F.col("key"), p)
    dealt = docs.withColumn("block", block_of(F.col("key"), bounds)).repartitionById(p, "block").sortWithinPartitions("block", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, _REMEMBERED), np.array([end_id], dtype="<u2")
        block, part, size = None, 0, 0
        names: list[int] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            content = shard_file(names, [len(x) for x in held], ids, max(enc.first_free, end_id + 1), least)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([content], pa.binary())], names=["block", "part", "n_docs", "n_ids", "content"])

        for b in batches:
            for key, encoded, own in zip(b.column(0).to_pylist(), enc.batch(b.column(1)), b.column(2).to_pylist(), strict=True):
                if names and (own != block or size >= shard_ids):
                    yield out()
                    part, names, held, size = (part + 1 if own == block else 0), [], [], 0
                block = own
                ids = np.concatenate([encoded, end])
                names.append(key)
                held.append(ids)
                size += len(ids)
        if names:
            yield out()

    return written(dealt.mapInArrow(run, "block int, part int, n_docs bigint, n_ids bigint, content binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, block, part) of every document, from the shards' content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, part, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Shard(content)
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.counts.astype(np.int64))
                starts = ends - s.counts
                crcs = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids), pa.array(starts), pa.array(s.counts.astype(np.int64)), pa.array(crcs, pa.int64()), pa.array(np.full(n, block, np.int32)), pa.array(np.full(n, part, np.int32))], names=["key", "local", "n_tokens", "ids_crc32", "block", "part"])

    docs = shards.select("block", "part", "content").mapInArrow(run, "key bigint, local bigint, n_tokens bigint, ids_crc32 bigint, block int, part int")
    sizes = shards.select("block", "part", "n_ids")
    rows = Window.unboundedPreceding, Window.currentRow
    of_block = sizes.groupBy("block").agg(F.sum("n_ids").alias("n"))  # a row a block; there is a block a shuffle partition
    of_block = of_block.select("block", (F.sum("n").over(Window.orderBy("block").rowsBetween(*rows)) - F.col("n")).alias("base"))
    of_part = sizes.join(of_block, "block").select("block", "part", (F.col("base") + F.sum("n_ids").over(Window.partitionBy("block").orderBy("part").rowsBetween(*rows)) - F.col("n_ids")).alias("base"))
    return docs.join(of_part, ["block", "part"]).select(F.when(F.col("key") != F.lit(NO_ID), F.col("key")).alias("doc_id"), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "block", "part")
