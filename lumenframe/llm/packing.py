"""Bounded-space online packing of documents into training windows.

Each partition of the input keeps at most `windows` open windows of `length` tokens. A document's ids (with the end id) are cut into
full windows, which leave at once, and a rest. The rest goes to the open window that it fills best; if none has room, a
new one is opened, after the fullest has left when all are in use. What is still open at the end of the partitions is merged by a tree: the
pieces of up to GROUP partitions are packed again, largest first, and then the emptiest windows are cut up to fill the
others' last places, so that about one window a group stays short. The short windows of up to GROUP groups are merged again in the same way,
and so on, until one group is left. Each group holds a bounded number of windows, whatever the input's size.

Defined cases: a null or empty text is its end id alone; texts of any length are cut into windows; rows with equal ids are packed one by
one; an empty table gives no pieces; extra columns are ignored. The same files in the same splits give the same pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import written
from lumenframe.llm.tokens import default_path, encoder

LENGTH, WINDOWS, END_ID = 2048, 256, 1
#: Partitions (then groups) whose leftovers are merged in one task: at most GROUP * WINDOWS windows of ids, 8 MB, however many partitions there are.
GROUP = 8
#: Documents encoded together: their ids, and the pieces of the windows that they close, are held at once.
AT_ONCE = 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, part int, ids binary"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids")
_TYPES = (pa.int64(),) * 7 + (pa.int32(), pa.binary())


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Open windows of one partition. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.next = length, first_id
        self.room = np.full(windows, -1, dtype=np.int64)
        self.held: list[list] = [[] for _ in range(windows)]
        self.used = 0

    def close(self, pieces: list) -> tuple[int, list]:
        self.next += 1
        return self.next - 1, pieces

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple[int, list]]:
        """The windows that leave because of this document."""
        out, n, at = [], len(ids), 0
        while n - at >= self.length:
            out.append(self.close([(doc_id, at, ids[at : at + self.length], n)]))
            at += self.length
        rest = n - at
        if not rest:
            return out
        piece = (doc_id, at, ids[at:], n)
        left = self.room - rest
        left[left < 0] = self.length
        best = int(left.argmin())
        if self.room[best] < rest:
            if self.used < len(self.room):
                best = self.used
                self.used += 1
            else:
                best = int(self.room.argmin())
                out.append(self.close(self.held[best]))
            self.room[best], self.held[best] = self.length, []
        self.held[best].append(piece)
        self.room[best] -= rest
        if not self.room[best]:
            out.append(self.close(self.held[best]))
            self.room[best], self.held[best] = self.length, []
        return out

    def rest(self) -> list[list]:
        return [h for h in self.held if h]


def merged(pieces: list, length: int) -> list[list]:
    """Windows of leftover pieces: largest first, best fit; then the emptiest windows are cut up to fill the others."""
    windows: list[list] = []
    room = np.zeros(len(pieces), dtype=np.int64)
    for p in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1])):
        left = room[: len(windows)] - len(p[2])
        left[left < 0] = length
        best = int(left.argmin()) if len(left) else 0
        if not len(left) or left[best] == length:
            best = len(windows)
            windows.append([])
            room[best] = length
        windows[best].append(p)
        room[best] -= len(p[2])
    room = room[: len(windows)]
    order = np.argsort(room, kind="stable").tolist()  # fullest first
    low, high = 0, len(order) - 1
    while low < high:
        source = windows[order[high]]
        if room[order[low : high]].sum() < sum(len(p[2]) for p in source):
            break
        for doc_id, start, ids, n in source:
            at = 0
            while at < len(ids):
                while not room[order[low]]:
                    low += 1
                take = min(int(room[order[low]]), len(ids) - at)
                windows[order[low]].append((doc_id, start + at, ids[at : at + take], n))
                room[order[low]] -= take
                at += take
        windows[order[high]] = []
        high -= 1
    return [w for w in windows if w]


def _rows(sequences: list[tuple[int, list]], part: int, keep_ids: bool) -> pa.RecordBatch:
    rows: list[tuple] = []
    for seq, pieces in sequences:
        offset = 0
        for doc_id, start, ids, n in pieces:
            rows.append((doc_id, start, len(ids), crc(ids), n, seq, offset, part, ids.tobytes() if keep_ids else None))
            offset += len(ids)
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=list(_FIELDS))


def pack(df: DataFrame, length: int = LENGTH, windows: int = WINDOWS, end_id: int = END_ID, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row per piece."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what batches of earlier stages left in this worker
        enc, part = encoder(path), TaskContext.get().partitionId()
        packer = Packer(length, windows, part << 36)
        end = np.array([end_id], dtype="<u2")
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                b, out = batch.slice(at, AT_ONCE), []
                for doc_id, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1)), strict=True):
                    out += packer.add(doc_id, np.concatenate([ids, end]))
                yield _rows(out, part, False)
        yield _rows([(-1, w) for w in packer.rest()], part, True)

    pieces = written(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA), "pieces")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        level, group, last = (k.as_py() for k in key)
        held = [(d, s, np.frombuffer(i, dtype="<u2"), n) for d, s, i, n in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
        first = (1 << 62) | (level << 56) | (group << 20)
        found = merged(held, length)
        stays = [last or sum(len(p[2]) for p in w) == length for w in found]
        full = [(first + k, w) for k, w in enumerate(found) if stays[k]]
        short = [(-1, w) for k, w in enumerate(found) if not stays[k]]
        return pa.Table.from_batches([_rows(full, group, False), _rows(short, group, True)])

    out, open_, level = pieces.where("ids is null"), pieces.where("ids is not null"), 0
    groups = (open_.agg(F.max("part")).first()[0] or 0) + 1
    while groups:
        level, groups = level + 1, -(-groups // GROUP)
        keys = [F.lit(level).alias("level"), F.floor(F.col("part") / GROUP).cast("int").alias("group"), F.lit(groups == 1).alias("last")]
        again = open_.groupBy(*keys).applyInArrow(merge, SCHEMA)  # GROUP * windows * length ids at most, above the first level GROUP short windows
        if groups == 1:
            return out.unionByName(again).drop("part", "ids")
        again = written(again, f"merged{level}")
        out, open_ = out.unionByName(again.where("ids is null")), again.where("ids is not null")
