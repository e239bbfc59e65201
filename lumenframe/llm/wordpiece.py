"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces need, in the plain form, a new scan of the vocabulary after every piece. Here the vocabulary is a trie
whose nodes carry a failure link (where matching goes on once the longest pieces of what was read are popped) and the number of
pieces popped on the way. A word is then counted in one pass, each byte followed once, and no piece is built.

The vocabulary is that of a public byte-level file: its pieces that begin with a space open a word, the others continue one; every single
byte may open a word too, so that no word is unknown. Words are runs of characters other than ASCII white space.

Defined cases: a null, empty or blank text has no words and no tokens; words of any length are counted whole; repeated rows are counted one by
one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tokens import default_path

REMEMBERED, LONGEST = 1_000_000, 64
NONE = -1


class Automaton(dict):
    """word (bytes) -> number of pieces, or -1 if it has no segmentation; recent results are kept up to REMEMBERED words."""

    def __init__(self, opening: Iterable[bytes], continuing: Iterable[bytes]):
        super().__init__()
        self.step: dict[int, int] = {}
        parent, byte, is_piece = [NONE, NONE], [0, 0], [False, False]
        for root, pieces in ((0, opening), (1, continuing)):
            for p in pieces:
                u = root
                for c in p:
                    v = self.step.get(u << 8 | c)
                    if v is None:
                        v = self.step[u << 8 | c] = len(parent)
                        parent.append(u)
                        byte.append(c)
                        is_piece.append(False)
                    u = v
                if u > 1:
                    is_piece[u] = True
        n = len(parent)
        self.fail, self.pops = [NONE] * n, [0] * n
        depth = [0] * n
        for v in range(2, n):  # parents come before their children
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(2, n), key=depth.__getitem__):
            if is_piece[v]:
                self.fail[v], self.pops[v] = 1, 1
                continue
            z, popped = self.fail[parent[v]], self.pops[parent[v]]
            while z != NONE and (z << 8 | byte[v]) not in self.step:
                popped += self.pops[z]
                z = self.fail[z]
            if z != NONE:
                self.fail[v], self.pops[v] = self.step[z << 8 | byte[v]], popped

    def count(self, word: bytes) -> int:
        step, fail, pops, u, n = self.step.get, self.fail, self.pops, 0, 0
        for c in word:
            v = step(u << 8 | c)
            while v is None:
                if fail[u] == NONE:
                    return NONE
                n += pops[u]
                u = fail[u]
                v = step(u << 8 | c)
            u = v
        while u != 1:
            if fail[u] == NONE:
                return NONE
            n += pops[u]
            u = fail[u]
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= LONGEST and len(self) < REMEMBERED:
            self[word] = n
        return n


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """(opening, continuing) pieces of a byte-level vocabulary file."""
    of = byte_of_symbol()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    opening, continuing = {bytes([b]) for b in range(256)}, set()
    for t in vocab:
        b = bytes(of[c] for c in t)
        if b[:1] == b" " and len(b) > 1:
            opening.add(b[1:])
        else:
            continuing.add(b)
    return sorted(opening), sorted(continuing)


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(*pieces_of(path))


def token_counts(df: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row of df; an unknown word counts as one token."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(path)
        for b in batches:
            words, tokens, unknown = [], [], []
            for t in b.column(1).to_pylist():
                each = np.fromiter(map(known.__getitem__, ws := (t or "").encode("utf-8", "surrogatepass").split()), dtype=np.int64, count=len(ws))
                words.append(len(ws))
                tokens.append(int(np.abs(each).sum()))
                unknown.append(int((each < 0).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
