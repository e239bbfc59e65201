"""Alignment of two tokenizers over the same text by merge path, and how often their tokens meet.

Both tokenizers cut the bytes of a text (with a space before it) into tokens. Where a token of A and one of B end at the same byte, a group ends; tokens
whose bytes overlap are linked. Both come from merging the two lists of token ends. Merge path cuts that merge into pieces of equal work: the
binary search along each diagonal finds how many ends of A and of B lie before it, so pieces need nothing of each other, whatever lies in
them; a piece emits its overlaps and counts the groups that end in it, and the sum over the pieces before stitches groups across their edges. The pieces
of all texts of a batch run side by side, a step of each at a time.

Neither vocabulary lets a token cross a single space between two other characters. So a text whose white space is single spaces and line feeds falls into
pieces at places where both have an end; distinct pieces are encoded and merged once and remembered by a worker. Other texts are encoded and merged whole.
A vocabulary of B for which this does not hold is used on whole texts only.

`aligned` gives each document's groups and links; `pair_counts` in how many documents each pair of ids is linked, summed within tasks
first; `scored` what these counts say of each document. The counts are broadcast as long as there are at most `BROADCAST` of them (their number
is checked; the bound is 12 bytes each), beyond that links meet them in a join, which splits what is skewed.

Defined cases: a null or empty text, and one that the tokens of A or B don't give back byte by byte, has no tokens: all its numbers are 0 and its groups
are empty text. Strings of special tokens are plain text. Texts of any length are taken whole; repeated rows count one by one; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import written
from lumenframe.llm.tokens import _ODD, default_path
from lumenframe.llm.wordpiece import byte_of_symbol

#: Pieces remembered by a worker, the longest of these, and pieces and bytes of text that are looked at together.
REMEMBERED, LONGEST, PIECES, BYTES = 500_000, 64, 20_000, 2 << 20
#: Pieces encoded as one text.
AT_ONCE = 2000
#: Pairs of ids whose counts are broadcast at most.
BROADCAST = 4 << 20
#: Steps of the merge in one piece, at most.
WORK = 256


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# --- merge path -------------------------------------------------------------------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each d: how many of the first d of the merged list come from a; of equal values that of a comes first."""
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        i = (low + high) // 2
        right = a[np.minimum(i, len(a) - 1)] <= b[np.clip(d - i - 1, 0, len(b) - 1)]
        low, high = np.where(open_ & right, i + 1, low), np.where(open_ & ~right, i, high)
    return low


def merge_path(a: np.ndarray, b: np.ndarray, work: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of tokens, ascending, the last ones equal -> (i, j of each overlap in order, group of each token of a, group of each token of b)."""
    n, m = len(a), len(b)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    work = work or max(16, min(WORK, int((n + m) ** 0.5)))
    starts = np.arange(0, n + m, work)
    i = diagonals(a, b, starts)
    j = starts - i
    ends = np.minimum(starts + work, n + m)
    a_from, b_from = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
    shape = (work, len(starts))
    at_i, at_j, linked, closes = np.empty(shape, np.int64), np.empty(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, bool)
    for step in range(work):
        x, y = np.minimum(i, n - 1), np.minimum(j, m - 1)
        here = (i < n) & (j < m) & (i + j < ends)
        at_i[step], at_j[step] = x, y
        linked[step] = here & (a_from[x] < b[y]) & (b_from[y] < a[x])
        closes[step] = linked[step] & (a[x] == b[y])
        from_a = (j >= m) | ((i < n) & (a[x] <= b[y]))
        i, j = i + from_a, j + ~from_a
    # groups: those closed within the piece so far, and in all pieces before
    within = np.cumsum(closes, axis=0)
    group = (within - closes + (np.cumsum(within[-1]) - within[-1])[None, :]).T[linked.T]
    li, lj = at_i.T[linked.T], at_j.T[linked.T]
    of_a, of_b = np.empty(n, np.int64), np.empty(m, np.int64)
    of_a[li], of_b[lj] = group, group  # all overlaps of a token lie in one group
    return li, lj, of_a, of_b


# --- both tokenizers in a worker -----------------------------------------------------------------------------------------------------------


class Aligner(dict):
    """piece -> what aligning it gave: (n_a, n_b, n_groups, n_links, whether both give it back, groups as text, links as unsigned 32-bit pairs)."""

    def __init__(self, a: str, b: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        of = byte_of_symbol()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(names.values()))
        for t, i in names.items():
            self.a_bytes[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.shift = (len(pieces) - 1).bit_length()
        if (len(self.a_bytes) - 1).bit_length() + self.shift > 32:
            raise ValueError("pairs of ids of more than 32 bits")
        self.splits = not any("▁" in p[1:] and p.strip("▁") or "\n" in p for p in pieces)
        lettered = {p[k + 1] for p in pieces for k in range(len(p) - 1) if p[k].isalpha()}
        self.signs = {x: (self.a.encode(f"a{x}").ids[-1], self.b.encode(f"a{x}")[-1]) for x in ".," if x not in lettered}
        self.written = [f"{i}{s}" for i in range(max(len(self.a_bytes), len(pieces))) for s in ",|;"]

    def entries(self, a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        """Texts side by side, given by their ids and where each ends, in one merge."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        li, lj, group_a, group_b = merge_path(ends_a, ends_b)
        # tokens in the order of groups, a's before b's, each with the sign after it
        key = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(key, kind="stable")
        key, side = key[order], order >= len(a)
        last = np.concatenate([key[1:] != key[:-1], [True]])
        codes = (3 * np.concatenate([a, b])[order] + np.where(last, np.where(side, 2, 1), 0)).tolist()
        cut_a, cut_b = np.searchsorted(ends_a, bounds, side="right"), np.searchsorted(ends_b, bounds, side="right")
        pairs = (a[li] << self.shift | b[lj]).astype("<u4").tobytes()
        cuts = np.stack([cut_a, cut_b, group_a[cut_a - 1] + 1, np.searchsorted(li, cut_a)])  # tokens, groups and links up to the end of each text
        sizes = np.diff(cuts, prepend=0).tolist()
        out, c, k = [], 0, 0
        for n_a, n_b, n_groups, n_links in zip(*sizes, strict=True):
            out.append((n_a, n_b, n_groups, n_links, True, "".join(map(self.written.__getitem__, codes[c : c + n_a + n_b]))[:-1], pairs[4 * k : 4 * (k + n_links)]))
            c, k = c + n_a + n_b, k + n_links
        return out

    def _each(self, ids_a: list[list[int]], ids_b: list[list[int]], texts: list[bytes]) -> list[tuple]:
        """Texts given by their ids; one that is not given back by both is without tokens."""
        ok = [b"".join(map(self.a_bytes.__getitem__, x)) == t == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, t in zip(ids_a, ids_b, texts, strict=True)]
        out: list[tuple] = [(0, 0, 0, 0, False, "", b"")] * len(texts)
        good = [k for k, v in enumerate(ok) if v]
        if good:
            flat = [np.array([i for k in good for i in ids[k]], dtype=np.int64) for ids in (ids_a, ids_b)]
            for k, entry in zip(good, self.entries(*flat, np.cumsum([len(texts[k]) for k in good])), strict=True):
                out[k] = entry
        return out

    def whole(self, texts: list[str]) -> list[tuple]:
        """Texts as they are, each with a space before it."""
        spaced = [" " + t for t in texts]
        return self._each([e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)], self.b.encode(texts, num_threads=1), [t.encode() for t in spaced])

    def pieces(self, pieces: list[str]) -> list[tuple]:
        """Pieces that follow a space, or begin with a line feed: encoded side by side, as one text."""
        spaced = [" a", *(p if p[:1] == "\n" else " " + p for p in pieces)]  # so the space that B adds is known
        text, raw = "".join(spaced), [t.encode() for t in spaced]
        a, b = (np.asarray(ids, dtype=np.int64) for ids in (self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])))
        whole, bounds = b"".join(raw), np.cumsum([len(t) for t in raw])
        if all(b"".join(map(names.__getitem__, ids.tolist())) == whole and np.isin(bounds, np.cumsum(sizes[ids])).all() for ids, names, sizes in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size))):
            return self.entries(a, b, bounds)[1:]
        inner = [p[:1] == "\n" for p in pieces]
        ids_a = [e.ids for e in self.a.encode_batch(spaced[1:], add_special_tokens=False)]
        return self._each(ids_a, [x[1:] if n else x for x, n in zip(self.b.encode(pieces, num_threads=1), inner, strict=True)], raw[1:])

    def learned(self, pieces: list[str]) -> list[tuple]:
        """Pieces not remembered; they are from now on, as long as there is room. A sign after a letter is a token and a group of its own in both."""
        base = [p[:-1] if p[-1:] in self.signs and p[-2:-1].isalpha() else p for p in pieces]
        fresh = [x for x in dict.fromkeys(base) if x not in self]
        new = dict(zip(fresh, (e for at in range(0, len(fresh), AT_ONCE) for e in self.pieces(fresh[at : at + AT_ONCE])), strict=True))
        out = []
        for p, x in zip(pieces, base, strict=True):
            entry = new[x] if x in new else self[x]
            if x is not p and entry[4]:
                i, j = self.signs[p[-1]]
                n_a, n_b, n_groups, n_links, _, groups, pairs = entry
                entry = (n_a + 1, n_b + 1, n_groups + 1, n_links + 1, True, f"{groups};{i}|{j}", pairs + (i << self.shift | j).to_bytes(4, "little"))
            out.append(entry)
        for some in (new.items(), zip(pieces, out, strict=True)):
            if len(self) < REMEMBERED:
                self.update((p, e) for p, e in some if len(p) <= LONGEST)
        return out

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]]:
        """(n_a, n_b, n_groups, n_links as rows; groups; distinct linked pairs; how often each) of the texts, BYTES at a time."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right")))
            yield self._some(texts.slice(at, stop - at))
            at = stop

    def _some(self, texts: pa.Array):
        n = len(texts)
        filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.splits else np.ones(n, bool)
        lists, found, code = [], [], np.zeros(0, np.int64)
        entry_of = np.full(n, -1)
        plain = np.flatnonzero(filled & ~odd)
        whole = np.flatnonzero(filled & odd)
        if len(plain):
            lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
            dictionary = lists.flatten().dictionary_encode()
            distinct, code = dictionary.dictionary.to_pylist(), dictionary.indices.to_numpy()
            found = list(map(self.get, distinct))
            missing = [i for i, v in enumerate(found) if v is None]
            for at in range(0, len(missing), PIECES):
                some = missing[at : at + PIECES]
                for i, entry in zip(some, self.learned([distinct[i] for i in some]), strict=True):
                    found[i] = entry
        entry_of[whole] = len(found) + np.arange(len(whole))
        found += self.whole(texts.take(pa.array(whole)).to_pylist()) if len(whole) else []
        # each text as a run of entries
        bounds = np.diff(lists.offsets.to_numpy()) if len(plain) else np.zeros(0, np.int64)
        runs = np.zeros(n, np.int64)
        runs[plain], runs[whole] = bounds, 1
        at = np.cumsum(runs) - runs
        entries = np.empty(int(runs.sum()), np.int64)
        is_plain = np.repeat(np.isin(np.arange(n), plain), runs)
        entries[is_plain], entries[~is_plain] = code, entry_of[whole]
        text_of = np.repeat(np.arange(n), runs)
        numbers = np.array([e[:5] for e in found], dtype=np.int64).reshape(len(found), 5)
        bad = np.bincount(text_of, weights=1 - numbers[entries, 4], minlength=n) > 0 if len(entries) else np.zeros(n, bool)
        keep = ~bad[text_of]
        entries, text_of = entries[keep], text_of[keep]
        sums = np.zeros((n, 4), np.int64)
        for c in range(4):
            sums[:, c] = np.bincount(text_of, weights=numbers[entries, c], minlength=n).astype(np.int64)
        flags = ~bad & filled
        listed = entries.tolist()
        fragments = [e[5] for e in found]
        cuts = np.searchsorted(text_of, np.arange(n + 1)).tolist()
        groups = [";".join(map(fragments.__getitem__, listed[cuts[t] : cuts[t + 1]])) if flags[t] else "" for t in range(n)]
        size = np.fromiter((len(e[6]) // 4 for e in found), dtype=np.int64, count=len(found))
        flat = np.frombuffer(b"".join(e[6] for e in found), dtype="<u4")
        start = np.cumsum(size) - size
        k = size[entries]
        stop = np.cumsum(k)
        links = flat[np.repeat(start[entries] - stop + k, k) + np.arange(int(stop[-1]) if len(stop) else 0)].astype(np.int64)
        keyed, times = np.unique(np.repeat(text_of, k) << 32 | links, return_counts=True)
        bound = np.searchsorted(keyed, np.arange(n + 1, dtype=np.int64) << 32)
        pairs = (keyed & 0xFFFFFFFF).astype("<u4")
        return sums, groups, [pairs[x:y] for x, y in zip(bound[:-1], bound[1:], strict=True)], [times[x:y].astype("<u4") for x, y in zip(bound[:-1], bound[1:], strict=True)]


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


# --- over documents --------------------------------------------------------------------------------------------------------------------------


def aligned(df: DataFrame, a: str | None = None, b: str | None = None, text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row; a, b: vocabulary files (byte-level BPE, piece model).

    groups: `a1,a2|b1;a3|b2,b3`, the ids of A and of B in each group; with `digest` its SHA-256 instead ('' where there are none). pairs: the distinct linked
    pairs as unsigned 32-bit little-endian numbers, A's id above B's `id_bits`; times: how often each is linked, likewise.
    """
    a, b = a or default_path(), b or piece_path()
    name = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a, b)
        for batch in batches:
            at = 0
            for sums, groups, pairs, times in known.batch(batch.column(1)):
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                n = len(groups)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), *[pa.array(sums[:, c]) for c in range(4)], pa.array(groups, pa.string()), pa.array([p.tobytes() for p in pairs], pa.binary()), pa.array([t.tobytes() for t in times], pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", name, "pairs", "times"],
                )
                at += n

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, {name} string, pairs binary, times binary")


def id_bits(b: str | None = None) -> int:
    """The bits of B's id in a pair."""
    import sentencepiece

    return (sentencepiece.SentencePieceProcessor(model_file=b or piece_path()).get_piece_size() - 1).bit_length()


def pair_counts(documents: DataFrame, bits: int) -> DataFrame:
    """What aligned() gave -> (pair, a_id, b_id, n_docs, is_best): in how many documents each pair is linked, and whether that is the most of its A id."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            new, times = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            all_, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            return all_, np.bincount(at, weights=np.concatenate([counts, times]), minlength=len(all_)).astype(np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n_docs"])

        for b in batches:
            for p in b.column(0).to_pylist():
                waiting.append(np.frombuffer(p, dtype="<u4").astype(np.int64))
                n += len(p) // 4
                if n > 4 << 20:
                    keys, counts = merged()
                    waiting, n = [], 0
                    if len(keys) > 8 << 20:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield out()

    counts = documents.select("pairs").mapInArrow(partial, "pair long, n_docs long").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    counts = written(counts.withColumns({"a_id": F.shiftright("pair", bits), "b_id": F.col("pair").bitwiseAND((1 << bits) - 1)}), "pair_counts")
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))  # a row an id of A
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best"))


def scored(documents: DataFrame, counts: DataFrame, most: int = BROADCAST) -> DataFrame:
    """What aligned() gave, with n_best (links whose pair is the commonest of its A id) and count_sum (over links) by these counts, in place of pairs and times."""
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c not in ("pairs", "times")]
    if counts.count() <= most:
        table = counts.select("pair", "n_docs", "is_best").toArrow()
        pair = table.column("pair").to_numpy()
        order = np.argsort(pair)
        held = spark.sparkContext.broadcast((pair[order].astype(np.uint32), table.column("n_docs").to_numpy()[order], table.column("is_best").to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n_docs, is_best = held.value
            for b in batches:
                flat, times = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u4") for c in ("pairs", "times"))
                text = np.repeat(np.arange(b.num_rows), pc.binary_length(b.column("pairs")).to_numpy(zero_copy_only=False) // 4)
                at = np.searchsorted(known, flat)
                total = lambda v: pa.array(_summed(text, v, b.num_rows))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], total(times * is_best[at]), total(times * n_docs[at])], names=[*kept, "n_best", "count_sum"])

        schema = ", ".join(f"{c} {t}" for c, t in documents.select(*kept).dtypes)
        return documents.mapInArrow(run, f"{schema}, n_best long, count_sum long")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, times = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u4").astype(np.int64) for c in (1, 2))
            rows = np.repeat(b.column(0).to_numpy(), pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(flat), pa.array(times)], names=["__row", "pair", "times"])

    numbered = documents.withColumn("__row", F.monotonically_increasing_id())  # of a stored table: the same each time
    links = numbered.select("__row", "pairs", "times").mapInArrow(apart, "__row long, pair long, times long").join(counts, "pair")
    sums = links.groupBy("__row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}
    return numbered.drop("pairs", "times").join(sums, "__row", "left").drop("__row").withColumns(zero)


def _summed(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by ascending group, without rounding."""
    sums = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    cuts = np.searchsorted(group, np.arange(n + 1))
    return sums[cuts[1:]] - sums[cuts[:-1]]


def alignment_digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document, pairs counted over all of df."""
    documents = written(aligned(df, digest=True), "aligned")
    return scored(documents, written(pair_counts(documents, id_bits()), "pairs"))
