"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on the windows of ordinary documents, by the library's trainer, and one on toxic documents, by a trainer of the
same kind that sets them against ordinary ones. The library's trainer takes the segments that most of its samples hold; of toxic documents these are mostly
ordinary text, and a dictionary of them tells little (see the README for figures). Here a segment (a run of bytes of a word with its blanks, of one of LENGTHS
lengths) counts by how much more toxic documents hold it than as many ordinary ones would: it is taken if chance explains that at odds of less
than EVIDENCE (a Poisson tail), whatever its language, and the best segments are put last, where the shortest offsets reach them. The toxic
dictionary stands behind the ordinary one, so both know all ordinary text and only toxic segments make a difference.

Each window of a text is compressed with the ordinary and with the toxic dictionary; it counts by the bytes that the toxic one saves, if these are SCREEN or
more. A document's saving is the mean over its windows. A monotone map from it to the share of toxic documents gives the score: fitted by
cross-validation, on what training documents save with dictionaries trained without them, for a share of toxic documents of PRIOR. EVIDENCE, SCREEN and
PRIOR were chosen by cross-validation over training rows (of sf0.1) alone.

Training reads labelled rows with crc32(doc_id as text) mod 3 other than 1, at most MOST of each label, those of smallest hash, whole. Everything
else covers all rows and whole texts: the windows of a text cover it all.

Defined cases: a null or empty text has no windows, saves nothing and gets the score of such documents; texts of any length are scored whole; with
no toxic or no ordinary training rows every score is 0; repeated rows are scored alike; labels without a document and null labels are
ignored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training documents of each label at most.
MOST = 1500
#: Bytes of a window. Below 64 zstandard stores unmatched bytes as they are, so that what a match saves shows in whole bytes.
WINDOW, OVERLAP = 60, 24
#: Bytes of the ordinary and, at most, of the toxic dictionary, and of the segments that the library's trainer takes.
ORDINARY, TOXIC, SEGMENT = 65_536, 2048, 64
#: Lengths of segments, toxic documents that must hold one, how many times as often as by chance (with half an ordinary document more, so that
#: what is only too rare to be met in the ordinary ones isn't taken), and the odds of chance.
LENGTHS, LEAST, TIMES, EVIDENCE = (5, 6, 7, 8, 9, 10, 12), 4, 50, 1e-9
#: The bytes a window must save to count.
SCREEN = 1
#: Stands before each segment.
_PARTED = b"\n"
#: The share of toxic documents that scores are calibrated for, whatever it is among those trained on.
PRIOR = 0.2
_REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"  # the last of a dictionary's header: its three repeat offsets


def _compressor(content: bytes):
    """compress() with the content of a dictionary before each window."""
    p = zstandard.ZstdCompressionParameters.from_level(3, source_size=WINDOW, dict_size=len(content), strategy=zstandard.STRATEGY_GREEDY, min_match=5, search_log=4, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


def windows(text: str | None) -> list[bytes]:
    """The text's words, lower case, in runs of at most WINDOW bytes; a longer word is cut into windows that overlap."""
    out, run, size = [], [], 0
    for w in (text or "").lower().encode("utf-8", "surrogatepass").split():
        if size + len(w) + 1 > WINDOW and run:
            out.append(b" %b " % b" ".join(run))
            run, size = [], 0
        if len(w) > WINDOW:
            out += [w[i : i + WINDOW] for i in range(0, len(w), WINDOW - OVERLAP)]
            continue
        run.append(w)
        size += len(w) + 1
    if run:
        out.append(b" %b " % b" ".join(run))
    return out


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary trained on the samples; where there is too little to train on, their end."""
    try:
        made = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    return made[made.index(_REPEATS) + len(_REPEATS) :] if _REPEATS in made else made


def segments(text: str | None, lengths: tuple[int, ...] = LENGTHS) -> set[bytes]:
    """The segments of a text's words, each word in lower case with a blank on either side."""
    out = set()
    for w in set((text or "").lower().encode("utf-8", "surrogatepass").split()):
        x = b" %b " % w
        for n in lengths:
            out.update(x[i : i + n] for i in range(len(x) - n + 1))
    return out


def _counted(ordinary: list[list[str]], toxic: list[list[str]]) -> tuple[list[Counter], list[Counter]]:
    """For each part of the ordinary and of the toxic texts, how many of its texts hold each segment that LEAST toxic texts hold; one length at a time, which bounds memory."""
    counts = [Counter() for _ in ordinary], [Counter() for _ in toxic]
    for n in LENGTHS:
        all_ = Counter(g for part in toxic for t in part for g in segments(t, (n,)))
        wanted = {g for g, k in all_.items() if k >= LEAST}
        for side, parts in zip(counts, (ordinary, toxic), strict=True):
            for count, part in zip(side, parts, strict=True):
                count.update(g for t in part for g in segments(t, (n,)) if g in wanted)
    return counts


def _contrasted(others: Counter, held: Counter, n_ordinary: int, n_toxic: int) -> bytes:
    """The toxic dictionary: segments that toxic documents hold beyond chance, the best last, none within another."""
    found: dict[bytes, float] = {}
    times = min(TIMES, n_ordinary / 2)  # where few are known, a quarter of the toxic ones is enough
    for g, n in held.items():
        chance = n_toxic * (others[g] + 0.5) / max(1, n_ordinary)
        if n >= LEAST and n > times * chance and (tail := n * math.log(chance) - chance - math.lgamma(n + 1)) < math.log(EVIDENCE):
            found[g] = tail / math.log(10) - 0.5 * len(g)
    chosen: list[bytes] = []
    size = 0
    for g in sorted(found, key=lambda g: (found[g], g)):
        if size < TOXIC and not any(g in h or h in g for h in chosen):
            chosen.append(g)
            size += len(g) + len(_PARTED)
    return b"".join(_PARTED + g for g in reversed(chosen))


class Model:
    """The dictionaries and the fitted map. Plain bytes and floats: it travels to the executors as it is."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.edges: list[float] = []
        self.scores = [0.0]

    def compressors(self) -> tuple:
        """The ordinary and the toxic function."""
        return _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)

    @staticmethod
    def saved(text: str | None, pair: tuple) -> float:
        """Bytes saved by the toxic dictionary, on average over the text's windows."""
        plain, toxic = pair
        all_, total = windows(text), 0
        for w in all_:
            d = len(plain(w)) - len(toxic(w))
            if d >= SCREEN:
                total += d
        return total / max(1, len(all_))

    def score(self, saved: float) -> float:
        return self.scores[int(np.searchsorted(self.edges, saved, side="right"))]


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators with equal x pooled first: (where steps part, halfway between their points, and their values, one more)."""
    blocks: list[list[float]] = []  # first x, last x, weighted sum, weight
    for v in np.unique(x):
        own = x == v
        blocks.append([float(v), float(v), float((y * weight)[own].sum()), float(weight[own].sum())])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, last, s, n = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + s, blocks[-1][3] + n]
    values = [(s + 0.02) / (n + 0.2) for _, _, s, n in blocks]
    return [(a[1] + b[0]) / 2 for a, b in zip(blocks, blocks[1:], strict=False)], np.maximum.accumulate(values).tolist()


def _dealt(rows: list[tuple], parts: int, salt: str) -> list[list[tuple]]:
    out: list[list[tuple]] = [[] for _ in range(parts)]
    for r in rows:
        out[zlib.crc32(f"{salt} {r[0]}".encode()) % parts].append(r)
    return out


def train(rows: list[tuple[int | None, str, int]], folds: int = 5) -> Model | None:
    """rows: (doc_id, text, toxic). The dictionaries are of all rows; the map is fitted on what each row saves with dictionaries trained without its fold."""
    have = [sum(r[2] == y for r in rows) for y in (0, 1)]
    weight = [(1 - PRIOR) / max(1, have[0]), PRIOR / max(1, have[1])]
    cut = [[[t for _, t in part] for part in _dealt([(i, t) for i, t, z in rows if z == y], folds, "fold")] for y in (0, 1)]
    counts = _counted(*cut)

    def learned(left_out: int | None) -> Model | None:
        ordinary, toxic = ([t for k, part in enumerate(cut[y]) if k != left_out for t in part] for y in (0, 1))
        if not ordinary or not toxic:
            return None
        others, held = (sum((c for k, c in enumerate(counts[y]) if k != left_out), Counter()) for y in (0, 1))
        return Model(_dictionary([w for t in ordinary for w in windows(t)], ORDINARY, SEGMENT), _contrasted(others, held, len(ordinary), len(toxic)))

    saved: list[float] = []
    label: list[float] = []
    for k in range(folds):
        without = learned(k)
        if without is None:
            return None
        pair = without.compressors()
        for y in (0, 1):
            saved += [Model.saved(t, pair) for t in cut[y][k]]
            label += [float(y)] * len(cut[y][k])
    model = learned(None)
    y = np.array(label)
    model.edges, model.scores = _isotonic(np.array(saved), y, np.where(y == 1, weight[1], weight[0]) * len(y))
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept from training: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST) -> Model | None:
    """Trains on labelled documents: of each label the `most` of smallest hash, whole."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for y in (0, 1):
        own = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * most rows
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return train(sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows))


def scored(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """(doc_id, saved, score) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if model else None
        for b in batches:
            saved = [model.saved(t, pair) if model else 0.0 for t in b.column(1).to_pylist()]
            score = [model.score(s) if model else 0.0 for s in saved]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(saved, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "saved", "score"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, saved double, score double")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, saved) for every row of documents."""
    found = scored(documents, fit(documents, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "saved")


def kept(df: DataFrame, model: Model | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of df that score below the threshold, with df's columns in order; nothing is shuffled."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if model else None
        for b in batches:
            yield b.filter(pa.array([not model or model.score(model.saved(t, pair)) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
