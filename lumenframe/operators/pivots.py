"""Nearest vectors and vectors within a radius, exactly, with most of them never compared: a stored index of cells around pivots.

Each vector lies in the cell of its nearest pivot, at a known distance from it. By the triangle inequality a query at distance e from a pivot is at least
max(e - far, near - e) from all of its cell, whose members lie between near and far from the pivot; and, as the cell's members are nearer to their own
pivot than to any other, at least half of e less the query's distance to its nearest pivot. Cells beyond what is already found are skipped. Results are those of
comparing all; pivots decide the cost only.

Cells are cut into blocks of at most `BLOCK` vectors, and the queries of a block into runs of as many, so no task holds more than both, however many
vectors lie in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.settle import settled

#: Pivots at most (they travel to every task), and vectors of a block and of a run of queries at most.
PIVOTS, BLOCK = 128, 4096
#: Queries that are compared with a block at once, and pairs whose distance is taken at once.
_ROWS, _PAIRS = 256, 8192
#: Slack for rounding in bounds.
_SLACK = 1e-9


def choose(points: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """The pivots: vectors of smallest hash of their id, as many as the root of their number, at most `most`."""
    n = min(most, max(1, int(points.count() ** 0.5)))
    rows = points.where("vector is not null").orderBy(F.xxhash64("point_id"), "point_id").limit(n).select("vector").collect()
    return np.unique(np.array([r["vector"] for r in rows], dtype=np.float64), axis=0) if rows else np.zeros((0, 0))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for k in range(0, len(x), _ROWS):  # few rows at once stay in the cache
        for j, p in enumerate(pivots):
            out[k : k + _ROWS, j] = np.sqrt(((x[k : k + _ROWS] - p) ** 2).sum(axis=1))
    return out


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in as many parts as a shuffle has: few bytes may be much to compute."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _vector(df: DataFrame):
    """The column vector and its type: floats are sent and stored as they are, all else as doubles; distances are of doubles."""
    kind = "array<float>" if dict(df.dtypes)["vector"] == "array<float>" else "array<double>"
    return F.col("vector").cast(kind).alias("vector"), kind


def build(points: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """points (point_id, label, vector; no null vectors) -> (entries: cell, block, far, point_id, label, vector, stored; cells: cell, block, n, near, far; pivots)."""
    vector, stored = _vector(points)
    points = points.select(F.col("point_id").cast("long").alias("point_id"), "label", vector).where("vector is not null")
    pivots = choose(points)
    kind = dict(points.dtypes)["label"]
    held = points.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["vector"].to_list()).astype(np.float64), held.value)
                pdf["cell"], pdf["away"] = d.argmin(axis=1), d.min(axis=1)
                yield pdf[["cell", "away", "point_id", "label", "vector"]]

    placed = settled(_dealt(points, "point_id").mapInPandas(place, f"cell int, away double, point_id long, label {kind}, vector {stored}"))
    # blocks of a cell are rings around its pivot: what lies beyond a bound is skipped block by block. Row numbers go by part, so that no cell meets in one task
    n = F.count("*")
    sizes = placed.groupBy("cell", F.floor(F.col("away") * 1024).alias("ring")).agg(n.alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("cell").orderBy("ring")) - F.col("n"))
    ringed = placed.withColumn("ring", F.floor(F.col("away") * 1024)).join(before, ["cell", "ring"])
    # a ring that alone exceeds a block (equal vectors) is dealt out by id
    block = F.floor(F.col("before") / BLOCK) * 1000003 + F.when(F.col("n") > BLOCK, 1 + F.pmod(F.xxhash64("point_id"), F.ceil(F.col("n") / BLOCK * 2))).otherwise(0)
    entries = settled(ringed.select("cell", block.alias("block"), "away", "point_id", "label", "vector"))
    cells = entries.groupBy("cell", "block").agg(n.alias("n"), F.min("away").alias("near"), F.max("away").alias("far"))
    return entries, cells, pivots


def _asked(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """queries (query_id, vector) -> with the distance to each pivot, and the least."""
    held = queries.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["vector"].to_list()).astype(np.float64), held.value)
                pdf["away"], pdf["least"], pdf["home"] = list(d), d.min(axis=1), d.argmin(axis=1)
                yield pdf

    vector, stored = _vector(queries)
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), vector).where("vector is not null")
    return settled(_dealt(rows, "query_id").mapInPandas(measure, f"query_id long, vector {stored}, away array<double>, least double, home int"))


def _bounded(asked: DataFrame, cells: DataFrame, within) -> DataFrame:
    """(query_id, cell, block) of the blocks that may hold something within the given distance of a query. Cells are few (pivots and their blocks): they are joined by cell, from each query's list of cells in reach."""
    e = F.col("e")
    listed = asked.select("query_id", "least", within.alias("within"), F.posexplode("away").alias("cell", "e")).where((e - F.col("least")) / 2 <= F.col("within") + _SLACK)
    met = listed.join(cells.select("cell", "block", "near", "far"), "cell")
    return met.where((e - F.col("far") <= F.col("within") + _SLACK) & (F.col("near") - e <= F.col("within") + _SLACK)).select("query_id", "cell", "block")


def _compared(wanted: DataFrame, asked: DataFrame, entries: DataFrame, kind: str, radius: float | None, distance: bool = True) -> DataFrame:
    """(query_id, point_id, distance, label), or without the last two: of each query and block the nearest other point, or all within the radius."""
    wanted, at = settled(wanted), ["cell", "block", "run"]
    runs = wanted.groupBy("cell", "block").agg(F.ceil(F.count("*") / BLOCK).alias("runs"))  # a block's points are sent once a run, so there are no more than needed
    sent = wanted.join(runs, ["cell", "block"]).withColumn("run", F.pmod(F.xxhash64("query_id"), F.col("runs"))).drop("runs")
    left = sent.join(asked.select("query_id", "vector"), "query_id").select(*at, "query_id", "vector")
    right = entries.join(runs.select("cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run")), ["cell", "block"]).select(*at, "point_id", "label", F.col("vector").alias("point"))

    def compare(q: pa.Table, p: pa.Table) -> pa.Table:
        ids, vectors = _column(q, "query_id"), _matrix(q, "vector")
        p = p.sort_by("point_id")
        at, points = _column(p, "point_id"), _matrix(p, "point")
        counts, places, distances = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for k in range(0, len(ids) if len(at) else 0, _ROWS):
            rows = vectors[k : k + _ROWS]
            i, j, sure = _pairs(rows, ids[k : k + _ROWS], points, at, radius)
            d = np.zeros(len(i))
            open_ = np.arange(len(i)) if distance else np.flatnonzero(~sure)
            for c in range(0, len(open_), _PAIRS):
                some = open_[c : c + _PAIRS]
                d[some] = np.sqrt(((points[j[some]] - rows[i[some]]) ** 2).sum(axis=1))
            if radius is None:
                order = np.lexsort((j, d, i))
                chosen = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            else:
                chosen = np.flatnonzero(d < radius)
            counts.append(np.bincount(i[chosen], minlength=len(rows)))
            places.append(j[chosen])
            distances.append(d[chosen])
        counts, places = np.concatenate(counts), np.concatenate(places)
        some = np.flatnonzero(counts)
        starts = pa.array(np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32))
        lists = {"point_id": pa.array(at)}
        if distance:
            lists["label"] = p["label"].combine_chunks()
        out = {"query_id": pa.array(ids[some])} | {c: pa.ListArray.from_arrays(starts, values.take(pa.array(places))) for c, values in lists.items()}
        if distance:
            out["distance"] = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(distances)))
        return pa.table(out)

    # a row per query and block, of lists: what a block finds may be many times what it holds
    grouped = _dealt(left, *at).groupBy(*at).cogroup(_dealt(right, *at).groupBy(*at))
    more = f", label array<{kind}>, distance array<double>" if distance else ""
    found = grouped.applyInArrow(compare, f"query_id long, point_id array<long>{more}")
    if not distance:
        return found.select("query_id", F.explode("point_id").alias("point_id"))
    return found.select("query_id", F.explode(F.arrays_zip("point_id", "distance", "label")).alias("f")).select("query_id", "f.point_id", "f.distance", "f.label")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """The vectors of a column, all of one length, as rows of doubles."""
    column = table[name].combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if not len(column):
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def _pairs(vectors: np.ndarray, ids: np.ndarray, points: np.ndarray, at: np.ndarray, radius: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of vectors, row of points, whether surely nearer than the radius), in order, that may be a vector and its nearest other point, or nearer than the radius: all that rounding in the product of both may hide are among them."""
    whole = points[np.isfinite(points).all(axis=1)]
    middle = whole.mean(axis=0) if len(whole) else np.zeros(points.shape[1])
    a, b = vectors - middle, points - middle
    aa, bb = (a**2).sum(axis=1)[:, None], (b**2).sum(axis=1)[None]
    off = 1e-15 * np.sqrt((middle**2).sum())  # what is lost where the middle is taken away
    d2 = (-2 * a) @ b.T
    if radius is None:
        d2 += aa + bb
        reach = np.sqrt(aa) + np.sqrt(bb)
        slack = 1e-12 * reach**2 + 4 * off * (reach + off)
        known = np.isfinite(d2) & (ids[:, None] != at[None])
        most = np.where(known, d2 + slack, np.inf).min(axis=1, keepdims=True)
        i, j = np.nonzero(known & (d2 - slack <= most))
        return i, j, np.zeros(len(i), dtype=bool)
    # a point nearer than the radius is no farther from the middle than the vector and the radius: the slack of a row need not go by the farthest point
    d2 += bb
    reach = 2 * np.sqrt(aa) + radius
    slack = 1e-12 * reach**2 + 4 * off * (reach + off)
    i, j = np.nonzero(d2 <= radius**2 + slack - aa)
    other = (ids[i] != at[j]) & np.isfinite(d2[i, j])
    i, j = i[other], j[other]
    return i, j, d2[i, j] < (radius**2 - slack - aa)[i, 0]


def _candidates(vectors: np.ndarray, ids: np.ndarray, points: np.ndarray, at: np.ndarray, radius: float | None) -> list[np.ndarray]:
    """The points of each vector's pairs."""
    i, j, _ = _pairs(vectors, ids, points, at, radius)
    return np.split(j, np.searchsorted(i, np.arange(1, len(vectors))))


def nearest(queries: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, distance, point_id, label): each query's nearest other point, ties by point_id; and (query_id, read, skipped): the vectors it met and those it didn't.

    Each query first asks the home cell's nearest block; what it finds there bounds the other blocks that it has to ask.
    """
    entries, cells, pivots = build(points)
    kind = dict(entries.dtypes)["label"]
    if not len(pivots):
        none = queries.limit(0).select(F.col("query_id").cast("long").alias("query_id"))
        return none.select("query_id", F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("point_id"), F.lit(None).cast(kind).alias("label")), none.select("query_id", F.lit(0).alias("read"), F.lit(0).alias("skipped"))
    asked = _asked(queries, pivots)
    own = asked.select("query_id", "least", F.col("home").alias("cell")).join(cells, "cell")
    gap = F.greatest(F.col("near") - F.col("least"), F.col("least") - F.col("far"), F.lit(0.0))
    first = own.groupBy("query_id").agg(F.min(F.struct(gap.alias("gap"), F.col("cell"), "block")).alias("b")).select("query_id", "b.cell", "b.block")
    found = settled(_compared(first, asked, entries, kind, None))
    bounds = found.groupBy("query_id").agg(F.min("distance").alias("bound"))
    known = asked.join(bounds, "query_id", "left")
    rest = settled(_bounded(known, cells, F.coalesce("bound", F.lit(float("inf")))).join(first, ["query_id", "cell", "block"], "left_anti"))
    all_ = found.unionByName(_compared(rest, asked, entries, kind, None))
    best = all_.groupBy("query_id").agg(F.min(F.struct("distance", "point_id", "label")).alias("b")).select("query_id", "b.*")
    total = cells.agg(F.sum("n").alias("total"))
    read = first.unionByName(rest).join(cells.select("cell", "block", "n"), ["cell", "block"]).groupBy("query_id").agg(F.sum("n").alias("read"))
    return best, read.join(F.broadcast(total)).select("query_id", "read", (F.col("total") - F.col("read")).alias("skipped"))  # one row


def within(points: DataFrame, radius: float, distance: bool = True) -> DataFrame:
    """(query_id, point_id, distance, label), or without the last two, of all pairs of different points (point_id, label, vector) nearer than the radius, both ways."""
    entries, cells, pivots = build(points)
    kind = dict(entries.dtypes)["label"]
    if not len(pivots):
        none = points.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.col("point_id").cast("long"), F.lit(0.0).alias("distance"), "label")
        return none if distance else none.select("query_id", "point_id")
    asked = _asked(points.select(F.col("point_id").alias("query_id"), "vector"), pivots)
    return _compared(_bounded(asked, cells, F.lit(radius)), asked, entries, kind, radius, distance)
