"""What follows the face models: filters, labels from logits, clusters and their aggregates, matching and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.fixed import AGES, ETHNICITIES, GENDERS
from lumenframe.operators.metrics import mode_first_seen
from lumenframe.operators.settle import settled

# --- filters ----------------------------------------------------------------------------------------------------------------------


def effective_area(width: Column) -> Column:
    """A wide-screen picture of that width, without bars."""
    return width / 2.4 * width


def area_ok(x1: Column, y1: Column, x2: Column, y2: Column, total: Column, least: float = 0.01, most: float = 0.5) -> Column:
    """Whether a box takes between least and most of the picture, both included."""
    return (F.abs(x1 - x2) * F.abs(y1 - y2) / total).between(least, most)


def confident(conf: Column, least: float = 0.5) -> Column:
    return conf >= least


def sharp(laplacian_variance: Column, least: float = 35.0) -> Column:
    return laplacian_variance >= least


def facing(nose_z: Column, most: float = -0.2) -> Column:
    """No face found means no."""
    return F.coalesce(nose_z <= most, F.lit(False))


def apply_filters(df: DataFrame, cheap: Sequence[Callable[[DataFrame], Column]], costly: Sequence[Callable[[DataFrame], Column]] = ()) -> DataFrame:
    """Rows that pass all predicates; the costly ones see only what the cheap ones left."""
    for group in (cheap, costly):
        if group:
            df = df.where(reduce(lambda a, b: a & b, [f(df) for f in group]))
    return df


def rescale(x: Column, model: Column, original: Column) -> Column:
    """A coordinate from model to original pixels, cut to a whole number."""
    return (x / model * original).cast("int")


def centroid(a: Column, b: Column) -> Column:
    return (a + b) / 2


# --- logits -----------------------------------------------------------------------------------------------------------------------


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0; the first of several."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def classify(logits: Column) -> Column:
    """18 logits -> (ethnicity, gender, age): 7, 2 and 9 of them in this order."""
    label = lambda names, a, n: F.get(F.array(*[F.lit(x) for x in names]), argmax(F.slice(logits, a, n)))
    return F.struct(label(ETHNICITIES, 1, 7).alias("ethnicity"), label(GENDERS, 8, 2).alias("gender"), label(AGES, 10, 9).alias("age"))


def age_bounds(age: Column) -> Column:
    """'20-29' -> (20, 29); '70+' -> (70, null)."""
    return F.struct(F.regexp_extract(age, r"^(\d+)", 1).try_cast("int").alias("age_min"), F.nullif(F.regexp_extract(age, r"-(\d+)$", 1), F.lit("")).try_cast("int").alias("age_max"))


# --- clusters ---------------------------------------------------------------------------------------------------------------------


def numbered_faces(df: DataFrame, group: str, row_id: str, embedding: str) -> DataFrame:
    """(node, group, row_id, vector): faces with a number of their own over all films, in order of film and id."""
    from lumenframe.operators.upsert import with_ids

    rows = df.select(group, row_id, F.transform(embedding, lambda x: x.cast("double")).alias("vector"))
    return settled(with_ids(rows, rows.limit(0).select(F.lit(0).alias("node")), [group, row_id], "node", kind="long"))


def edges(faces: DataFrame, group: str, threshold: float) -> DataFrame:
    """faces (node, group, vector) -> (a, b): pairs of one film's faces whose vectors are nearer than the threshold, both ways; by bounds on distances, not by comparing all."""
    from lumenframe.operators.pivots import within

    # one more coordinate sets films apart, by more than the threshold
    films = faces.groupBy(F.col(group).alias("__of")).agg(F.min("node").alias("__film"))
    apart = faces.join(films, F.col(group).eqNullSafe(F.col("__of"))).select("node", F.concat("vector", F.array((F.col("__film") * (threshold + 1)).cast("double"))).alias("vector"))
    return within(apart.select(F.col("node").alias("point_id"), F.lit(0).alias("label"), "vector"), threshold, distance=False).select(F.col("query_id").alias("a"), F.col("point_id").alias("b"))


def _twins(links: DataFrame) -> DataFrame:
    """(node, twin): each node that has links with the least of its twins, which are linked to one another and to the same others: copies, mostly. Sets of neighbours are told apart by their number and 128 bits."""
    mark = lambda k, c: F.xxhash64(F.lit(k), F.col(c).cast("long"))
    sets = links.groupBy("a").agg(F.count("*").alias("n"), *[F.bit_xor(mark(k, "b")).alias(f"h{k}") for k in (1, 2)])
    closed = settled(sets.select(F.col("a").alias("node"), "n", *[F.col(f"h{k}").bitwiseXOR(mark(k, "a")).alias(f"h{k}") for k in (1, 2)]))
    key = ["n", "h1", "h2"]
    return settled(closed.join(closed.groupBy(*key).agg(F.min("node").alias("twin")), key).select("node", "twin"))


def whispers(nodes: DataFrame, links: DataFrame, seed: int = 0, rounds: int = 100) -> tuple[DataFrame, int, bool]:
    """nodes (node), links (a, b, both ways, each once) -> ((node, label), rounds taken, whether labels had settled).

    Chinese whispers in rounds: each node begins with its own label. In a round those whose coin, a hash of seed, round and node, shows 1 take the commonest
    label among their neighbours as it was before the round, the least of several; one whose own label is as common as any keeps it. Coins keep two
    neighbours from swapping labels for ever. It stops when no node of either coin would change, or after `rounds`. What a round does depends on
    nothing but its number, so a lost executor changes nothing.

    Twins see the same labels, each less its own. So rounds pass labels, with how many twins hold them, over links between first twins only: a group of
    copies is one link to itself, not the square of its number.
    """
    links = settled(links.select("a", "b").repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a"))
    twins = _twins(links)
    firsts = twins.where("node = twin")
    met = links.join(firsts.select(F.col("node").alias("a")), "a", "left_semi").join(firsts.select(F.col("node").alias("b")), "b", "left_semi")
    met = settled(met.select("a", "b").unionByName(firsts.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    now = settled(twins.select("node", "twin", F.col("node").alias("label")))

    def labels() -> DataFrame:
        return nodes.join(now.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))

    for n in range(rounds):
        held = now.groupBy("twin", "label").agg(F.count("*").alias("held"))
        seen = settled(met.join(held.withColumnRenamed("twin", "b"), "b").groupBy("a", "label").agg(F.sum("held").alias("n")))
        top = seen.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "label"))).where("r <= 2")
        two = top.groupBy("a").agg(F.min(F.struct("r", "n", "label")).alias("first"), F.max(F.struct("r", "n", "label")).alias("second"))
        own = seen.join(held.withColumnRenamed("twin", "a"), ["a", "label"], "left_semi").join(two, "a")
        other = F.when(F.col("first.label") != F.col("label"), F.col("first")).when(F.col("second.r") == 2, F.col("second"))
        wants = settled(own.withColumn("other", other).where(F.col("other.n") > F.col("n") - 1).select(F.col("a").alias("twin"), "label", F.col("other.label").alias("to")))
        if wants.isEmpty():
            return labels(), n, True
        moves = F.xxhash64(F.lit(seed), F.lit(n), "node").bitwiseAND(1) == 1
        now = settled(now.join(wants, ["twin", "label"], "left").select("node", "twin", F.when(moves, F.coalesce("to", "label")).otherwise(F.col("label")).alias("label")))
    return labels(), rounds, False


def clusters(df: DataFrame, group: str, row_id: str, embedding: str, threshold: float = 0.92, seed: int = 0, rounds: int = 100) -> DataFrame:
    """(group, row_id, label, settled): each film's faces clustered by Chinese whispers over those nearer than the threshold; a label is a number of its cluster alone, and settled says
    whether labels had come to rest. Films of any size: neighbours are found by bounds, labels pass in joins."""
    faces = numbered_faces(df, group, row_id, embedding)
    labels, _, rest = whispers(faces.select("node"), edges(faces, group, threshold), seed, rounds)
    named = labels.join(labels.groupBy("label").agg(F.min("node").alias("first")), "label").select("node", "first")
    return faces.join(named, "node").select(group, row_id, F.col("first").alias("label"), F.lit(rest).alias("settled"))


def aggregate_clusters(df: DataFrame, group: str, row_id: str, least: int = 20) -> DataFrame:
    """df: (group, label, row_id, age, gender, ethnicity, x1, y1, x2, y2). A row for each cluster of more than `least` faces, numbered as first met."""
    key = [group, "label"]
    sums = df.groupBy(*key).agg(
        F.count("*").alias("occurence"), F.sum(F.abs(F.col("x1") - F.col("x2")) * F.abs(F.col("y1") - F.col("y2"))).alias("area_occupied"), F.sort_array(F.collect_list(row_id)).alias("persons_id"), F.min(row_id).alias("__first")
    ).where(F.col("occurence") > least)
    for c in ("age", "gender", "ethnicity"):
        sums = sums.join(mode_first_seen(df, key, c, row_id), key, "left")
    return sums.withColumn("label", F.row_number().over(Window.partitionBy(group).orderBy("__first")) - 1).drop("__first")


def members(aggregated: DataFrame, group: str, row_id: str) -> DataFrame:
    """(group, row_id, label): which cluster each face is in."""
    return aggregated.select(group, F.explode("persons_id").alias(row_id), "label")


# --- matching and evaluation ------------------------------------------------------------------------------------------------------


def nearest_annotation(detections: DataFrame, annotations: DataFrame, most: float = 3.0) -> DataFrame:
    """Each detection (frame_id, det_id, x1..y2) with its frame's nearest annotation (frame_id, idx, cx, cy) by L1 distance, if nearer than most."""
    cx, cy = centroid(F.col("x1"), F.col("x2")), centroid(F.col("y1"), F.col("y2"))
    d = detections.join(annotations, "frame_id").withColumn("distance", F.abs(cx - F.col("cx")) + F.abs(cy - F.col("cy")))
    best = d.groupBy("frame_id", "det_id").agg(F.min_by("idx", F.struct("distance", "idx")).alias("idx"), F.min("distance").alias("distance"))
    return best.where(F.col("distance") < most)


def error_score(pairs: Sequence[tuple[Column, Column]], true_confidence: Sequence[Column] | None = None) -> Column:
    """Mean over attributes of 0 where label and prediction agree, else 1, or 1 less the confidence in the true label."""
    one = [F.when(a == b, F.lit(0.0)).otherwise(1 - true_confidence[i] if true_confidence else F.lit(1.0)) for i, (a, b) in enumerate(pairs)]
    return reduce(lambda x, y: x + y, one) / len(one)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


# --- pixels -----------------------------------------------------------------------------------------------------------------------


def crop(pixels: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The part of an image (array of rows) inside a box; the right and lower edges are outside."""
    return F.transform(F.slice(pixels, y1 + 1, F.greatest(y2 - y1, F.lit(0))), lambda row: F.slice(row, x1 + 1, F.greatest(x2 - x1, F.lit(0))))


def laplacian_variance(pixels: Column) -> Column:
    """Sharpness of a grey image (array of rows): the variance of its Laplacian, with edges mirrored; null for no image."""

    def run(images: pd.Series) -> pd.Series:
        def one(rows) -> float | None:
            if rows is None or not len(rows) or not len(rows[0]):
                return None
            x = np.pad(np.stack([np.asarray(r, dtype=np.float64) for r in rows]), 1, mode="reflect" if min(len(rows), len(rows[0])) > 1 else "edge")
            return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())

        return pd.Series([one(i) for i in images], dtype="float64")

    return F.pandas_udf(run, "double")(pixels)


def colour(gender: Column) -> Column:
    """Red, green and blue of a box around a face."""
    rgb = lambda *c: F.array(*[F.lit(x) for x in c])
    return F.when(F.lower(gender) == "male", rgb(0, 0, 255)).when(F.lower(gender) == "female", rgb(255, 0, 0)).otherwise(rgb(128, 128, 128))
