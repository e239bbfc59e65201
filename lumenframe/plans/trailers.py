"""People of trailers from face detections: filters, labels, clusters, one row per person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import vision as V


def people(detections: DataFrame, videos: DataFrame, confidence: float = 0.6, sharpness: float = 200.0, threshold: float = 0.92, least: int = 20) -> DataFrame:
    """detections: (film, face_id, frame_id, x1, y1, x2, y2, conf, sharpness, nose_z, logits, embedding); videos: (film, width, seconds_per_frame).

    A row per person: gender, age_min, age_max, ethnicity, occurence, time_on_screen in seconds, average_size_on_screen as a share of the picture.
    """
    seen = detections.join(videos, "film").withColumn("total", V.effective_area(F.col("width")))
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    kept = V.apply_filters(seen, [lambda d: V.area_ok(*box, F.col("total")), lambda d: V.confident(F.col("conf"), confidence)], [lambda d: V.sharp(F.col("sharpness"), sharpness), lambda d: V.facing(F.col("nose_z"))])
    labelled = kept.withColumn("c", V.classify(F.col("logits"))).select("film", "face_id", "x1", "y1", "x2", "y2", "total", "seconds_per_frame", "embedding", "c.*")
    faces = labelled.join(V.clusters(labelled, "film", "face_id", "embedding", threshold), ["film", "face_id"])
    found = V.aggregate_clusters(faces, "film", "face_id", least)
    per_film = videos.select("film", "seconds_per_frame", V.effective_area(F.col("width")).alias("total"))
    out = found.join(per_film, "film").withColumn("bounds", V.age_bounds(F.col("age")))
    return out.select(
        "film", "label", "gender", "bounds.age_min", "bounds.age_max", "ethnicity", "occurence", "persons_id",
        (F.col("occurence") * F.col("seconds_per_frame")).alias("time_on_screen"), (F.col("area_occupied") / F.col("occurence") / F.col("total")).alias("average_size_on_screen"),
    )
