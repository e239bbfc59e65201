"""Entity resolution: names and titles matched exactly, without accents, by trigrams or by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.names import jaro_winkler, levenshtein_share, sorted_name
from lumenframe.functions.text import first_name, last_name, unaccent, words_only
from lumenframe.operators.settle import settled
from lumenframe.operators.trigrams import similar_pairs


def _close_pairs(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """Pairs (__a, __b) that may have an edit-distance share of `share` or more; none that has is missing.

    Such a pair differs by t = floor((1 - share) * longer) edits at most. Cut the one into t + 1 segments: t edits leave one of them as it is, moved by t
    places at most. So pairs meet where a substring of the other equals a segment, for lengths that fit.
    """

    def lengths(n: Column) -> Column:
        return F.sequence(F.ceil(n * share - 1e-9).cast("int"), F.floor(n / share + 1e-9).cast("int"))

    edits = F.floor((1 - share) * F.greatest("__n", "__m") + 1e-9).cast("int")
    start = F.floor(F.col("__i") * F.col("__m") / (F.col("__t") + 1)).cast("int")
    size = F.floor((F.col("__i") + 1) * F.col("__m") / (F.col("__t") + 1)).cast("int") - start

    def segments(df: DataFrame) -> DataFrame:
        return df.withColumn("__t", edits).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__t")))).withColumns({"__start": start, "__size": size})

    cut = segments(b.withColumn("__m", F.length("__b")).withColumn("__n", F.explode(lengths(F.col("__m")))))
    cut = cut.select("__b", "__n", "__m", "__i", F.col("__b").substr(F.col("__start") + 1, F.col("__size")).alias("__s"))
    probe = segments(a.withColumn("__n", F.length("__a")).withColumn("__m", F.explode(lengths(F.col("__n")))))
    low, high = F.greatest(F.col("__start") - F.col("__t"), F.lit(0)), F.least(F.col("__n") - F.col("__size"), F.col("__start") + F.col("__t"))
    probe = probe.where(low <= high).withColumn("__p", F.explode(F.sequence(low, high))).select("__a", "__n", "__m", "__i", F.col("__a").substr(F.col("__p") + 1, F.col("__size")).alias("__s"))
    return probe.distinct().join(cut, ["__n", "__m", "__i", "__s"]).select("__a", "__b").distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, threshold: float = 0.9) -> DataFrame:
    """Pairs of rows whose names score `threshold` or more, with similarity_score, unordered.

    Distinct sorted names are compared, not rows. A score of t needs an edit-distance share of 2t - 1 at least, as the other half is 1 at
    most; only pairs that may have it meet, and the native half is checked before the scan in Python. At 0.5 or below nothing can be ruled out and
    all distinct names meet.
    """
    share = 2 * threshold - 1
    a = left.select(sorted_name(F.col(left_name)).alias("__a")).distinct().where("__a <> ''")
    b = right.select(sorted_name(F.col(right_name)).alias("__b")).distinct().where("__b <> ''")
    pairs = _close_pairs(a, b, share) if share > 0 else a.join(b)
    near = pairs.withColumn("__lev", levenshtein_share(F.col("__a"), F.col("__b"))).where(F.col("__lev") >= share - 1e-9)
    scored = near.withColumn("similarity_score", (F.col("__lev") + jaro_winkler(F.col("__a"), F.col("__b"))) / 2).where(F.col("similarity_score") >= threshold)
    l, r = left.withColumn("__a", sorted_name(F.col(left_name))), right.withColumn("__b", sorted_name(F.col(right_name)))
    return l.join(scored.select("__a", "__b", "similarity_score"), "__a").join(r, "__b").drop("__a", "__b")


def duplicates(df: DataFrame, name: str, key: str, threshold: float = 0.9) -> DataFrame:
    """Rows that a row of smaller key resembles: all but the first of each match."""
    left, right = df.select(F.col(key).alias("__keep"), F.col(name).alias("__name")), df
    return fuzzy_join(left, right, "__name", name, threshold).where(F.col("__keep") < F.col(key)).groupBy(*df.columns).agg(F.min("__keep").alias("duplicate_of"))


def exactly_one(matches: DataFrame, key: str) -> DataFrame:
    """Matches of those keys that have just one."""
    return matches.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where("__n = 1").drop("__n")


def best_film(rows: DataFrame, films: DataFrame, directors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """rows (row_id, title, director) with the film_id of the most similar title among the director's films, null if none exceeds the threshold.

    directors: (film_id, first_name, last_name). The searched name is split at white space; its first and last token, without case and accents, must equal
    the director's first and last name. They are the equi-join key, so titles are compared only within a director, each distinct one once. A director without a last name is
    met by a name of one token only where theirs is empty, not null.
    """
    key = lambda c: unaccent(F.lower(c))
    by = ["__first", "__last"]
    title = lambda c: words_only(unaccent(F.col(c))).alias("text")
    known = directors.select("film_id", key(F.col("first_name")).alias("__first"), key(F.col("last_name")).alias("__last")).join(films.select(F.col("id").alias("film_id"), title("original_name")), "film_id")
    known = settled(known.where("text is not null").groupBy(*by, "text").agg(F.min("film_id").alias("film_id")))  # of one title the least id wins
    wanted = settled(rows.select("row_id", key(first_name(F.col("director"))).alias("__first"), key(last_name(F.col("director"))).alias("__last"), title("title")))
    least = lambda: F.min(F.struct((-F.col("score")).alias("s"), "film_id")).alias("m")
    scored = similar_pairs(wanted, known, by, threshold).join(known.withColumnRenamed("text", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("text")).agg(least())
    met = wanted.join(scored.select(*by, "text", "m.film_id", (-F.col("m.s")).alias("score")), [*by, "text"])
    best = met.groupBy("row_id").agg(least()).select("row_id", "m.film_id", (-F.col("m.s")).alias("score"))
    return rows.join(best, "row_id", "left")


def match_or_insert(existing: DataFrame, incoming: DataFrame, name: str, threshold: float = 0.9, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """(existing with the names that resemble none of its own, (name, id) of every incoming name). Of several matches the best counts, then the least id."""
    from lumenframe.operators.upsert import find_or_create

    wanted = incoming.select(F.col(name).alias("__in")).where("__in is not null").distinct()
    best = fuzzy_join(wanted, existing.select(id_column, F.col(name).alias("__old")), "__in", "__old", threshold).groupBy("__in").agg(F.min_by(id_column, F.struct(-F.col("similarity_score"), F.col(id_column))).alias(id_column))
    fresh = wanted.join(best, "__in", "left_anti").select(F.col("__in").alias(name))
    grown = find_or_create(existing, fresh, [name], id_column)
    made = grown.join(fresh, name).groupBy(name).agg(F.min(id_column).alias(id_column))
    return grown, best.select(F.col("__in").alias(name), id_column).unionByName(made)
