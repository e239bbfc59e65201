"""Indicators of representation as aggregate Columns. Percentages round half to even, in the order share, times 100, round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.fixed import COUNTRIES
from lumenframe.functions.text import capitalize


def percent(part: Column, whole: Column) -> Column:
    """round(part / whole * 100) of two counts, null where whole is 0."""
    return F.bround(F.try_divide(part, whole) * 100)


def known_gender(gender: Column) -> Column:
    return gender.isin("female", "male")


def female_share(gender: Column, among: Column | None = None) -> Column:
    """Share of women among the known-gender rows of a group that satisfy `among`; rows are not deduplicated."""
    counted = known_gender(gender) if among is None else known_gender(gender) & among
    return percent(F.count_if(counted & (gender == "female")), F.count_if(counted))


def female_time(gender: Column, time: Column) -> Column:
    """Screen time of women; 0 if there are characters but no women, null if the group has no characters. A null time counts as none."""
    return _sum_where(F.lower(gender) == "female", time)


def non_white_time(ethnicity: Column, time: Column) -> Column:
    return _sum_where(non_white(ethnicity), time)


def non_white(ethnicity: Column) -> Column:
    e = F.lower(ethnicity)
    return e.isNotNull() & (e != "") & (e != "white")


def _sum_where(wanted: Column, time: Column) -> Column:
    return F.coalesce(F.sum(F.when(wanted, time)), F.lit(0.0))


def female_poster_share(gender: Column, share: Column) -> Column:
    """Mean share of women that have one, times 100; 0 if there are none."""
    return _mean_where(F.lower(gender) == "female", share)


def non_white_poster_share(ethnicity: Column, share: Column) -> Column:
    return _mean_where(non_white(ethnicity), share)


def _mean_where(wanted: Column, share: Column) -> Column:
    picked = F.when(wanted, share)
    return F.coalesce(F.try_divide(F.sum(picked) * 100, F.count(picked)), F.lit(0.0))


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def mode_first_seen(df: DataFrame, key: list[str], column: str, position: str) -> DataFrame:
    """(key, column): the commonest value of each key; of several the one seen first."""
    counted = df.groupBy(*key, column).agg(F.count("*").alias("__n"), F.min(position).alias("__at"))
    return counted.groupBy(*key).agg(F.min_by(column, F.struct(-F.col("__n"), F.col("__at"))).alias(column))


def allocation_rows(df: DataFrame, key: str, cell: str) -> DataFrame:
    """A row (key, country, rate) per country of each cell of shares, by the rules of `parse.allocations`; cells without shares have no row.

    Spellings are met by a join with their list, so that no row goes through it; `key` must tell the rows of df apart (of two rows with one key the shares run together).
    Rows go to their key once and both groupings use that. Null keys keep to themselves as one key.
    """
    listed = df.sparkSession.createDataFrame(list(COUNTRIES.items()), "__spelling string, __country string")
    parts = df.select(key, F.posexplode(F.split(F.trim(cell), r"\s*/\s*")).alias("__at", "__part")).where(F.contains("__part", F.lit("-")))
    rate = F.substring_index("__part", "-", -1)
    split = parts.select(key, "__at", F.trim(F.substring("__part", F.lit(1), F.length("__part") - F.length(rate) - 1)).alias("__code"), F.nullif(F.trim(rate), F.lit("")).try_cast("int").alias("rate"))
    known = split.where("rate is not null").join(F.broadcast(listed), F.lower("__code") == F.col("__spelling"), "left")
    named = known.select(key, F.coalesce("__country", capitalize(F.col("__code"))).alias("country"), "__at", "rate")
    return named.repartition(key).groupBy(key, "country").agg(F.max_by("rate", "__at").alias("rate"))
