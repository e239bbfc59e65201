"""Queries of the served documents over the driver's tables, each beside the SQL that gives the same rows (see catalogue): an order is a film, a supplier a person or
company, a line a credit, a region a festival, a nation an award of its region's festival and a country."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.plans import read_models as Q
from lumenframe.plans.catalogue import _CREDITS, _LINE_GENDER, _film_tables, _share, _t, gender, query


def _served(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All fifteen tables."""
    t = _film_tables(spark, d)
    o, n, line = _t(spark, d, "orders"), _t(spark, d, "nation"), _t(spark, d, "lineitem")
    k = F.col("o_orderkey")
    t["films"] = o.select(k.alias("id"), F.col("o_orderpriority").alias("original_name"), F.col("o_custkey").alias("budget"), (F.col("o_custkey") % 200).cast("int").alias("duration_minutes"), F.to_date("o_orderdate").alias("release_date"), F.when(k % 2 == 0, k.cast("string")).alias("visa_number"))
    t["genres"] = n.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    t["films_genres"] = o.select(k.alias("film_id"), F.explode(F.array_distinct(F.array(k % 25, (k * 7) % 25))).alias("genre_id"))
    t["countries"] = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    t["film_country_budget_allocations"] = o.select(k.alias("film_id"), F.explode(F.array(F.struct((k % 25).alias("c"), F.lit(60.0).alias("b")), F.struct(((k + 1) % 25).alias("c"), F.when(k % 3 > 0, 80.0).alias("b")))).alias("e")).select("film_id", F.col("e.c").alias("country_id"), F.col("e.b").alias("budget_allocation"))
    for parent, child, key, text in (("trailers", "trailer_characters", "trailer_id", "url"), ("posters", "poster_characters", "poster_id", "image_base64")):
        t[parent] = o.where(k % 5 > 0).select((k * 2).alias("id"), k.alias("film_id"), F.concat(F.lit("a"), k.cast("string")).alias(text)).unionByName(o.where(k % 5 > 1).select((k * 2 + 1).alias("id"), k.alias("film_id"), F.lit("second").alias(text)))
        t[child] = line.select(F.col("l_linenumber").alias("id"), (F.col("l_orderkey") * 2).alias(key), gender(F.col("l_suppkey")).alias("gender"), F.when(F.col("l_linestatus") == "F", "Black").otherwise("White").alias("ethnicity"), F.col("l_quantity").alias("time_on_screen"), F.col("l_discount").alias("poster_percentage"))
    t["festivals"] = _t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("d").alias("description"), F.lit("").alias("image_base64"), F.lit(0).alias("country_id"))
    t["festival_awards"] = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("mubi_label"), F.when(F.col("n_nationkey") % 2 == 0, "Autre").otherwise(F.concat(F.lit("Prix "), "n_name")).alias("french_label"), F.lit("").alias("english_label"), F.col("n_regionkey").alias("festival_id"))
    t["award_nominations"] = o.select(k.alias("id"), k.alias("film_id"), (F.col("o_custkey") % 25).alias("award_id"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderstatus") == "F").alias("is_winner"))
    return t


_SHARES = f"SELECT l_orderkey AS k, {_share('g = ' + chr(39) + 'female' + chr(39), 'l_suppkey % 3 <> 2 AND l_linenumber IN (1, 3)')} AS key_roles, {_share('g = ' + chr(39) + 'female' + chr(39), 'l_suppkey % 3 <> 2 AND l_linenumber = 2')} AS casting FROM (SELECT *, {_LINE_GENDER} AS g FROM lineitem) GROUP BY 1"
_LABEL = "CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Prix ' || n_name END"


@query(
    f"""WITH s AS ({_SHARES}), c AS (SELECT film_id AS k, coalesce(string_agg(name, '; ' ORDER BY i, company, name) FILTER (WHERE i = 2), '') AS cast_names, coalesce(string_agg(name, '; ' ORDER BY i, company, name) FILTER (WHERE i = 4 AND company), '') AS production FROM ({_CREDITS}) GROUP BY 1),
    p AS (SELECT l_orderkey AS k, sum(CASE WHEN l_suppkey % 3 = 0 THEN l_quantity ELSE 0 END) AS female_time, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS non_white_time FROM lineitem GROUP BY 1),
    g AS (SELECT k, string_agg(x, ', ' ORDER BY x) AS genres FROM (SELECT DISTINCT o_orderkey AS k, upper(n_name[1]) || lower(n_name[2:]) AS x FROM orders JOIN nation ON n_nationkey IN (o_orderkey % 25, (o_orderkey * 7) % 25)) GROUP BY 1),
    a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN y.n_name || ', ' || x.n_name ELSE x.n_name END AS countries FROM orders JOIN nation x ON x.n_nationkey = o_orderkey % 25 JOIN nation y ON y.n_nationkey = (o_orderkey + 1) % 25)
    SELECT o_orderkey AS film_id, ((o_custkey % 200) // 60) || 'h' || lpad(((o_custkey % 200) % 60)::VARCHAR, 2, '0') AS duration, genres, countries, strftime(o_orderdate, '%Y-%m-%d') || '|' || {_LABEL} || '|' || r_name || '|' || (CASE WHEN o_orderstatus = 'F' THEN 'won' ELSE 'nominated' END) AS awards, key_roles, casting, coalesce(cast_names, '') AS cast_names, coalesce(production, '') AS production,
    CASE WHEN o_orderkey % 5 > 0 THEN 'a' || o_orderkey END AS trailer_url, CASE WHEN o_orderkey % 5 > 0 THEN 'a' || o_orderkey END AS poster, round(CASE WHEN o_orderkey % 5 > 0 THEN female_time END, 4) AS female_time, round(CASE WHEN o_orderkey % 5 > 0 THEN non_white_time END, 4) AS non_white_time
    FROM orders LEFT JOIN g ON g.k = o_orderkey LEFT JOIN a ON a.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey LEFT JOIN p ON p.k = o_orderkey JOIN nation ON n_nationkey = o_custkey % 25 JOIN region ON r_regionkey = n_regionkey"""
)
def film_details(spark: SparkSession, d: str) -> DataFrame:
    """Every film's page, as it is served: attributes, genres, countries by budget, awards, shares, credits, first trailer and poster, times; lists as text."""
    r = Q.film_details(_served(spark, d))
    names = lambda c: F.array_join(F.transform(c, lambda e: e["name"]), "; ")
    awards = F.array_join(F.transform("awards", lambda a: F.concat_ws("|", a["date"].cast("string"), a["award_name"], a["festival_name"], F.when(a["is_winner"], "won").otherwise("nominated"))), ", ")
    return r.select(
        "film_id", "duration", F.array_join("genres", ", ").alias("genres"), F.array_join("countries_sorted_by_budget", ", ").alias("countries"), awards.alias("awards"), F.col("female_representation_in_key_roles").alias("key_roles"), F.col("female_representation_in_casting").alias("casting"),
        names(F.col("credits.casting")).alias("cast_names"), names(F.col("credits.distribution.production")).alias("production"), "trailer_url", "poster", F.round("female_screen_time", 4).alias("female_time"), F.round("non_white_screen_time", 4).alias("non_white_time"),
    )


@query(
    f"""WITH s AS ({_SHARES}), newest AS (SELECT max(year(o_orderdate)) AS y FROM orders JOIN nation ON n_nationkey = o_custkey % 25 WHERE n_regionkey = 1),
    award AS (SELECT n_nationkey AS id, {_LABEL} AS name FROM nation WHERE n_regionkey = 1 AND n_nationkey IN (SELECT o_custkey % 25 FROM orders, newest WHERE year(o_orderdate) = y) ORDER BY CASE WHEN n_nationkey % 2 = 0 THEN 'Autre' ELSE 'Prix ' || n_name END, n_nationkey LIMIT 1),
    dirs AS (SELECT film_id, string_agg(name, '; ' ORDER BY i, name) AS directors FROM ({_CREDITS}) WHERE i = 1 AND NOT company GROUP BY 1),
    m AS (SELECT {_share("g = 'female'", "g <> 'unknown'")} AS nominated, {_share("g = 'female'", "g <> 'unknown' AND o_orderstatus = 'F'")} AS awarded FROM (SELECT *, {_LINE_GENDER} AS g FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = o_custkey % 25, newest WHERE n_regionkey = 1 AND year(o_orderdate) = y AND l_linenumber = 1)
    SELECT o_orderkey AS film_id, y::INT AS year, award.name AS award_name, r_name AS festival_name, o_orderstatus = 'F' AS is_winner, CASE WHEN o_orderkey % 5 > 0 THEN 'a' || o_orderkey END AS poster, directors, key_roles, nominated AS female_nominated_percentage, awarded AS female_awarded_percentage, (SELECT count(DISTINCT year(o_orderdate)) FROM orders JOIN nation ON n_nationkey = o_custkey % 25 WHERE n_regionkey = 1)::INT AS years
    FROM orders JOIN award ON id = o_custkey % 25 JOIN newest ON year(o_orderdate) = y JOIN region ON r_regionkey = 1 JOIN m ON true LEFT JOIN dirs ON film_id = o_orderkey LEFT JOIN s ON s.k = o_orderkey"""
)
def festival_details(spark: SparkSession, d: str) -> DataFrame:
    """A festival's page as it is served when neither year nor award is asked for: the newest year and the first award in it, with each nominated film and the year's shares."""
    page = Q.festival_details(_served(spark, d), 1)
    return page.select("film_id", "year", "award_name", "festival_name", "is_winner", "poster", F.array_join("directors", "; ").alias("directors"), F.col("female_representation_in_key_roles").alias("key_roles"), "female_nominated_percentage", "female_awarded_percentage", F.size("available_years").alias("years"))
