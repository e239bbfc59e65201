"""The catalogue of queries over the driver's tables, each beside the SQL that gives the same rows.

The tables hold no films, so each query says what stands for what: an order is a film, a line a credit, a supplier a person (female, male or
unknown by id modulo 3), a region a festival, an order's date a nomination's, status F a win.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.fixed import AGES, ETHNICITIES, GENDERS
from lumenframe.functions import parse as P
from lumenframe.functions import text as X
from lumenframe.operators import metrics as M
from lumenframe.operators import pivots
from lumenframe.operators import resolve as R
from lumenframe.operators import trigrams as G
from lumenframe.operators import upsert as U
from lumenframe.operators import vision as V
from lumenframe.sources import files, pages
from lumenframe.streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def gender(key: Column) -> Column:
    return F.when(key % 3 == 0, "female").when(key % 3 == 1, "male").otherwise("unknown")


_GENDER = "CASE s_suppkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END"
_LINE_GENDER = "CASE l_suppkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END"


def _share(cond: str, among: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {among}) > 0 THEN round_even(count(*) FILTER (WHERE ({among}) AND ({cond}))::DOUBLE / count(*) FILTER (WHERE {among}) * 100, 0) END"


# --- filters and lookups ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One row by key; the argument may be text."""
    return _t(spark, d, "orders").where(F.col("o_orderkey") == F.lit("7").cast("bigint")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 OR lower(c_name) = lower('CUSTOMER#00000012') OR lower(c_name) = 'customer_12'")
def or_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Equalities joined by AND, alternatives by OR, only those that are given."""
    both = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in {"c_mktsegment": "BUILDING", "c_nationkey": 3}.items()])
    either = reduce(lambda a, b: a | b, [both, *[F.lower("c_name") == x.lower() for x in ("CUSTOMER#00000012", "customer_12")]])
    return _t(spark, d, "customer").where(either).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT p_partkey, p_name, length(p_name)::INT AS name_length FROM part WHERE lower(p_name) ILIKE '%wid%' AND p_brand IS NOT NULL ORDER BY length(p_name), p_name, p_partkey LIMIT 5")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five shortest names that hold a text."""
    hits = _t(spark, d, "part").where(F.ilike(F.lower("p_name"), F.lit("%wid%"))).where(F.col("p_brand").isNotNull())
    return hits.orderBy(F.length("p_name"), "p_name", "p_partkey").limit(5).select("p_partkey", "p_name", F.length("p_name").alias("name_length"))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(20,2))::DECIMAL(30,2)::VARCHAR AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1")
def year_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a year, as a range that reaches the scan."""
    rows = _t(spark, d, "orders").where((F.col("o_orderdate") >= F.lit(date(1996, 1, 1)).cast("timestamp")) & (F.col("o_orderdate") < F.lit(date(1997, 1, 1)).cast("timestamp")))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("decimal(30,2)").cast("string").alias("total"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def year_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows between the first and last day of a year, both included."""
    span = P.year_range(F.lit("1995"))
    return _t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).where(F.col("day").between(span["first"], span["last"])).withColumn("day", F.col("day").cast("string"))


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list_semi(spark: SparkSession, d: str) -> DataFrame:
    """A list of values, and a semi-join instead of a join and DISTINCT."""
    lines = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(lines, "o_orderkey", "left_semi").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT lower(strip_accents(w)) AS name, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents WHERE lang = 'fr') WHERE regexp_matches(w, '^[A-Za-zàâçèéêëîïôùûüÀÂÇÈÉÊËÎÏÔÙÛÜ]+$') GROUP BY 1")
def accent_insensitive_match(spark: SparkSession, d: str) -> DataFrame:
    """Words that are equal but for case and accents."""
    words = _t(spark, d, "documents").where("lang = 'fr'").select(F.explode(F.split("text", r"\s+")).alias("w")).where(F.col("w").rlike("^[A-Za-zàâçèéêëîïôùûüÀÂÇÈÉÊËÎÏÔÙÛÜ]+$"))
    return words.groupBy(X.unaccent(F.lower("w")).alias("name")).agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, upper(trim(f)) IN ('X', 'OUI') AS flag, try_cast(regexp_extract(p_name || ' ' || p_size, '(\\d+)', 1) AS INT) AS rank, try_cast(CASE WHEN p_size % 4 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS DOUBLE) AS number
    FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN ' x ' WHEN 1 THEN 'Oui' WHEN 2 THEN 'non' WHEN 3 THEN '' ELSE NULL END AS g, coalesce(g, '') AS f FROM part)"""
)
def coerce_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags, ranks and numbers from text; what is none is false or null."""
    size = F.col("p_size")
    mark = F.when(size % 5 == 0, " x ").when(size % 5 == 1, "Oui").when(size % 5 == 2, "non").when(size % 5 == 3, "")
    return _t(spark, d, "part").select("p_partkey", P.flag(mark).alias("flag"), P.rank(F.concat_ws(" ", "p_name", size)).alias("rank"), P.number(F.when(size % 4 == 0, "n/a").otherwise(size.cast("string"))).alias("number"))


@query("SELECT n_nationkey, n_name AS nation_name FROM nation WHERE n_regionkey IS NOT NULL")
def projection_rename(spark: SparkSession, d: str) -> DataFrame:
    """Columns kept, renamed, normalized and dropped."""
    named = files.normalized_columns(_t(spark, d, "nation").withColumnsRenamed({"n_name": "NATION NAME"}).where(F.col("n_regionkey").isNotNull()))
    return named.drop("n_regionkey")


# --- shares and sums --------------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT r_name AS festival, year(o_orderdate)::INT AS year, {_share("gender = 'female'", "TRUE")} AS nominated_pct, {_share("gender = 'female'", "o_orderstatus = 'F'")} AS awarded_pct
    FROM lineitem JOIN (SELECT *, {_GENDER} AS gender FROM supplier) ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON l_orderkey = o_orderkey
    WHERE gender <> 'unknown' GROUP BY 1, 2"""
)
def festival_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of women among nominated and awarded directors per festival (region) and year; rows are not deduplicated."""
    people = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", gender(F.col("s_suppkey")).alias("gender")).where(M.known_gender(F.col("gender")))
    places = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = (
        _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
        .join(people, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))  # a nation a row
        .join(_t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return rows.groupBy(F.col("r_name").alias("festival"), F.year("o_orderdate").alias("year")).agg(
        M.female_share(F.col("gender")).alias("nominated_pct"), M.female_share(F.col("gender"), F.col("o_orderstatus") == "F").alias("awarded_pct")
    )


@query(f"SELECT l_orderkey, {_share('g = ' + chr(39) + 'female' + chr(39), 'g <> ' + chr(39) + 'unknown' + chr(39) + ' AND l_linenumber <= 3')} AS key_role_pct FROM (SELECT *, {_LINE_GENDER} AS g FROM lineitem) GROUP BY 1")
def film_key_role_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of women in key roles (the first three lines) of each film (order)."""
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(M.female_share(gender(F.col("l_suppkey")), F.col("l_linenumber") <= 3).alias("key_role_pct"))


@query(f"SELECT l_orderkey, {_share('g = ' + chr(39) + 'female' + chr(39), 'g <> ' + chr(39) + 'unknown' + chr(39) + ' AND lower(l_linestatus) = ' + chr(39) + 'o' + chr(39))} AS cast_pct FROM (SELECT *, {_LINE_GENDER} AS g FROM lineitem) GROUP BY 1")
def film_cast_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of women in the cast (line status O) of each film."""
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(M.female_share(gender(F.col("l_suppkey")), F.lower("l_linestatus") == "o").alias("cast_pct"))


@query(
    """SELECT user_id, ts::DATE::VARCHAR AS day, round(coalesce(sum(CASE WHEN event_type = 'signup' THEN v END), 0), 6) AS female_time, round(coalesce(sum(CASE WHEN event_type <> 'click' THEN v END), 0), 6) AS non_white_time
    FROM (SELECT *, CASE WHEN event_id % 7 > 0 THEN value END AS v FROM events) GROUP BY 1, 2"""
)
def screen_time_sums(spark: SparkSession, d: str) -> DataFrame:
    """Screen time of women (signup) and of non-white characters (anything but click) per film (user and day); some times are null."""
    time = F.when(F.col("event_id") % 7 > 0, F.col("value"))
    kind = F.when(F.col("event_type") == "signup", "Female").otherwise("Male")
    origin = F.when(F.col("event_type") == "click", "White").otherwise(F.col("event_type"))
    return _t(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.round(M.female_time(kind, time), 6).alias("female_time"), F.round(M.non_white_time(origin, time), 6).alias("non_white_time"))


@query(
    """SELECT l_orderkey, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN s END) * 100 / nullif(count(CASE WHEN l_returnflag = 'R' THEN s END), 0), 0), 6) AS female_share,
    round(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN s END) * 100 / nullif(count(CASE WHEN l_linestatus = 'F' THEN s END), 0), 0), 6) AS non_white_share FROM (SELECT *, nullif(l_discount, 0.05) AS s FROM lineitem) GROUP BY 1"""
)
def poster_mean_share(spark: SparkSession, d: str) -> DataFrame:
    """Mean poster share, over women (flag R) and over non-white characters (status F) that have one."""
    share = F.nullif(F.col("l_discount"), F.lit(0.05))
    kind, origin = F.when(F.col("l_returnflag") == "R", "female").otherwise("male"), F.when(F.col("l_linestatus") == "F", "Black").otherwise("White")
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(M.female_poster_share(kind, share), 6).alias("female_share"), F.round(M.non_white_poster_share(origin, share), 6).alias("non_white_share"))


@query("SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' ORDER BY 1 DESC")
def distinct_years_desc(spark: SparkSession, d: str) -> DataFrame:
    """Years with nominations, newest first."""
    few = _t(spark, d, "customer").where("c_mktsegment = 'AUTOMOBILE'").select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, d, "orders").join(few, "o_custkey", "left_semi").select(F.year("o_orderdate").alias("year")).distinct().orderBy(F.desc("year"))


@query("SELECT c_custkey, c_name, nullif(c_mktsegment, 'MACHINERY') AS label FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999) ORDER BY 3 ASC NULLS LAST, 1")
def awards_in_year(spark: SparkSession, d: str) -> DataFrame:
    """Awards (customers) with a nomination in a year, by label with nulls last."""
    dates = _t(spark, d, "orders").where(F.col("o_orderdate").between(F.lit("1999-01-01").cast("timestamp"), F.lit("1999-12-31 23:59:59.999999").cast("timestamp"))).select(F.col("o_custkey").alias("c_custkey"))
    label = F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("label")
    return _t(spark, d, "customer").join(dates, "c_custkey", "left_semi").select("c_custkey", "c_name", label).orderBy(F.col("label").asc_nulls_last(), "c_custkey")


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey = 3")
def films_by_award(spark: SparkSession, d: str) -> DataFrame:
    """Films of an award; a film comes once for each nomination."""
    lines = _t(spark, d, "lineitem").where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return _t(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey")


@query("SELECT l_orderkey, string_agg(DISTINCT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)), ', ' ORDER BY upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))) AS genres FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def bridge_genres(spark: SparkSession, d: str) -> DataFrame:
    """Genres (part types) of each film over the bridge table, sorted and joined."""
    kinds = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), X.capitalize(F.col("p_type")).alias("g"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(kinds, "l_partkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("g")), ", ").alias("genres"))


@query(
    """SELECT c_custkey, string_agg(n_name, ', ' ORDER BY cents DESC, n_name) AS countries FROM (SELECT c_custkey, n_name, sum((o_totalprice * 100)::BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON (c_nationkey + o_orderkey) % 25 = n_nationkey
    WHERE o_totalprice IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
)
def countries_by_budget(spark: SparkSession, d: str) -> DataFrame:
    """Countries of a film by their share of its budget, largest first."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = _t(spark, d, "orders").where("o_totalprice is not null").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    rows = o.join(c, "c_custkey").withColumn("k", (F.col("c_nationkey") + F.col("o_orderkey")) % 25).join(F.broadcast(n), "k").groupBy("c_custkey", "n_name").agg(F.sum("cents").alias("cents"))
    return rows.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cents")).alias("a"), "n_name"))), lambda s: s["n_name"]), ", ").alias("countries"))


@query(
    """SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) ON l_orderkey = o_orderkey AND n = 1"""
)
def first_child(spark: SparkSession, d: str) -> DataFrame:
    """Each film with its first child; films without one stay."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    first = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct(*order)).alias("f")).select("o_orderkey", "f.l_linenumber", "f.l_partkey")
    return _t(spark, d, "orders").select("o_orderkey").join(first, "o_orderkey", "left")


# --- deletes, inserts, updates ----------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def delete_using(spark: SparkSession, d: str) -> DataFrame:
    """Lines left after those of some orders are deleted."""
    gone = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return U.delete_where(_t(spark, d, "lineitem"), gone, ["l_orderkey"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the other table lacks."""
    return _t(spark, d, "customer").select("c_custkey", "c_name").join(_t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_name AS name, ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY p_name))::INT AS id FROM (SELECT DISTINCT p_name FROM part)")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that go on from the largest one."""
    return U.with_ids(_t(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), _t(spark, d, "nation").select(F.col("n_nationkey").alias("id")), ["name"])


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    """All left rows, with what the right has for them; counted before the join."""
    n = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return _t(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT p_partkey, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'S' WHEN 'PROMO' THEN 'P' WHEN 'ECONOMY' THEN 'E' WHEN 'small' THEN 's' END AS code FROM part")
def dict_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A value by key from a fixed table; null where it has none."""
    return _t(spark, d, "part").select("p_partkey", P.lookup({"STANDARD": "S", "PROMO": "P", "ECONOMY": "E", "small": "s"}, F.get(F.split("p_type", " "), F.lit(0))).alias("code"))


_SORTED = "array_to_string(list_sort(list_filter(string_split_regex(lower(regexp_replace({0}, '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+'), lambda x: x <> '')), ' ')"
_PREFIX = "CASE WHEN a[1] <> b[1] OR a = '' OR b = '' THEN 0 WHEN a[2] <> b[2] OR length(a) < 2 OR length(b) < 2 THEN 1 WHEN a[3] <> b[3] OR length(a) < 3 OR length(b) < 3 THEN 2 WHEN a[4] <> b[4] OR length(a) < 4 OR length(b) < 4 THEN 3 ELSE 4 END"
_COMPARED = f"((1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) + (CASE WHEN a = b THEN 1.0::DOUBLE ELSE jaro_similarity(a, b) + 0.1::DOUBLE * ({_PREFIX}) * (1 - jaro_similarity(a, b)) END)) / 2"


def _fuzzy_sql(threshold: float) -> str:
    return f"""WITH names AS (SELECT DISTINCT p_name AS n, {_SORTED.format("p_name")} AS s FROM part), pairs AS (SELECT x.n AS name_a, y.n AS name_b, x.s AS a, y.s AS b FROM names x JOIN names y ON x.n < y.n)
    SELECT name_a, name_b, round(similarity_score, 6) AS score FROM (SELECT name_a, name_b, {_COMPARED} AS similarity_score FROM pairs) WHERE similarity_score >= {threshold}"""


def _fuzzy(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    names = _t(spark, d, "part").select(F.col("p_name").alias("name_a")).distinct()
    found = R.fuzzy_join(names, names.withColumnRenamed("name_a", "name_b"), "name_a", "name_b", threshold)
    return found.where("name_a < name_b").select("name_a", "name_b", F.round("similarity_score", 6).alias("score"))


@query(_fuzzy_sql(0.9))
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of names that score 0.9 or more."""
    return _fuzzy(spark, d, 0.9)


@query(_fuzzy_sql(0.7))
def fuzzy_near_misses(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of names that score 0.7 or more."""
    return _fuzzy(spark, d, 0.7)


@query(f"""WITH names AS (SELECT DISTINCT p_name AS n, {_SORTED.format("p_name")} AS s FROM part), pairs AS (SELECT x.n AS name_a, y.n AS name_b, x.s AS a, y.s AS b FROM names x JOIN names y ON x.n < y.n),
    found AS (SELECT name_a, name_b, {_COMPARED} AS score FROM pairs) SELECT name_b AS name, min(name_a) AS duplicate_of FROM found WHERE score >= 0.8 GROUP BY 1""")
def fuzzy_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """All but the first of names that resemble each other."""
    names = _t(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("k")).distinct()
    return R.duplicates(names, "name", "k", 0.8).select("name", "duplicate_of")


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    f"""WITH a AS (SELECT DISTINCT p_name AS name, {_TRIGRAMS.format("p_name")} AS t FROM part), b AS (SELECT DISTINCT p_type AS title, {_TRIGRAMS.format("p_type || ' ' || split_part(p_name, ' ', 1)")} AS t, p_type || ' ' || split_part(p_name, ' ', 1) AS label FROM part),
    s AS (SELECT label, name, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS score FROM a, b) SELECT label, name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, name) AS n FROM s WHERE score > 0.2) WHERE n = 1"""
)
def trigram_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The most similar name of each label by trigrams, if it exceeds a threshold; pairs meet on one of their rarest trigrams."""
    part = _t(spark, d, "part")
    labels = part.select(F.concat_ws(" ", "p_type", F.get(F.split("p_name", " "), F.lit(0))).alias("text"))
    return G.best_matches(labels, part.select(F.col("p_name").alias("text")), 0.2).select(F.col("a").alias("label"), F.col("b").alias("name"), F.round("score", 6).alias("score"))


@query(
    """WITH e AS (SELECT o_orderkey, unnest([{'i': 1, 'k': 'NATION_' || (o_custkey % 5), 'v': (o_orderkey % 60)::INT}, {'i': 2, 'k': 'NATION_' || (o_custkey % 3), 'v': 40}, {'i': 3, 'k': 'NATION_0', 'v': CASE WHEN o_orderkey % 2 = 0 THEN 40 END}], recursive := true) FROM orders),
    k AS (SELECT o_orderkey, k, max_by(v, i) AS v FROM e WHERE v IS NOT NULL GROUP BY 1, 2)
    SELECT o_orderkey, string_agg(k || '=' || v, ';' ORDER BY k) AS shares, coalesce(max(CASE WHEN k = 'NATION_0' THEN v END), 0) = max(v) AS is_home_financed FROM k GROUP BY 1"""
)
def map_alloc_french(spark: SparkSession, d: str) -> DataFrame:
    """Country shares from a cell with malformed and repeated parts, and whether home (NATION_0 for France) has the largest."""
    o = F.col("o_orderkey")
    last = F.when(o % 2 == 0, F.lit("nation_0-40")).otherwise(F.lit("nation_0-x"))
    cell = F.concat_ws(" / ", F.concat(F.lit("Nation_"), F.col("o_custkey") % 5, F.lit("-"), o % 60), F.concat(F.lit("nation_"), F.col("o_custkey") % 3, F.lit(" - 40")), F.lit("broken"), last)
    shares = M.allocation_rows(_t(spark, d, "orders").select("o_orderkey", cell.alias("cell")), "o_orderkey", "cell")
    listed = F.array_join(F.array_sort(F.collect_list(F.concat(F.upper("country"), F.lit("="), "rate"))), ";")
    home = F.coalesce(F.max(F.when(F.col("country") == "Nation_0", F.col("rate"))), F.lit(0)) == F.max("rate")
    return shares.groupBy("o_orderkey").agg(listed.alias("shares"), home.alias("is_home_financed"))


@query(
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ', ') AS broadcasters FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ['Canal+', 'OCS'] WHEN 1 THEN ['Netflix'] WHEN 2 THEN ['Ciné+', 'Ciné+'] ELSE []::VARCHAR[] END AS a,
    CASE p_size % 3 WHEN 0 THEN ['FranceTV', 'France2'] WHEN 1 THEN ['TF1', 'Arte'] ELSE []::VARCHAR[] END AS b FROM part)"""
)
def broadcaster_join(spark: SparkSession, d: str) -> DataFrame:
    """Known broadcasters of two cells, together, sorted and without repeats."""
    s = F.col("p_size")
    paying = P.broadcasters(F.when(s % 4 == 0, "CANAL  ocs zzz").when(s % 4 == 1, "netlfix").when(s % 4 == 2, "ciné+ Cine+"), True)
    free = P.broadcasters(F.when(s % 3 == 0, "France 2").when(s % 3 == 1, "TF1 arte").otherwise("inconnu"), False)
    return _t(spark, d, "part").select("p_partkey", P.all_broadcasters(paying, free).alias("broadcasters"))


@query(
    """SELECT o_orderkey, CASE WHEN x IS NULL OR isnan(x) OR x < 0 THEN NULL WHEN x < 2000000 THEN 'Moins de 2 M€' WHEN x < 5000000 THEN '2 à 5 M€' WHEN x < 10000000 THEN '5 à 10 M€' WHEN x < 20000000 THEN '10 à 20 M€' ELSE 'Plus de 20 M€' END AS bucket
    FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN -1 ELSE o_totalprice * 100 END AS x FROM orders)"""
)
def budget_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Half-open budget buckets; null, negative and not-a-number have none."""
    o = F.col("o_orderkey")
    x = F.when(o % 6 == 0, F.lit(None).cast("double")).when(o % 6 == 1, F.lit(float("nan"))).when(o % 6 == 2, F.lit(-1.0)).otherwise(F.col("o_totalprice") * 100)
    return _t(spark, d, "orders").select("o_orderkey", P.budget_category(x).alias("bucket"))


@query(
    """SELECT bucket, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'Animation, Drame' WHEN 1 THEN 'Comédie/Comédie dramatique' WHEN 2 THEN NULL WHEN 3 THEN 'Biopic/Guerre/Histoire, Fantastique/Horreur/SF' ELSE 'Documentaire' END AS bucket FROM part) GROUP BY 1"""
)
def genre_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    """Genres mapped to buckets, and how many films have each set of them."""
    s = F.col("p_size")
    raw = F.when(s % 5 == 0, F.lit("Drame/ Animation /opéra")).when(s % 5 == 1, F.lit("Romance/Comédie")).when(s % 5 == 2, F.lit("Divers")).when(s % 5 == 3, F.lit("Science Fiction/péplum/erotique")).otherwise(F.lit("documentaire"))
    return _t(spark, d, "part").select(P.genre_categories(F.split(raw, "/")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


# --- text -------------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT s_suppkey, array_to_string(list_transform(regexp_extract_all(lower(n), '([a-z]+|[^a-z]+)'), lambda r: upper(r[1]) || substr(r, 2)), '') AS title, array_to_string(list_transform(string_split(n, ' '), lambda r: upper(r[1]) || substr(r, 2)), ' ') AS upper_first
    FROM (SELECT s_suppkey, replace(lower(s_name), '#', '-') || ' d''arc o''NEIL 3d' AS n FROM supplier)"""
)
def title_case(spark: SparkSession, d: str) -> DataFrame:
    """Every run of letters capitalized, and only first letters."""
    n = F.concat(F.replace(F.lower("s_name"), F.lit("#"), F.lit("-")), F.lit(" d'arc o'NEIL 3d"))
    return _t(spark, d, "supplier").select("s_suppkey", X.title_case(n).alias("title"), X.upper_first_letters(n).alias("upper_first"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Le ' || lower(p_name[1]) || substr(p_name, 2) WHEN 1 THEN 'L''' || lower(p_name) WHEN 2 THEN upper(p_name[1]) || lower(substr(p_name, 2)) ELSE p_name END AS title FROM part"""
)
def clean_title(spark: SparkSession, d: str) -> DataFrame:
    """Articles from the end of a title to its front, capitals lowered."""
    s, n = F.col("p_size"), F.col("p_name")
    raw = F.when(s % 4 == 0, F.concat(n, F.lit(" (Le)"))).when(s % 4 == 1, F.concat(F.upper(n), F.lit(" (L')"))).when(s % 4 == 2, F.upper(n)).otherwise(n)
    return _t(spark, d, "part").select("p_partkey", X.clean_title(raw).alias("title"))


@query(
    """SELECT doc_id, w[1] AS first_name, CASE WHEN len(w) > 1 THEN w[-1] ELSE '' END AS last_name, array_to_string(w, ' ') AS clean, len(list_filter(list_transform(string_split(t, '.'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''))::INT AS parts
    FROM (SELECT doc_id, text AS t, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"""
)
def split_names(spark: SparkSession, d: str) -> DataFrame:
    """First and last token, single blanks, and non-empty parts."""
    t = F.col("text")
    parts = F.filter(F.transform(F.split(t, r"\."), lambda x: F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")), lambda x: x != "")
    return _t(spark, d, "documents").select("doc_id", X.first_name(t).alias("first_name"), X.last_name(t).alias("last_name"), X.remove_extra_spaces(t).alias("clean"), F.size(parts).alias("parts"))


@query("SELECT n_nationkey, array_to_string(list_filter(list_transform(string_split('a / ' || n_name || '/ /' || n_regionkey, '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM nation")
def slash_lists(spark: SparkSession, d: str) -> DataFrame:
    """Items of a cell between slashes."""
    return _t(spark, d, "nation").select("n_nationkey", F.array_join(P.slash_list(F.concat(F.lit("a / "), "n_name", F.lit("/ /"), F.col("n_regionkey").cast("string"))), "|").alias("items"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS gender FROM customer")
def gender_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Gender by first name from a lookup table; 'unknown' without an entry."""
    table = spark.createDataFrame([("camille", "female"), ("john", "male")], "first string, gender string")
    first = F.when(F.col("c_custkey") % 4 == 0, "camille").when(F.col("c_custkey") % 4 == 1, "john").when(F.col("c_custkey") % 4 == 2, "kio")
    return _t(spark, d, "customer").select("c_custkey", first.alias("first")).join(F.broadcast(table), "first", "left").select("c_custkey", F.coalesce("gender", F.lit("unknown")).alias("gender"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN nullif(p_size, 0) WHEN 1 THEN nullif(p_size, 0) WHEN 5 THEN 7 END AS age FROM part")
def parse_ages(spark: SparkSession, d: str) -> DataFrame:
    """Ages from text; zero and nonsense are null."""
    s = F.col("p_size")
    raw = F.when(s % 6 == 0, s.cast("string")).when(s % 6 == 1, F.concat(s, F.lit("+"))).when(s % 6 == 2, "abc").when(s % 6 == 3, "0").when(s % 6 == 4, "25.0").otherwise(" 7 ")
    return _t(spark, d, "part").select("p_partkey", P.age(raw).alias("age"))


@query("SELECT event_id, nullif(CASE event_id % 5 WHEN 0 THEN m WHEN 1 THEN (event_id % 4) * 60 WHEN 2 THEN event_id % 60 END, 0)::INT AS minutes FROM (SELECT event_id, (event_id % 4) * 60 + event_id % 60 AS m FROM events)")
def parse_durations(spark: SparkSession, d: str) -> DataFrame:
    """Durations in minutes from text."""
    e, h, m = F.col("event_id"), (F.col("event_id") % 4).cast("string"), (F.col("event_id") % 60).cast("string")
    raw = F.when(e % 5 == 0, F.concat(h, F.lit("h"), F.lpad(m, 2, "0"), F.lit("min"))).when(e % 5 == 1, F.concat(h, F.lit("h"))).when(e % 5 == 2, F.concat(m, F.lit("min"))).when(e % 5 == 3, "weird input").otherwise("")
    return _t(spark, d, "events").select("event_id", P.duration(raw).alias("minutes"))


@query("SELECT event_id, (event_id // 60)::VARCHAR || 'h' || lpad((event_id % 60)::VARCHAR, 2, '0') AS duration, floor(event_id / 60.0 + 0.5)::INT || ' minutes ' || (event_id % 60) || ' secondes' AS spoken FROM events")
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    """Minutes as hours and minutes; seconds in words."""
    return _t(spark, d, "events").select("event_id", P.format_duration(F.col("event_id")).alias("duration"), P.format_seconds(F.col("event_id")).alias("spoken"))


@query(
    """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS parsed, day(o_orderdate) || ' ' || ['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'][month(o_orderdate)] || ' ' || year(o_orderdate) AS written FROM orders"""
)
def french_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates as long French text, and back."""
    written = P.french_date(F.col("o_orderdate"))
    return _t(spark, d, "orders").select("o_orderkey", P.release_date(written).cast("string").alias("parsed"), written.alias("written"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN '' || year(o_orderdate) END AS year, CASE WHEN o_orderkey % 4 < 2 THEN 'Lauréat' END AS distinction, CASE WHEN o_orderkey % 4 = 1 THEN 'Prix' ELSE o_orderpriority END AS award FROM orders"""
)
def parse_reward(spark: SparkSession, d: str) -> DataFrame:
    """Year, distinction and award from one text."""
    o, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    raw = F.when(o % 4 == 0, F.concat(y, F.lit(" | Lauréat : "), "o_orderpriority")).when(o % 4 == 1, F.concat(y, F.lit("|Lauréat: Prix : du jury | x"))).when(o % 4 == 2, F.concat(y, F.lit(" | "), "o_orderpriority")).otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    r = P.reward(raw)
    return _t(spark, d, "orders").select("o_orderkey", r["year"].alias("year"), r["distinction"].alias("distinction"), r["award"].alias("award"))


@query("SELECT event_id, json_valid(props) AS valid, CASE WHEN event_id % 3 = 0 THEN 'a|' || event_type WHEN event_id % 3 = 1 THEN 'director=' || event_type END AS entries FROM events")
def json_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lists of names and of roles in JSON cells; what is no JSON is null."""
    e = F.col("event_id")
    names = P.name_list(F.when(e % 3 == 0, F.to_json(F.array(F.lit("a"), "event_type"))))
    credits = P.credit_list(F.when(e % 3 == 1, F.to_json(F.array(F.struct(F.lit("director").alias("role"), F.col("event_type").alias("name")), F.struct(F.lit("").alias("role"), F.lit("x").alias("name"))))).when(e % 3 == 2, "not json"))
    listed = F.coalesce(F.array_join(names, "|"), F.array_join(F.transform(credits, lambda c: F.concat_ws("=", c["role"], c["name"])), "|"))
    return _t(spark, d, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.when(e % 3 < 2, listed).alias("entries"))


@query("SELECT page_id, i::INT AS i, u[i] AS href, t[i] AS text FROM (SELECT page_id, unnest(range(1, len(u) + 1)) AS i, u, t FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS u, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS t FROM pages))")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page, in order."""
    rows = _t(spark, d, "pages").select("page_id", F.posexplode(pages.links(F.col("html"))).alias("i", "l"))
    return rows.select("page_id", (F.col("i") + 1).alias("i"), "l.href", "l.text")


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, len(regexp_extract_all(html, '<li>'))::INT AS items, regexp_extract(html, '<div class=\"ad\">([^<]*)', 1) AS advert FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    """Title, list items and the text of an element by class."""
    h = F.col("html")
    return _t(spark, d, "pages").select("page_id", pages.title(h).alias("title"), F.size(pages.elements(h, "li")).alias("items"), F.get(pages.elements(h, "div", "ad"), F.lit(0)).alias("advert"))


@query("SELECT p_partkey, replace(lower(replace(p_name || ' - ' || p_brand, ' - ', '+')), ' ', '+') AS url FROM part")
def url_format(spark: SparkSession, d: str) -> DataFrame:
    """A name as part of an address."""
    return _t(spark, d, "part").select("p_partkey", X.url_text(F.concat_ws(" - ", "p_name", "p_brand")).alias("url"))


@query("SELECT p_partkey, concat_ws('. ', p_name, CASE WHEN p_size > 25 THEN p_type END, array_to_string(string_split(p_type || ' a b c', ' ')[1:3], ', ')) AS description FROM part")
def seo_text(spark: SparkSession, d: str) -> DataFrame:
    """A description from the parts that are there, with the first three of a list."""
    three = F.array_join(F.slice(F.split(F.concat(F.col("p_type"), F.lit(" a b c")), " "), 1, 3), ", ")
    return _t(spark, d, "part").select("p_partkey", X.seo_text(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")), three).alias("description"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'Prix' END AS label FROM orders")
def award_label(spark: SparkSession, d: str) -> DataFrame:
    """The French label, or the source's own where that says 'Autre'."""
    french = F.when(F.col("o_orderkey") % 3 == 0, "Autre").when(F.col("o_orderkey") % 3 == 1, "Prix")
    return _t(spark, d, "orders").select("o_orderkey", X.display_name(F.col("o_orderpriority"), french).alias("label"))


# --- tables as wholes -------------------------------------------------------------------------------------------------------------


@query(
    """WITH new AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT n_name FROM nation WHERE n_nationkey < 5), fresh AS (SELECT name FROM new WHERE name NOT IN (SELECT n_name FROM nation))
    SELECT n_nationkey::INT AS id, n_name AS name FROM nation UNION ALL SELECT ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY name))::INT, name FROM fresh"""
)
def upsert_find_or_create(spark: SparkSession, d: str) -> DataFrame:
    """A dimension with the names that it lacked, under new ids."""
    old = _t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    new = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).unionByName(old.where("id < 5").select("name"))
    return U.find_or_create(old, new, ["name"])


@query(
    """SELECT k AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM (SELECT c_custkey AS k FROM customer UNION SELECT c_custkey + 50 FROM customer WHERE c_custkey % 7 = 0) LEFT JOIN customer o ON o.c_custkey = k
    LEFT JOIN (SELECT c_custkey + 50 AS c_custkey, 'new ' || c_name AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 = 0) n ON n.c_custkey = k"""
)
def upsert_update(spark: SparkSession, d: str) -> DataFrame:
    """Create or update by key: values that are set win, the others stay."""
    old = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 50).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"))
    return U.create_or_update(old, new, ["c_custkey"])


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 10 THEN 'n' || s_nationkey ELSE s_name END AS label FROM supplier")
def update_known(spark: SparkSession, d: str) -> DataFrame:
    """Attributes updated where the change has a row."""
    old = _t(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_name").alias("label"), "s_nationkey")
    new = old.where("s_nationkey < 10").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("label")).unionByName(spark.createDataFrame([(-1, "x")], "s_suppkey bigint, label string"))
    return U.update(old, new, ["s_suppkey"]).select("s_suppkey", "s_name", "label")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def nominations_first_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of rows with equal keys the first stays."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return U.keep_first(o.limit(0), o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query(
    """SELECT l_returnflag, count(*) AS n, sum((l_quantity)::BIGINT)::BIGINT AS quantity FROM (SELECT l_returnflag, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 3 UNION ALL SELECT l_returnflag, l_quantity * 2 FROM lineitem WHERE l_orderkey % 10 = 3) GROUP BY 1"""
)
def reload_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the named parents deleted and inserted anew."""
    old = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    new = old.where("l_orderkey % 10 = 3").withColumn("l_quantity", F.col("l_quantity") * 2)
    return U.reload(old, new, ["l_orderkey"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("SELECT year, count(*) AS n, count(c_name) AS names, count(s_name) AS others FROM (SELECT 2020 AS year, c_name, NULL AS s_name FROM customer UNION ALL SELECT 2021, NULL, s_name FROM supplier) GROUP BY 1")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Yearly sheets with different columns under each other."""
    stacked = files.sheets({"intro": _t(spark, d, "nation"), "2020": _t(spark, d, "customer").select("c_name"), "2021": _t(spark, d, "supplier").select("s_name")})
    return stacked.groupBy(F.col("cnc_agrement_year").alias("year")).agg(F.count("*").alias("n"), F.count("c_name").alias("names"), F.count("s_name").alias("others"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders, count(*) AS n FROM orders GROUP BY 1")
def group_to_list(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each key as a list, and their number."""
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"), F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT text, lang FROM documents)")
def dedupe_rows(spark: SparkSession, d: str) -> DataFrame:
    """Distinct whole rows."""
    return _t(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").alias("n"), "lang").dropDuplicates().agg(F.count("*").alias("n"))


@query("SELECT DISTINCT w FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) WHERE w <> '' ORDER BY 1")
def distinct_exploded(spark: SparkSession, d: str) -> DataFrame:
    """Distinct items of lists, sorted, without the empty one."""
    return _t(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("w")).where("w <> ''").distinct().orderBy("w")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 2 = 0 THEN 'not_found' ELSE 'found' END AS status, CASE WHEN event_id % 2 = 1 THEN event_id * 10 END AS allocine_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0)")
def ledger_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Work that the ledger lacks, with what was found for it and a status."""
    e = _t(spark, d, "events")
    work = ledger.unseen(e.select("event_id", "user_id"), e.where("event_type = 'purchase' and event_id % 3 = 0"), ["user_id"])
    found = e.select("event_id", F.when(F.col("event_id") % 2 == 1, F.col("event_id") * 10).alias("allocine_id"), (F.col("event_id") % 5 == 0).alias("failed"))
    return ledger.with_status(work, found, ["event_id"], "allocine_id").select("event_id", "status", "allocine_id")


# --- documents --------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH c AS (SELECT *, {_LINE_GENDER} AS g FROM lineitem), s AS (SELECT l_orderkey, {_share("g = 'female'", "g <> 'unknown' AND l_linenumber <= 3")} AS key_roles, {_share("g = 'female'", "g <> 'unknown' AND l_linenumber > 3")} AS casting,
    round(coalesce(sum(CASE WHEN g = 'female' THEN l_quantity END), 0), 6) AS female_time, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS genres FROM c GROUP BY 1)
    SELECT o_orderkey, (o_custkey // 60) || 'h' || lpad((o_custkey % 60)::VARCHAR, 2, '0') AS duration, genres, key_roles, casting, female_time FROM orders LEFT JOIN s ON l_orderkey = o_orderkey"""
)
def film_document(spark: SparkSession, d: str) -> DataFrame:
    """A film's page in one plan: attributes, genres, shares and times."""
    g, n = gender(F.col("l_suppkey")), F.col("l_linenumber")
    parts = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("genres"), M.female_share(g, n <= 3).alias("key_roles"), M.female_share(g, n > 3).alias("casting"), F.round(M.female_time(g, F.col("l_quantity")), 6).alias("female_time")
    )
    return _t(spark, d, "orders").select("o_orderkey", P.format_duration(F.col("o_custkey")).alias("duration")).join(parts, "o_orderkey", "left")


@query(
    f"""WITH n AS (SELECT o_orderkey, o_orderstatus = 'F' AS won FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')),
    f AS (SELECT l_orderkey, {_share("g = 'female'", "g <> 'unknown'")} AS pct, string_agg(DISTINCT 'S' || l_suppkey, ', ' ORDER BY 'S' || l_suppkey) AS directors FROM (SELECT *, {_LINE_GENDER} AS g FROM lineitem) GROUP BY 1)
    SELECT o_orderkey, won, pct, directors FROM n LEFT JOIN f ON l_orderkey = o_orderkey"""
)
def festival_document(spark: SparkSession, d: str) -> DataFrame:
    """A festival's (segment's) nominations of its newest year, each with its film's share and directors."""
    c = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = _t(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("won"))
    newest = o.agg(F.max("year").alias("year"))
    films = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(M.female_share(gender(F.col("l_suppkey"))).alias("pct"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))), ", ").alias("directors"))
    return o.join(F.broadcast(newest), "year", "left_semi").join(films, "o_orderkey", "left").select("o_orderkey", "won", "pct", "directors")


def _film_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as films, lines as credits, suppliers as holders: every third a company, the others with a nation as first name and a number as last."""
    supplier, k = _t(spark, d, "supplier"), F.col("s_suppkey")
    named = supplier.join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    company = k % 3 == 2
    roles = ["director", "actor", "screenwriter", "production", "distribution", "co_production", "paying_broadcaster"]
    return {
        "films": _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("original_name"), F.col("o_custkey").alias("budget")),
        "roles": spark.createDataFrame([(i + 1, r, i in (0, 2), r, None) for i, r in enumerate(roles)], "id int, name string, is_key_role boolean, inclusive_name string, allocine_name string"),
        "credit_holders": named.select(k.alias("id"), F.when(company, "Company").otherwise("Individual").alias("type"), F.when(~company, F.col("n_name")).alias("first_name"), F.when(~company, k.cast("string")).alias("last_name"), F.when(company, F.col("s_name")).alias("legal_name"), gender(k).alias("gender")),
        "film_credits": _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("film_id"), F.col("l_linenumber").alias("role_id"), F.col("l_suppkey").alias("credit_holder_id")),
    }


_HOLDER = "CASE WHEN s_suppkey % 3 = 2 THEN s_name ELSE array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || s_suppkey END"
_CREDITS = f"SELECT l_orderkey AS film_id, l_linenumber AS i, s_suppkey % 3 = 2 AS company, {_HOLDER} AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


@query(f"SELECT film_id, string_agg(name, '; ' ORDER BY i, name) AS directors FROM ({_CREDITS}) WHERE i = 1 AND NOT company GROUP BY 1")
def film_directors(spark: SparkSession, d: str) -> DataFrame:
    """Individual directors of each film; companies that direct are none."""
    from lumenframe.plans.read_models import directors

    return directors(_film_tables(spark, d)).select("film_id", F.array_join("directors", "; ").alias("directors"))


@query(
    f"""SELECT film_id, coalesce(string_agg(name, '; ' ORDER BY i, company, name) FILTER (WHERE i IN (1, 3)), '') AS key_roles, coalesce(string_agg(name, '; ' ORDER BY i, company, name) FILTER (WHERE i = 2), '') AS casting, coalesce(string_agg(name, '; ' ORDER BY i, company, name) FILTER (WHERE i = 4 AND company), '') AS production,
    coalesce(string_agg(name, '; ' ORDER BY i, company, name) FILTER (WHERE i = 7 AND company), '') AS financiers, count_if(i IN (1, 2, 3) AND company)::INT AS companies_with_key_roles_or_cast FROM ({_CREDITS}) GROUP BY 1"""
)
def film_credit_groups(spark: SparkSession, d: str) -> DataFrame:
    """The overlapping lists of a film's credits."""
    from lumenframe.plans.read_models import credit_groups

    names = lambda c: F.array_join(F.transform(c, lambda e: e["name"]), "; ").alias(c)
    both = F.concat("key_roles", "casting")
    return credit_groups(_film_tables(spark, d)).select("film_id", *map(names, ("key_roles", "casting", "production", "financiers")), F.size(F.filter(both, lambda e: e["is_company"])).alias("companies_with_key_roles_or_cast"))


@query(
    f"""WITH rows AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 4 = 0 THEN 'the ' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE ' ii' END AS title, p_partkey % 25 AS nation, p_partkey % 7 AS last FROM part),
    films AS (SELECT p_partkey AS film_id, p_name AS name, p_partkey % 25 AS nation, p_partkey % 7 AS last FROM part),
    scored AS (SELECT row_id, film_id, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS score FROM (SELECT *, {_TRIGRAMS.format("title")} AS t FROM rows) a JOIN (SELECT *, {_TRIGRAMS.format("name")} AS t FROM films) b USING (nation, last))
    SELECT row_id, film_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, film_id) AS n FROM scored WHERE score > 0.6) WHERE n = 1"""
)
def film_by_director(spark: SparkSession, d: str) -> DataFrame:
    """Award rows matched to films: the director by first and last token of a name with middle names, blanks, case and accents of its own, the title by trigrams."""
    k = F.col("p_partkey")
    part = _t(spark, d, "part")
    nations = F.broadcast(_t(spark, d, "nation"))  # 25 rows
    named = part.join(nations, k % 25 == F.col("n_nationkey")).withColumn("last", F.concat(F.lit("Étoile"), (k % 7).cast("string")))
    first = F.replace("n_name", F.lit(" "), F.lit("-"))
    directors = named.select(k.alias("film_id"), first.alias("first_name"), F.col("last").alias("last_name"))
    title = F.concat(F.when(k % 4 == 0, "the ").otherwise(""), "p_name", F.when(k % 3 == 0, "!").otherwise(" ii"))
    rows = named.select(k.alias("row_id"), title.alias("title"), F.concat(F.lit("  "), F.lower(first), F.lit("  Maria  de "), F.replace("last", F.lit("É"), F.lit("e"))).alias("director"))
    return R.best_film(rows, part.select(k.alias("id"), F.col("p_name").alias("original_name")), directors, 0.6).where("film_id is not null").select("row_id", "film_id", F.round("score", 6).alias("score"))


@query("SELECT o_orderpriority AS dimension, count(*) AS films FROM orders GROUP BY 1")
def dashboard_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Films by a dashboard dimension."""
    from lumenframe.plans.read_models import dashboard

    return dashboard({"films": _t(spark, d, "orders")}, "o_orderpriority").withColumnRenamed("o_orderpriority", "dimension")


@query("SELECT 'orders without a customer' AS check, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'repeated lines', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def key_checks(spark: SparkSession, d: str) -> DataFrame:
    """Orphans and repeated keys."""
    from lumenframe.schema import duplicate_keys, orphans

    a = orphans(_t(spark, d, "orders"), "o_custkey", _t(spark, d, "customer"), "c_custkey").agg(F.count("*").alias("n")).select(F.lit("orders without a customer").alias("check"), "n")
    b = duplicate_keys(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n")).select(F.lit("repeated lines").alias("check"), "n")
    return a.unionByName(b)


# --- faces ------------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, trunc(l_quantity / 640 * 1920)::INT AS x FROM lineitem WHERE abs(l_quantity - l_linenumber) * abs(l_suppkey - l_linenumber) / (100 / 2.4 * 100) BETWEEN 0.01 AND 0.5 AND l_discount >= 0.03 AND coalesce(CASE WHEN l_returnflag = 'N' THEN -l_tax END <= -0.02, false)"""
)
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by relative area, confidence and pose; coordinates scaled and cut."""
    cheap = [lambda f: V.area_ok(F.col("l_quantity"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_linenumber"), V.effective_area(F.lit(100))), lambda f: V.confident(F.col("l_discount"), 0.03)]
    kept = V.apply_filters(_t(spark, d, "lineitem"), cheap, [lambda f: V.facing(F.when(F.col("l_returnflag") == "N", -F.col("l_tax")), -0.02)])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", V.rescale(F.col("l_quantity"), F.lit(640), F.lit(1920)).alias("x"))


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, (event_id % 3)::VARCHAR AS g FROM events), a AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM e GROUP BY 1, 2), b AS (SELECT user_id, g, count(*) AS n, min(event_id) AS f FROM e GROUP BY 1, 2),
    s AS (SELECT user_id, count(*) AS occurence, sum(abs(event_id % 7 - event_id % 5) * abs(event_id % 11 - event_id % 4))::BIGINT AS area_occupied, min(event_id) AS first_id FROM e GROUP BY 1 HAVING count(*) > 5)
    SELECT (row_number() OVER (ORDER BY first_id) - 1)::INT AS label, occurence, area_occupied, (SELECT event_type FROM a WHERE a.user_id = s.user_id ORDER BY n DESC, f LIMIT 1) AS age, (SELECT g FROM b WHERE b.user_id = s.user_id ORDER BY n DESC, f LIMIT 1) AS gender FROM s"""
)
def cluster_mode(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of more than five faces: commonest labels (ties: seen first), size and area, numbered as first met."""
    e, i = _t(spark, d, "events"), F.col("event_id")
    faces = e.select(F.lit(1).alias("film"), F.col("user_id").alias("label"), "event_id", F.col("event_type").alias("age"), (i % 3).cast("string").alias("gender"), F.lit("White").alias("ethnicity"), (i % 7).alias("x1"), (i % 11).alias("y1"), (i % 5).alias("x2"), (i % 4).alias("y2"))
    return V.aggregate_clusters(faces, "film", "event_id", 5).select("label", "occurence", "area_occupied", "age", "gender")


@query(
    """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS point_id, v.label, sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS dist FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)
    SELECT query_id, point_id, label, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS n FROM p) WHERE n = 1"""
)
def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    """Each vector whose id is divisible by 20 with its nearest other one, of all."""
    v = _t(spark, d, "embeddings")
    found, _ = pivots.nearest(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("point_id"), "label", F.col("embedding").alias("vector")))
    return found.select("query_id", "point_id", "label", F.round("distance", 4).alias("dist"))


@query(
    """WITH a AS (SELECT l_orderkey AS f, l_linenumber AS j, (l_partkey % 50 + l_partkey % 50 + 4) / 2.0 AS x, (l_suppkey % 50 + l_suppkey % 50 + 4) / 2.0 AS y FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
    p AS (SELECT d.f, d.j AS det, a.j AS idx, abs(d.x + 1 - a.x) + abs(d.y - a.y) AS dist FROM a d JOIN a ON a.f = d.f WHERE a.j % 2 = 0) SELECT f AS frame_id, det AS det_id, idx, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY f, det ORDER BY dist, idx) AS n FROM p) WHERE n = 1 AND dist < 3"""
)
def nearest_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Each detection with its frame's nearest annotation, if that is nearer than three pixels."""
    one = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("j")).agg((F.min("l_partkey") % 50).alias("x"), (F.min("l_suppkey") % 50).alias("y"))
    detections = one.select("frame_id", F.col("j").alias("det_id"), (F.col("x") + 1).alias("x1"), F.col("y").alias("y1"), (F.col("x") + 5).alias("x2"), (F.col("y") + 4).alias("y2"))
    annotations = one.where("j % 2 = 0").select("frame_id", F.col("j").alias("idx"), (F.col("x") + 2.0).alias("cx"), (F.col("y") + 2.0).alias("cy"))
    return V.nearest_annotation(detections, annotations).withColumn("distance", F.round("distance", 6))


_LABELS = {"ethnicity": (ETHNICITIES, 1, 7), "gender": (GENDERS, 8, 9), "age": (AGES, 10, 18)}


@query(
    "WITH e AS (SELECT vec_id, embedding[1:18] AS l, list_transform(embedding[1:18], lambda x: exp(x::DOUBLE - list_max(embedding[1:18])::DOUBLE)) AS x FROM embeddings) SELECT vec_id, (list_position(l, list_max(l)) - 1)::INT AS best, round(list_max(x) / list_sum(x), 6) AS confidence, "
    + ", ".join(f"{names!r}[list_position(l[{a}:{b}], list_max(l[{a}:{b}]))] AS {k}" for k, (names, a, b) in _LABELS.items())
    + " FROM e"
)
def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest class of 18 logits (the head of each vector) and its softmax; ethnicity, gender and age from their shares of the logits."""
    logits = F.transform(F.slice("embedding", 1, 18), lambda x: x.cast("double"))
    return _t(spark, d, "embeddings").select("vec_id", V.argmax(logits).alias("best"), F.round(F.array_max(V.softmax(logits)), 6).alias("confidence"), V.classify(logits).alias("c")).select("vec_id", "best", "confidence", "c.*")


@query("SELECT round(avg(((quality <> doc_id % 2)::INT + (toxic <> doc_id % 3)::INT + (toxic <> quality)::INT) / 3.0), 6) AS score FROM labels")
def eval_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean error over labels and predictions."""
    score = V.error_score([(F.col("quality"), F.col("doc_id") % 2), (F.col("toxic"), F.col("doc_id") % 3), (F.col("toxic"), F.col("quality"))])
    return _t(spark, d, "labels").agg(F.round(F.avg(score), 6).alias("score"))


@query(
    """WITH v AS (SELECT vec_id, label AS film, embedding FROM embeddings), e AS (SELECT q.vec_id AS a, p.vec_id AS b FROM v q JOIN v p ON q.film = p.film AND q.vec_id <> p.vec_id WHERE sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) < 1.2)
    SELECT film, vec_id, count(b) AS neighbours, min(b) AS first_neighbour FROM v LEFT JOIN e ON a = vec_id GROUP BY 1, 2"""
)
def near_faces(spark: SparkSession, d: str) -> DataFrame:
    """Each face (vector) with the number of its film's (label's) faces nearer than 1.2, and the first of them: the edges that clustering passes labels over."""
    v = _t(spark, d, "embeddings").withColumnRenamed("label", "film")
    faces = V.numbered_faces(v, "film", "vec_id", "embedding")
    e = V.edges(faces, "film", 1.2).join(faces.select(F.col("node").alias("b"), F.col("vec_id").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("neighbours"), F.min("other").alias("first_neighbour"))
    return faces.join(e, "node", "left").select("film", "vec_id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "first_neighbour")


@query()
def threshold_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Faces (vectors) of each film (label) clustered by Chinese whispers with seeded coins; tested against going round by round in plain Python."""
    return V.clusters(_t(spark, d, "embeddings").withColumnRenamed("label", "film"), "film", "vec_id", "embedding", 0.92)
