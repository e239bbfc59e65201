"""Queries of the ingest, of stored indexes and of commits over the driver's tables, each beside the SQL that gives the same rows (see catalogue)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.operators import trigram_index as T
from lumenframe.operators import trigrams as G
from lumenframe.operators import upsert as U
from lumenframe.operators.settle import shared_folder
from lumenframe.plans import ingest as I
from lumenframe.plans.catalogue import _TRIGRAMS, _t, query

# --- awards in the order of a file --------------------------------------------------------------------------------------------------

#: Parts as films and as award rows. A row's director is one of 40; its title is a part's name, a word of its type and, for some, an article.
_LAST = "'Étoile' || (p_partkey % 8)"
_TITLE = "CASE WHEN p_partkey % 4 = 0 THEN 'The ' ELSE '' END || p_name || ' of ' || p_type || ' ' || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' returns' WHEN 1 THEN '!' ELSE '' END"
_STEPS = f"""films AS (SELECT p_partkey AS id, p_partkey % 5 AS a, p_partkey % 8 AS b, {{trigrams}} AS t FROM (SELECT *, {_TITLE} AS title FROM part WHERE p_partkey % 10 = 0)),
    arriving AS (SELECT p_partkey AS row_id, p_partkey % 5 AS a, p_partkey % 8 AS b, title, {{trigrams}} AS t, row_number() OVER (PARTITION BY p_partkey % 5, p_partkey % 8 ORDER BY p_partkey) AS n FROM (SELECT *, {_TITLE} AS title FROM part WHERE p_partkey % 10 <> 0)),
    steps AS (SELECT a, b, 0::BIGINT AS n, NULL::BIGINT AS row_id, NULL::STRUCT(s DOUBLE, r BIGINT) AS best, coalesce((SELECT list({{{{'id': -1000000000 + f.id, 't': f.t}}}}) FROM films f WHERE f.a = x.a AND f.b = x.b), []) AS there FROM (SELECT DISTINCT a, b FROM arriving) x
      UNION ALL SELECT a, b, n, row_id, best, CASE WHEN best IS NULL THEN list_append(there, {{{{'id': row_id, 't': t}}}}) ELSE there END FROM (
        SELECT s.a, s.b, r.n, r.row_id, r.t, s.there, list_max(list_filter(list_transform(s.there, lambda f: {{{{'s': len(list_intersect(f.t, r.t))::DOUBLE / len(list_distinct(list_concat(f.t, r.t))), 'r': -f.id}}}}), lambda m: m.s > 0.8)) AS best
        FROM steps s JOIN arriving r ON r.a = s.a AND r.b = s.b AND r.n = s.n + 1)),
    placed AS (SELECT row_id, CASE WHEN -best.r < 0 THEN 1000000000 - best.r END AS film_id, CASE WHEN best IS NULL THEN row_id WHEN -best.r >= 0 THEN -best.r END AS founder, best.s AS score FROM steps WHERE row_id IS NOT NULL)"""
_STEPS = _STEPS.replace("{{", "{").replace("}}", "}").replace("{trigrams}", _TRIGRAMS.format("title")).replace("{{", "{").replace("}}", "}")


def _title() -> Column:
    k = F.col("p_partkey")
    return F.concat(F.when(k % 4 == 0, "The ").otherwise(""), "p_name", F.lit(" of "), "p_type", F.lit(" "), "p_brand", F.when(k % 3 == 0, " returns").when(k % 3 == 1, "!").otherwise(""))


def _first() -> Column:
    return F.element_at(F.array(*map(F.lit, ("Agnès", "Zoé", "Maï", "Éric", "Ana"))), (F.col("p_partkey") % 5 + 1).cast("int"))


def _last() -> Column:
    return F.concat(F.lit("Étoile"), (F.col("p_partkey") % 8).cast("string"))


@query(f"WITH RECURSIVE {_STEPS} SELECT row_id, film_id::BIGINT AS film_id, founder::BIGINT AS founder, round(score, 6) AS score FROM placed")
def award_rows_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Award rows one after another: each joins its director's most similar film, given or founded by an earlier row, or founds one."""
    part = _t(spark, d, "part")
    films = part.where("p_partkey % 10 = 0")
    rows = part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("row_id"), _title().alias("title"), F.concat_ws(" ", F.upper(_first()), F.lit("M."), _last()).alias("director"))
    found = G.arrivals(rows, films.select(F.col("p_partkey").alias("id"), _title().alias("original_name")), films.select(F.col("p_partkey").alias("film_id"), _first().alias("first_name"), _last().alias("last_name")))
    return found.select("row_id", "film_id", "founder", F.round("score", 6).alias("score"))


def _film_rows(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The fifteen tables with every tenth part a film of a director of its own name."""
    t = {n: schema.create(spark, n) for n in schema.DDL}
    films = _t(spark, d, "part").where("p_partkey % 10 = 0")
    k = F.col("p_partkey").cast("int")
    people = films.select((F.col("p_partkey") % 40).cast("int").alias("id"), _first().alias("first_name"), _last().alias("last_name")).distinct()
    t["films"] = t["films"].unionByName(films.select(k.alias("id"), _title().alias("original_name")), allowMissingColumns=True)
    t["roles"] = spark.createDataFrame([(1, "director", "Réalisateur", True, None)], "id int, name string, allocine_name string, is_key_role boolean, inclusive_name string")
    t["credit_holders"] = t["credit_holders"].unionByName(people.select("id", F.lit("Individual").alias("type"), "first_name", "last_name", F.lit("unknown").alias("gender")), allowMissingColumns=True)
    t["film_credits"] = films.select(k.alias("id"), k.alias("film_id"), F.lit(1).alias("role_id"), (F.col("p_partkey") % 40).cast("int").alias("credit_holder_id"))
    return t


_YEAR = "1990 + (row_id // 7) % 30"


@query(
    f"""WITH RECURSIVE {_STEPS}, titled AS (SELECT p.*, a.title FROM placed p JOIN arriving a USING (row_id)),
    named AS (SELECT row_id, coalesce((SELECT title FROM arriving r WHERE r.row_id = f.founder), (SELECT {_TITLE} FROM part WHERE p_partkey = f.film_id)) AS film, coalesce(f.founder, -1000000000 + f.film_id) AS film_key, CASE row_id % 3 WHEN 0 THEN 'Fest A' ELSE 'Fest B' END AS festival, 'Prix ' || (row_id % 2) AS award, {_YEAR} AS year, row_id % 5 = 0 AS is_winner FROM titled f)
    SELECT film, festival, award, year::INT AS year, is_winner FROM (SELECT *, row_number() OVER (PARTITION BY film_key, festival, award ORDER BY row_id) AS n FROM named) WHERE n = 1"""
)
def ingest_awards(spark: SparkSession, d: str) -> DataFrame:
    """Award rows taken into the film tables: each film's first nomination for an award, in the order of the rows."""
    k = F.col("p_partkey")
    raw = _t(spark, d, "part").where("p_partkey % 10 <> 0").select(
        k.alias("row_id"), _title().alias("title"), F.concat_ws(" ", F.upper(_first()), F.lit("M."), _last()).alias("director"), F.lit("France").alias("country"), F.when(k % 3 == 0, "FEST A").otherwise("fest b").alias("festival"),
        (F.lit(1990) + F.floor(k / 7) % 30).cast("string").alias("year"), F.when(k % 5 == 0, "Lauréat").otherwise("Nommé").alias("distinction"), F.concat(F.lit("Prix "), (k % 2).cast("string")).alias("reward"),
    )
    known = spark.createDataFrame([("Fest A", "a", "i", "France"), ("Fest B", "b", "i", "Italie")], "name string, description string, image_base64 string, country string")
    t, _ = I.awards(_film_rows(spark, d), raw, known)
    films = t["films"].select(F.col("id").alias("film_id"), F.col("original_name").alias("film"))
    festivals = t["festivals"].select(F.col("id").alias("festival_id"), F.col("name").alias("festival"))
    labels = t["festival_awards"].select(F.col("id").alias("award_id"), F.col("mubi_label").alias("award"), "festival_id").join(festivals, "festival_id")
    return t["award_nominations"].join(films, "film_id").join(labels, "award_id").select("film", "festival", "award", F.year("date").alias("year"), "is_winner")


# --- the trigram index --------------------------------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))


_LABEL = "p_name || ' ' || p_type || ' ' || p_brand"


def _indexed(spark: SparkSession, d: str) -> str:
    root = T.fresh_root(spark)
    T.build(spark, root, _labels(spark, d))
    return root


@query(f"SELECT p_partkey AS id, {_LABEL} AS name FROM part WHERE {_LABEL} ILIKE '%red ring%ind%' OR {_LABEL} ILIKE '%brand#1_%'")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold a text, found by intersecting postings of its rarest trigrams."""
    root = _indexed(spark, d)
    return T.holding(spark, root, "red ring%ind").unionByName(T.holding(spark, root, "BRAND#1_")).distinct()


@query(
    f"""WITH q AS (SELECT DISTINCT p_name || ' ' || p_brand AS text, {_TRIGRAMS.format("p_name || ' ' || p_brand")} AS t FROM part), n AS (SELECT p_partkey AS id, {_LABEL} AS name, {_TRIGRAMS.format(_LABEL)} AS t FROM part),
    s AS (SELECT q.text, n.id, len(list_intersect(q.t, n.t))::DOUBLE / len(list_distinct(list_concat(q.t, n.t))) AS score FROM (SELECT any_value(text) AS text, list_sort(t) AS k, any_value(t) AS t FROM q GROUP BY text, k) q JOIN (SELECT id, t FROM n) n ON len(list_intersect(q.t, n.t)) > 0.8 * greatest(len(q.t), len(n.t)))
    SELECT text, id, round(score, 6) AS score FROM s WHERE score > 0.8"""
)
def indexed_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Names that resemble each of many texts by more than 0.8, by way of the postings of each text's rarest trigrams."""
    queries = _t(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return T.resembling(spark, _indexed(spark, d), queries).select("text", "id", F.round("score", 6).alias("score"))


@query(
    f"""WITH now AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'new ' || p_brand || ' ' || p_name ELSE {_LABEL} END AS name FROM part WHERE p_partkey % 11 <> 3 UNION ALL SELECT p_partkey + 100000000, 'added ' || p_name FROM part WHERE p_partkey % 13 = 0)
    SELECT id, name FROM now WHERE name ILIKE '%new brand#2%' OR name ILIKE '%added blue%' OR name ILIKE '%small ring econ%'"""
)
def indexed_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """A search after names were changed, added and taken out, and the index was compacted between: what was is not found, what is, is."""
    root, k = _indexed(spark, d), F.col("p_partkey")
    part = _t(spark, d, "part")
    T.change(spark, root, part.where("p_partkey % 7 = 0 and p_partkey % 11 <> 3").select(k.alias("id"), F.concat_ws(" ", F.lit("new"), "p_brand", "p_name").alias("name")), part.where("p_partkey % 11 = 3").select(k.alias("id")))
    T.compact(spark, root)
    T.change(spark, root, part.where("p_partkey % 13 = 0").select((k + 100000000).alias("id"), F.concat_ws(" ", F.lit("added"), "p_name").alias("name")))
    return reduce(lambda a, b: a.unionByName(b), [T.holding(spark, root, x) for x in ("new brand#2", "added blue", "small ring econ")])


# --- commits and cascades -----------------------------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END)::DOUBLE AS c_acctbal, coalesce(n, 0)::BIGINT AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
    UNION ALL SELECT c_custkey + 100000000, 0.0::DOUBLE, 0::BIGINT FROM customer WHERE c_custkey % 10 = 0"""
)
def committed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two writers change the same table at once: the one that comes second makes its change anew from what the first left, so that none is lost; a third
    changes another table and meets neither."""
    root = f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}/tables-{uuid.uuid4().hex}"
    customer = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    U.commit(spark, root, {"customer": customer, "counts": customer.limit(0).select("c_custkey", F.lit(0).cast("bigint").alias("orders"))})
    once: list[int] = []

    def second(tables):  # while it is at work the first one commits
        if not once:
            once.append(U.transaction(spark, root, lambda t: t | {"customer": t["customer"].withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))}))
        added = customer.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 100000000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
        return tables | {"customer": tables["customer"].unionByName(added)}

    since = U.version(spark, root)
    U.transaction(spark, root, second)
    U.commit(spark, root, {"counts": _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))}, since)
    now = U.current(spark, root)
    return now["customer"].join(now["counts"], "c_custkey", "left").select("c_custkey", "c_acctbal", F.coalesce("orders", F.lit(0)).alias("orders"))


_CHAIN = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]


@query(
    """WITH n AS (SELECT * FROM nation WHERE n_regionkey <> 2), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)), s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND l_suppkey IN (SELECT s_suppkey FROM s))
    SELECT 'region' AS "table", count(*) AS n, sum(r_regionkey)::BIGINT AS keys FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'nation', count(*), sum(n_nationkey)::BIGINT FROM n UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM c
    UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT FROM s UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM l"""
)
def cascaded_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of six tables after a region is deleted with all that refers to it, directly or by others."""
    names = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    tables = {n: _t(spark, d, n) for n in names}
    left = schema.deleted(tables, "region", tables["region"].where("r_regionkey = 2"), "r_regionkey", _CHAIN)
    return reduce(lambda a, b: a.unionByName(b), [left[n].agg(F.count("*").alias("n"), F.sum(F.col(k).cast("bigint")).alias("keys")).select(F.lit(n).alias("table"), "n", "keys") for n, k in names.items()])


# --- schema versions ------------------------------------------------------------------------------------------------------------------------

_HISTORY = [
    (1, "customer", schema.rename_column("c_mktsegment", "segment")),
    (2, "customer", schema.add_column("rating", "string")),
    (3, "customer", schema.change_type("c_acctbal", "string", "double")),
    (4, "customer", schema.drop_column("c_nationkey", "int")),
]


@query(
    """SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 1 THEN 'r' || c_nationkey WHEN c_custkey % 3 = 2 THEN 'new' END AS rating, CASE WHEN c_custkey % 3 = 2 THEN 'b' || c_nationkey END AS c_acctbal, 'newest' AS seen FROM customer
    UNION ALL SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 1 THEN 'r' || c_nationkey WHEN c_custkey % 3 = 2 THEN 'new' END, CASE WHEN c_custkey % 3 <> 2 THEN floor(c_acctbal)::INT::VARCHAR END, 'second' FROM customer"""
)
def mixed_schema_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table whose rows were written under three schema versions, read as the newest one has it, and as the second had it: renamed columns keep their values, retyped ones lose them."""
    root = f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}/versions-{uuid.uuid4().hex}"
    c, k = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), F.col("c_custkey") % 3
    nation = F.col("c_nationkey").cast("string")
    schema.append(spark, root, "customer", c.where(k == 0), 0, _HISTORY)
    second = schema.migrated(c.where(k == 1), "customer", 0, 2, _HISTORY).withColumn("rating", F.concat(F.lit("r"), nation))
    schema.append(spark, root, "customer", second, 2, _HISTORY)
    third = c.where(k == 2).select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit("new").alias("rating"), F.concat(F.lit("b"), nation).alias("c_acctbal"))
    schema.append(spark, root, "customer", third, None, _HISTORY)
    columns = ["c_custkey", "segment", "rating", "c_acctbal"]
    now = schema.stored(spark, root, "customer", None, _HISTORY).select(*columns, F.lit("newest").alias("seen"))
    then = schema.stored(spark, root, "customer", 2, _HISTORY).withColumn("c_acctbal", F.floor("c_acctbal").cast("int").cast("string"))
    return now.unionByName(then.select(*columns, F.lit("second").alias("seen")))


# --- the other ingests ------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT p_partkey, p_name, p_size, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_partkey % 500)::VARCHAR END AS visa FROM part),
    k AS (SELECT *, row_number() OVER (PARTITION BY visa ORDER BY 2000 + p_size % 20, 'T' || p_name) AS n FROM s WHERE visa IS NULL OR visa::INT >= 100)
    SELECT upper('T' || p_name)[1] || lower(substr('T' || p_name, 2)) AS film, visa, CASE WHEN p_size * 100000 < 2000000 THEN 'Moins de 2 M€' WHEN p_size * 100000 < 5000000 THEN '2 à 5 M€' ELSE '5 à 10 M€' END AS bucket, p_size % 2 = 0 AS eof, CASE WHEN p_size % 3 = 0 THEN 'Belgique=30;France=70' ELSE 'France=50' END AS shares,
    CASE WHEN p_size % 5 = 0 THEN 'Canal+;TF1' ELSE 'Arte' END AS paid_by FROM k WHERE visa IS NULL OR n = 1"""
)
def ingest_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Approval sheets (a part a row) taken into tables that hold a hundred visas, as one commit: the new films with their countries' shares and broadcasters."""
    root = f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}/films-{uuid.uuid4().hex}"
    part, s = _t(spark, d, "part"), F.col("p_size")
    t = {n: schema.create(spark, n) for n in schema.DDL}
    t["films"] = t["films"].unionByName(spark.range(100).select(F.col("id").cast("int").alias("id"), F.lit("old").alias("original_name"), F.col("id").cast("string").alias("visa_number")), allowMissingColumns=True)
    t["roles"] = spark.createDataFrame([(1, "paying_broadcaster", None, False, None), (2, "free_broadcaster", None, False, None)], "id int, name string, allocine_name string, is_key_role boolean, inclusive_name string")
    U.commit(spark, root, t)
    raw = part.select(
        F.when(s % 4 > 0, (F.col("p_partkey") % 500).cast("string")).alias("visa_number"), F.upper(F.concat(F.lit("T"), "p_name")).alias("original_name"), (s * 100000).cast("string").alias("budget"), F.when(s % 2 == 0, " x ").otherwise("non").alias("eof"), (2000 + s % 20).cast("string").alias("cnc_agrement_year"),
        F.when(s % 3 == 0, "FR-70 / BE-30 / XX").otherwise("FR-50").alias("film_country_budget_allocation_rates"), F.when(s % 5 == 0, "canal").alias("paying_broadcasters"), F.when(s % 5 == 0, "tf1").otherwise("arte").alias("free_broadcasters"),
    )
    I.run(spark, root, I.sheets, raw)
    now = U.current(spark, root)
    films = now["films"].where("original_name <> 'old'").select("id", F.col("original_name").alias("film"), F.col("visa_number").alias("visa"), F.col("budget_category").alias("bucket"), "eof")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ";")
    shares = now["film_country_budget_allocations"].join(now["countries"].select(F.col("id").alias("country_id"), "name"), "country_id").groupBy(F.col("film_id").alias("id")).agg(listed(F.concat("name", F.lit("="), F.col("budget_allocation").cast("int").cast("string"))).alias("shares"))
    paid = now["film_credits"].join(now["credit_holders"].select(F.col("id").alias("credit_holder_id"), "legal_name"), "credit_holder_id").groupBy(F.col("film_id").alias("id")).agg(listed("legal_name").alias("paid_by"))
    return films.join(shares, "id", "left").join(paid, "id", "left").drop("id")
