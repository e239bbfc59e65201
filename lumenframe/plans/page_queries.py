"""Queries over stored pages, crawls and append sinks, each beside the SQL that gives the same rows (see catalogue). Where the given pages lack the
elements, pages are made of the tables' rows, one a customer or part, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.settle import shared_folder
from lumenframe.plans.catalogue import _t, query
from lumenframe.sources import pages, sink
from lumenframe.streaming import crawl as C


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _page(rows: DataFrame, key: str, order: str, markup: Column) -> DataFrame:
    """A page for each key, holding its rows' markup in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), markup.alias("m")))), lambda e: e["m"])
    return rows.groupBy(key).agg(F.concat(F.lit("<html><body><div class=\"list\">"), F.array_join(listed, "\n"), F.lit("</div></body></html>")).alias("html"))


@query(
    """SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS i, 'Film ' || o_orderkey AS title, o_orderpriority AS director, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS country, '/films/' || o_orderkey AS link FROM orders"""
)
def edition_films(spark: SparkSession, d: str) -> DataFrame:
    """Films of a festival's edition (a customer's orders) from its page: title, director, country and link of each entry, with elements of the same tag inside."""
    o = F.col("o_orderkey")
    entry = F.concat(
        F.lit('<div class="x film"><h3> Film <b>'), o.cast("string"), F.lit('</b></h3><div class="box"><div>by</div><span class="by">'), F.col("o_orderpriority"), F.lit("</span></div>"),
        F.when(o % 4 > 0, F.concat(F.lit('<span class="land">'), "o_orderstatus", F.lit("</span>"))).otherwise(F.lit("")), F.lit('<a class="more" href="/films/'), o.cast("string"), F.lit('">more</a></div>'),
    )
    made = _page(_t(spark, d, "orders"), "o_custkey", "o_orderkey", entry)
    found = pages.records(F.col("html"), "div", "film", {"title": ("h3", None), "director": ("span", "by"), "country": ("span", "land"), "link": ("a", "@href")})
    return made.select("o_custkey", F.posexplode(found).alias("i", "f")).select("o_custkey", "i", "f.*")


@query("SELECT o_custkey, 'Fest ' || (o_orderkey % 5) AS festival, year(o_orderdate)::VARCHAR AS year, CASE WHEN o_orderstatus = 'F' THEN 'Lauréat' END AS distinction, o_orderpriority AS award FROM orders")
def film_awards(spark: SparkSession, d: str) -> DataFrame:
    """Awards of a film (a customer's orders) from its page: festival, year, distinction and award of each entry."""
    text = F.concat(F.year("o_orderdate").cast("string"), F.lit(" | "), F.when(F.col("o_orderstatus") == "F", "Lauréat : ").otherwise(""), "o_orderpriority")
    entry = F.concat(F.lit('<li class="award"><h4>Fest '), (F.col("o_orderkey") % 5).cast("string"), F.lit('</h4><p class="r">'), text, F.lit("</p></li>"))
    made = _page(_t(spark, d, "orders"), "o_custkey", "o_orderkey", entry)
    found = pages.awards(F.col("html"), "li", "award", ("h4", None), ("p", "r"))
    return made.select("o_custkey", F.explode(found).alias("a")).select("o_custkey", "a.*")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN (100000 + p_partkey)::VARCHAR END AS visa, 'p' || p_partkey || '.jpg' AS poster, p_size || ' mai 2001' AS date, (p_size % 3) || 'h' || lpad((p_size % 60)::VARCHAR, 2, '0') || 'min' AS duration, lower(p_type) || '|drame' AS genres,
    CASE p_size % 3 WHEN 0 THEN 's' WHEN 1 THEN 'm' ELSE 'l' END || p_partkey AS trailer, p_brand || ' A|' || p_name || ' B' AS directors, CASE WHEN p_size % 2 = 0 THEN 'Production=producer:' || p_name ELSE 'Production=;Soundtrack=composer:' || p_brand END AS credits FROM part"""
)
def film_pages(spark: SparkSession, d: str) -> DataFrame:
    """Film and casting pages (a part each): visa, poster, date, duration, genres and the best trailer; directors, and the credits of each section."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    t = F.lit
    model = F.concat(t('{&quot;videos&quot;:[{&quot;sources&quot;:{'), F.when(s % 3 == 0, F.concat(t("&quot;standard&quot;:&quot;s"), k, t("&quot;,&quot;low&quot;:&quot;l&quot;"))).when(s % 3 == 1, F.concat(t("&quot;medium&quot;:&quot;m"), k, t("&quot;"))).otherwise(F.concat(t("&quot;low&quot;:&quot;l"), k, t("&quot;"))), t("}}]}"))
    film = F.concat(
        t('<img class="poster" src="p'), k, t('.jpg"><div class="meta">'), s.cast("string"), t(" mai 2001 | "), (s % 3).cast("string"), t("h "), F.lpad((s % 60).cast("string"), 2, "0"), t('min | x</div><span class="date">'), s.cast("string"), t(' mai 2001</span><span class="g">'),
        F.lower("p_type"), t('</span><span class="g">drame</span><div class="item"><span class="what">Pays</span><span class="that">FR</span></div>'), F.when(s % 5 > 0, F.concat(t('<div class="item"><span class="what">N° de Visa</span><span class="that">'), (F.col("p_partkey") + 100000).cast("string"), t("</span></div>"))).otherwise(t("")),
        t('<figure class="player" data-model="'), model, t('"></figure>'),
    )
    one = lambda role, name: F.concat(t('<div class="c"><span class="r">'), role, t('</span><a>'), name, t("</a></div>"))
    section = lambda title, body: F.concat(t('<section class="part"><h2>'), t(title), t("</h2>"), body, t("</section>"))
    cast = F.concat(t('<section class="dir"><b>'), "p_brand", t(" A</b><b>"), "p_name", t(" B</b></section>"), F.when(s % 2 == 0, section("Production", one(t("producer"), F.col("p_name")))).otherwise(F.concat(section("Production", t("<p>none</p>")), section("Soundtrack", one(t("composer"), F.col("p_brand"))))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a part is few bytes and its pages much work
    made = _t(spark, d, "part").repartition(n, "p_partkey").select("p_partkey", film.alias("film"), cast.alias("cast"))
    f = pages.film_page(F.col("film"), ("img", "poster"), ("span", "date"), ("div", "meta"), ("span", "g"))
    people = pages.people(F.col("cast"), ("section", "dir"), ("b", None))
    sections = pages.cast_sections(F.col("cast"), "part", ("h2", None), ("div", "c"), [("span", "r")], [("a", None)])
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("sections")), lambda e: F.concat(e["key"], t("="), F.array_join(F.transform(e["value"], lambda c: F.concat(c["role"], t(":"), c["name"])), ","))), ";")
    got = made.select("p_partkey", f.alias("f"), people.alias("people"), sections.alias("sections"))
    return got.select("p_partkey", F.col("f.allocine_visa_number").alias("visa"), F.col("f.poster_url").alias("poster"), F.col("f.release_date").alias("date"), F.col("f.duration").alias("duration"), F.array_join("f.genres", "|").alias("genres"), F.col("f.trailer_url").alias("trailer"), F.array_join("people", "|").alias("directors"), listed.alias("credits"))


@query(
    r"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), edge AS (SELECT p_partkey AS a, (p_partkey * 2 + 1) % n AS b FROM part, n WHERE p_partkey % 17 <> 3 UNION SELECT p_partkey, (p_partkey * 31 + 11) % n FROM part, n WHERE p_partkey % 17 <> 3 UNION SELECT p_partkey, (p_partkey * 7 + p_size) % n FROM part, n WHERE p_size % 3 = 0 AND p_partkey % 17 <> 3),
    reach AS (SELECT p_partkey AS k, 0 AS depth FROM part WHERE p_partkey % 100 = 5 UNION SELECT b, depth + 1 FROM reach JOIN edge ON a = k WHERE depth < 20), nearest AS (SELECT k, min(depth) AS depth FROM reach GROUP BY 1)
    SELECT 'http://films.example/p/' || k AS url, depth::INT AS depth, CASE WHEN p_partkey IS NULL OR k % 17 = 3 THEN 'missing' WHEN p_size % 4 = 0 THEN 'empty' ELSE 'found' END AS status, CASE WHEN k % 17 <> 3 AND p_size % 4 > 0 THEN p_name END AS title FROM nearest LEFT JOIN part ON p_partkey = k"""
)
def crawled_pages(spark: SparkSession, d: str) -> DataFrame:
    """A crawl from a few pages on over pages (a part each) that link to others beside them, from the root, in full and to places that are missing, to its end:
    every page that it reached, how far it is, and what it gave."""
    part = _t(spark, d, "part")
    n = part.count()
    k, s = F.col("p_partkey"), F.col("p_size")
    to = lambda x: (x % n).cast("string")
    markup = F.concat(
        F.when(s % 4 > 0, F.concat(F.lit('<h1 class="t">'), "p_name", F.lit("</h1>"))).otherwise(F.lit("<h2>none</h2>")), F.lit('<a href="'), F.when(k % 2 == 0, F.lit("../p/./")).otherwise(F.lit("/p/")), to(k * 2 + 1), F.lit('#top">next</a><a href="mailto:x@y.example">write</a><a href="//films.example/p/'), to(k * 31 + 11), F.lit('">other</a>'),
        F.when(s % 3 == 0, F.concat(F.lit('<a href="http://films.example/p/'), to(k * 7 + s), F.lit('">more</a>'))).otherwise(F.lit("")),
    )
    stored = part.where("p_partkey % 17 <> 3").select(F.concat(F.lit("http://films.example/p/"), k.cast("string")).alias("url"), markup.alias("html"))
    seeds = part.where("p_partkey % 100 = 5").select(F.concat(F.lit("http://films.example/p/"), k.cast("string")).alias("url"))
    root = _root(spark, "crawl")
    parse = lambda h: F.transform(pages.element_texts(h, "h1", "t"), lambda x: F.struct(x.alias("title")))
    hrefs = lambda h: F.transform(pages.links(h), lambda l: l["href"])
    C.crawl(spark, root, stored, seeds, parse, hrefs)
    _, ledger, rows = C.results(spark, root)
    return ledger.join(rows.hint("merge"), "url", "left").select("url", "depth", "status", "title")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def appended_once(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a delimited sink in four batches, some of them twice, as after a restart: each row is there once, under one header."""
    events, path = _t(spark, d, "events"), _root(spark, "sink")
    for batch in (0, 1, 1, 2, 0, 3, 2):
        sink.append(events.where(F.col("event_id") % 4 == batch), path, batch, "csv")
    return sink.rows(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.col("event_id")).alias("ids"), F.sum(F.col("user_id").cast("bigint")).alias("users"))
