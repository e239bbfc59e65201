"""A crawl over stored pages: what is found is queued, fetched within a budget, parsed, and marked; a later run goes on where an earlier one stopped.

The state lies as tables of one commit (see upsert.commit) under a root: `queue` (url, depth: all that was ever found), `ledger` (url, depth, status: what was
tried) and `rows` (what the pages gave), each a set of files a round. A round writes only what is new in it and is one commit, so a run that is stopped at
any place has either done a round or not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import upsert as U
from lumenframe.operators.settle import settled

FOUND, EMPTY, MISSING = "found", "empty", "missing"


def resolved(base: Column, href: Column) -> Column:
    """An address that a page at `base` links to, without its fragment: absolute, from the host's root, or beside the page, with `.` and `..` taken out."""
    link = F.regexp_replace(F.trim(href), r"#.*$", "")
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][\w+.-]*://[^/?#]*", ""), r"[?#].*$", ""), r"[^/]*$", "")
    page = F.regexp_replace(base, r"[?#].*$", "")
    path = F.when(F.startswith(link, F.lit("/")), link).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link))
    bare, query = F.regexp_extract(path, r"^([^?]*)", 1), F.regexp_extract(path, r"(\?.*)$", 1)
    steps = F.aggregate(
        F.split(bare, "/"), F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s))),
    )
    last = F.when(bare.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return (
        F.when(link.rlike(r"^[A-Za-z][\w+.-]*:"), F.when(link.rlike("^(?i)https?://"), link)).when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(link == "", page).when(F.startswith(link, F.lit("?")), F.concat(page, link)).otherwise(F.concat(host, F.array_join(steps, "/"), last, query))
    )


def crawl(spark: SparkSession, root: str, pages: DataFrame, seeds: DataFrame, parse: Callable[[Column], Column], links: Callable[[Column], Column], budget: int | None = None, per_round: int | None = None, retry: bool = False) -> int:
    """Crawls pages (url, html) from seeds (url) on, and returns how many pages this run tried; rows, queue and ledger are under root.

    parse: a page's html -> array of structs, its rows; links: html -> array of addresses as they stand there. A round takes what is queued and not in the ledger, the
    nearest to the seeds first, `per_round` at most and as long as the run's `budget` lasts; what it finds is queued for the next. Pages that gave rows are
    marked found, others empty or missing; with `retry` those are tried again, once a run. It stops when nothing is left or the budget is spent.
    """
    tried, spent, asked = None, 0, seeds.select("url").where("url is not null").distinct()
    while budget is None or spent < budget:
        since = U.version(spark, root)
        t = U.current(spark, root, since)
        queue, ledger = _all(t, "queue", seeds, "depth int"), _all(t, "ledger", seeds, "depth int, status string")
        new = None
        if asked is not None:
            new = settled(_without(asked, queue).select("url", F.lit(0).alias("depth")))
            queue, asked = queue.unionByName(new), None
        left = _without(queue, ledger.where(F.col("status") == FOUND) if retry else ledger)
        if tried is not None:
            left = _without(left, tried)
        most = min((x for x in (per_round, None if budget is None else budget - spent) if x is not None), default=None)
        batch = left if most is None else left.orderBy("depth", "url").limit(most)
        got = settled(batch.hint("merge").join(pages.select("url", "html"), "url", "left").withColumn("__rows", parse(F.col("html"))).withColumn("__links", links(F.col("html"))))
        # of a page that is stored more than once any copy that gives rows counts
        rank = F.when(F.col("html").isNull(), 0).when(F.coalesce(F.size("__rows"), F.lit(0)) > 0, 2).otherwise(1)
        marks = got.groupBy("url").agg(F.min("depth").alias("depth"), F.element_at(F.array(*map(F.lit, (MISSING, EMPTY, FOUND))), F.max(rank) + 1).alias("status"))
        n = marks.count()
        if not n and (new is None or new.isEmpty()):
            break
        found = got.select((F.col("depth") + 1).alias("depth"), "url", F.explode("__links").alias("href")).select("depth", resolved(F.col("url"), F.col("href")).alias("url"))
        fresh = found.where("url is not null").groupBy("url").agg(F.min("depth").alias("depth"))
        fresh = _without(fresh, queue).select("url", "depth")
        made = {"queue": fresh if new is None else fresh.unionByName(new), "ledger": marks, "rows": got.select("url", F.inline("__rows"))}
        U.commit(spark, root, {f"{kind}.{since + 1:06d}": df for kind, df in made.items()}, since, t)
        tried = got.select("url") if tried is None else tried.unionByName(got.select("url"))
        spent += n
        if not n:
            break
    return spent


def _without(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows whose url is not among the known ones. Both grow with the crawl, so neither is ever sent to all by way of the driver."""
    return rows.join(known.select("url").hint("merge"), "url", "left_anti")


def _all(t: dict[str, DataFrame], kind: str, seeds: DataFrame, more: str) -> DataFrame:
    """All rounds' rows of a kind."""
    found = [df for name, df in sorted(t.items()) if name.startswith(f"{kind}.")]
    if not found:
        return seeds.sparkSession.createDataFrame([], f"url string, {more}")
    return reduce(lambda a, b: a.unionByName(b), found)


def results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue: url, depth; ledger: url, depth and the best status so far; rows: url and what the pages gave)."""
    t = U.current(spark, root)
    empty = spark.createDataFrame([], "url string")
    order = F.when(F.col("status") == FOUND, 2).when(F.col("status") == EMPTY, 1).otherwise(0)
    ledger = _all(t, "ledger", empty, "depth int, status string").groupBy("url").agg(F.min("depth").alias("depth"), F.max_by("status", order).alias("status"))
    return _all(t, "queue", empty, "depth int"), ledger, _all(t, "rows", empty, "none string")
