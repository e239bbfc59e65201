"""Names that resemble each other by trigrams: a join that compares few pairs, and matching in the order of a file.

Two sets of trigrams whose share of common ones exceeds t have one among any (n - ceil(t * n) + 1) of the first's n, and if both sides take theirs by one order,
among those of both. With the rarest first, common trigrams bring hardly any pairs together. Every pair that meets is compared exactly, so
the results are those of comparing all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.text import first_name, last_name, let, trigrams, unaccent, words_only
from lumenframe.operators.settle import settled
from lumenframe.operators.upsert import with_ids


#: Texts of the first batch that looks for founders.
FIRST = 8192


def least_shared(n: Column, threshold: float) -> Column:
    """How many of n trigrams another set must share to exceed the threshold."""
    return F.ceil(n * threshold - 1e-9).cast("int")


def exceeding(score: Column, threshold: float) -> Column:
    """The score of rows where it exceeds the threshold; other rows go. It is computed once a row, which a filter on it would not do."""
    return F.explode(F.filter(F.array(score), lambda s: s > threshold))


def _ranks(*texts: DataFrame) -> DataFrame:
    """(gram, rank): the trigrams of all texts (text), rarest first."""
    grams = None
    for df in texts:
        own = df.select(F.explode(trigrams(F.col("text"))).alias("gram"))
        grams = own if grams is None else grams.unionByName(own)
    counts = settled(grams.groupBy("gram").agg(F.count("*").alias("times")))
    return settled(with_ids(counts, counts.select(F.lit(0).alias("rank")).limit(0), ["times", "gram"], "rank").select("gram", "rank"))


def _ranked(texts: DataFrame, ranks: DataFrame) -> DataFrame:
    """texts (text and other columns, rows distinct) with g: each text's trigrams' ranks, rarest first. A text without trigrams goes."""
    kept = texts.columns
    ranked = texts.select(*kept, F.explode(trigrams(F.col("text"))).alias("gram")).join(ranks, "gram")
    return ranked.groupBy(*kept).agg(F.sort_array(F.collect_list("rank")).alias("g"))  # the trigrams of one text


def _heads(ranked: DataFrame, side: str, by: list[str], threshold: float) -> DataFrame:
    """(by, side, n, g, gram): a row for each of those trigrams of a text (named by the column `side`) of which one must be shared."""
    n = F.size("g")
    return ranked.select(*by, side, n.alias(f"n_{side}"), F.col("g").alias(f"g_{side}"), F.posexplode(F.slice("g", F.lit(1), n - least_shared(n, threshold) + 1)).alias(f"at_{side}", "gram"))


def _alike(a: DataFrame, b: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, a, g) and (by, b, g) -> (by, a, b, score) of the pairs within `by` whose similarity exceeds the threshold.

    A pair that meets on several trigrams counts on the rarest it shares, and is compared where it meets, so pairs that are not similar are never stored or sent.
    """
    fits = (F.col("n_b") >= least_shared(F.col("n_a"), threshold)) & (F.col("n_a") >= least_shared(F.col("n_b"), threshold))
    # of a pair's first shared trigram no shared one lies before it, so they share no more than what follows it in either, and it
    fits &= F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least_shared((F.col("n_a") + F.col("n_b")) / (1 + threshold), threshold)
    # ranks ascend, so the first shared one is the rarest
    score = let(F.array_intersect("g_a", "g_b"), lambda c: F.when(F.get(c, F.lit(0)) == F.col("gram"), F.size(c) / (F.col("n_a") + F.col("n_b") - F.size(c))))
    # few bytes meet in many pairs: the work is dealt out whatever its size
    n, at = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*by, "gram"]
    return _heads(a, "a", by, threshold).repartition(n, *at).join(_heads(b, "b", by, threshold).repartition(n, *at), at).where(fits).select(*by, "a", "b", exceeding(score, threshold).alias("score"))


def similar_pairs(a: DataFrame, b: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Distinct (by, text) of a and of b -> (by, a, b, score) of the pairs within `by` whose similarity exceeds the threshold. Null `by` meets nothing."""
    a, b = (df.select(*by, "text").where("text is not null").distinct() for df in (a, b))
    ranks = _ranks(a, b)
    return _alike(_ranked(a, ranks).withColumnRenamed("text", "a"), _ranked(b, ranks).withColumnRenamed("text", "b"), by, threshold)


def best_matches(wanted: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """Distinct texts of wanted -> (a, b, score): the most similar of names (text), ties by name, where that exceeds the threshold."""
    return similar_pairs(wanted, names, [], threshold).groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m")).select("a", "m.b", (-F.col("m.s")).alias("score"))


# --- in the order of a file -------------------------------------------------------------------------------------------------------------


def founders(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """texts (node), edges (earlier, later) -> the nodes that resemble no founder before them, the same as going through them one by one.

    By rounds: a node that no undecided one comes before is a founder; what resembles it is none, and its own edges go. A round settles at least the first
    undecided node of each chain, so there are as many rounds as the longest chain of nodes that wait for each other.
    """
    joined = None
    left = settled(edges.select("earlier", "later").distinct())
    while not left.isEmpty():
        heads = left.select(F.col("earlier").alias("node")).distinct().join(left.select(F.col("later").alias("node")).distinct(), "node", "left_anti")
        now = settled(left.join(heads.withColumnRenamed("node", "earlier"), "earlier", "left_semi").select(F.col("later").alias("node")).distinct())
        joined = now if joined is None else joined.unionByName(now)
        over = heads.unionByName(now)
        left = settled(left.join(now.withColumnRenamed("node", "later"), "later", "left_anti").join(over.withColumnRenamed("node", "earlier"), "earlier", "left_anti"))
    return texts if joined is None else texts.join(joined, "node", "left_anti")


def _founded(fresh: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """fresh (by, node, g) -> those of its rows that found a film, as if they came one by one in order of node.

    They come in batches, the first of some FIRST, each next three times as many as all before. A batch first meets the founders of those before; only what resembles none
    of them meets the rest of its batch. So the pairs are those of texts with founders, not those of all texts that resemble each other, which grow with the square.
    """
    shares, size, total = [], FIRST, fresh.count()
    while size < total:
        shares.append(size / total)
        size *= 4
    cuts = fresh.agg(F.percentile_approx("node", shares).alias("c")).first()["c"] if shares else []  # they steer cost only
    made, low = None, None
    for high in [*sorted(set(cuts or [])), None]:
        part = fresh.where((F.col("node") > low if low is not None else F.lit(True)) & (F.col("node") <= high if high is not None else F.lit(True)))
        if made is not None:
            part = settled(part.join(_alike(part.withColumnRenamed("node", "a"), made.withColumnRenamed("node", "b"), by, threshold).select(F.col("a").alias("node")).distinct(), "node", "left_anti"))
        edges = _alike(part.withColumnRenamed("node", "a"), part.withColumnRenamed("node", "b"), by, threshold).where("a < b").select(F.col("a").alias("earlier"), F.col("b").alias("later"))
        now = settled(part.join(founders(part.select("node"), edges), "node", "left_semi").select(*by, "node", "g"))
        made = now if made is None else made.unionByName(now)
        low = high
    return made


def arrivals(rows: DataFrame, films: DataFrame, directors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """rows (row_id, title, director) -> rows with film_id, founder and score, as if they came one by one in order of row_id.

    A row joins the most similar film among those of its director that are there when it comes: given ones (film_id; films: id, original_name;
    directors: film_id, first_name, last_name) and those founded by earlier rows (founder: that row's id). Of equally similar ones the given come first, then
    the least id. Where none exceeds the threshold the row founds a film: founder is its own row_id.

    The director's first and last token decide, without case and accents. A row without title or director, and one whose title has no letter or digit,
    resembles nothing and founds a film of its own. row_id must be unique.
    """
    key = lambda c: unaccent(F.lower(c))
    by = ["__first", "__last"]
    title = lambda c: words_only(key(F.col(c))).alias("text")
    wanted = settled(rows.select("row_id", key(first_name(F.col("director"))).alias("__first"), key(last_name(F.col("director"))).alias("__last"), title("title")))
    known = directors.select("film_id", key(F.col("first_name")).alias("__first"), key(F.col("last_name")).alias("__last")).join(films.select(F.col("id").alias("film_id"), title("original_name")), "film_id")
    known = settled(known.where("text is not null").groupBy(*by, "text").agg(F.min("film_id").alias("film_id")))  # of one title the least id wins
    usable = wanted.where(F.size(trigrams(F.col("text"))) > 0).where("__first is not null and __last is not null")
    titles = settled(usable.groupBy(*by, "text").agg(F.min("row_id").alias("node")))

    ranks = _ranks(titles, known)
    ranked, given = settled(_ranked(titles, ranks)), _ranked(known, ranks)
    asked = ranked.withColumnRenamed("node", "a")
    given = _alike(asked, given.withColumnRenamed("film_id", "b"), by, threshold)
    given = settled(given.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b").alias("id"))).alias("given")))
    made = _founded(settled(ranked.select(*by, "node", "g").join(given, "node", "left_anti")), by, threshold)

    # every row against the films that are there when it comes: of a title's films, in order of their founders, only those that are more similar than all before count
    new = _alike(asked, made.withColumnRenamed("node", "b"), by, threshold).select(F.col("a").alias("node"), F.col("b").alias("founder"), "score")
    before = F.max("score").over(Window.partitionBy("node").orderBy("founder").rowsBetween(Window.unboundedPreceding, -1))
    better = new.withColumn("__before", before).where("__before is null or score > __before")
    steps = better.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("founder").alias("id"), F.col("score").alias("s")))).alias("steps"))
    last = F.try_element_at(F.filter("steps", lambda x: x["id"] < F.col("row_id")), F.lit(-1))
    met = titles.join(given, "node", "left").join(steps, "node", "left")
    found = usable.join(met, [*by, "text"]).select("row_id", "given", F.struct((-last["s"]).alias("s"), last["id"].alias("id")).alias("new"))
    out = rows.join(found, "row_id", "left")
    # the given one wins ties
    takes = F.coalesce(F.col("given.s") <= F.col("new.s"), F.col("given").isNotNull())
    return out.withColumns({
        "film_id": F.when(takes, F.col("given.id")), "founder": F.when(~takes, F.coalesce(F.col("new.id"), F.col("row_id"))), "score": F.when(takes, -F.col("given.s")).otherwise(-F.col("new.s"))
    }).drop("given", "new")
