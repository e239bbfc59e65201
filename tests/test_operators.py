"""Metrics, resolution, upserts, vision, ledgers and sources on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import schema as S
from lumenframe.functions.names import jaro_winkler_of
from lumenframe.operators import metrics as M
from lumenframe.operators import resolve as R
from lumenframe.operators import upsert as U
from lumenframe.operators import pivots
from lumenframe.operators import vision as V
from lumenframe.sources import files, pages
from lumenframe.streaming import ledger


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_percent_rounds_half_to_even_in_the_set_order(spark):
    df = spark.createDataFrame([(1, 8), (23, 40), (0, 0)], "a bigint, b bigint")
    assert [r[0] for r in df.select(M.percent(F.col("a"), F.col("b"))).collect()] == [12.0, 57.0, None]


def test_screen_and_poster_sums(spark):
    df = spark.createDataFrame([(1, "Female", "White", 6.5), (1, "male", "Black", None), (2, "male", "", 3.0), (3, "female", None, None)], "f int, g string, e string, t double")
    got = rows(df.groupBy("f").agg(M.female_time(F.col("g"), F.col("t")), M.non_white_time(F.col("e"), F.col("t")), M.female_poster_share(F.col("g"), F.col("t"))))
    assert got == [(1, 6.5, 0.0, 650.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)]


def test_mode_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b"), (2, 1, "c")], "k int, at int, v string")
    assert rows(M.mode_first_seen(df, ["k"], "v", "at")) == [(1, "b"), (2, "c")]


def test_fuzzy_join_loses_no_pair(spark):
    names = ["Jean Dupont", "Dupont Jean", "Jean Dupond", "Anne", "Anna", "Ann", "Marie-Claire", "marie claire", "Zoé", "zoe", "", "X"]
    rng = np.random.default_rng(8)
    names += ["".join(rng.choice(list("abc "), rng.integers(1, 13))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    norm = lambda s: " ".join(sorted("".join(c for c in s if c.isalnum() or c.isspace()).lower().split()))

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    for t in (0.9, 0.75, 0.6, 0.3):
        want = {(a, b) for a, b in itertools.product(names, names) if norm(a) and norm(b) and (1 - lev(norm(a), norm(b)) / max(len(norm(a)), len(norm(b))) + jaro_winkler_of(norm(a), norm(b))) / 2 >= t}
        got = R.fuzzy_join(df.withColumnRenamed("name", "a"), df.withColumnRenamed("name", "b"), "a", "b", t)
        assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_best_film_needs_the_director_and_a_strict_threshold(spark):
    films = spark.createDataFrame([(1, "La Vie en rose"), (2, "La vie en noir"), (3, "Autre")], "id int, original_name string")
    directors = spark.createDataFrame([(1, "Hélène", "X"), (2, "Hélène", "X"), (3, "Y", "")], "film_id int, first_name string, last_name string")
    wanted = spark.createDataFrame([(1, "la vie en Rosé", "helene x"), (2, "Autre", "helene x"), (3, "autre", "y"), (4, "La Vie en Rose", " HELENE  Maria\tX ")], "row_id int, title string, director string")
    assert [(r["row_id"], r["film_id"]) for r in R.best_film(wanted, films, directors).orderBy("row_id").collect()] == [(1, 1), (2, None), (3, 3), (4, 1)]


def test_best_film_compares_each_title_of_a_director_once(spark, monkeypatch):
    compared = []
    own = R.similar_pairs
    monkeypatch.setattr(R, "similar_pairs", lambda a, b, by, t: compared.append((a.select(*by, "text").distinct().count(), b.count())) or own(a, b, by, t))
    films = spark.createDataFrame([(i, "Long Night" + "!" * (i % 3)) for i in range(2, 60)], "id int, original_name string")
    directors = films.select(F.col("id").alias("film_id"), F.lit("Éva").alias("first_name"), F.lit("Noir").alias("last_name"))
    rows = spark.createDataFrame([(i, "the long night" if i % 2 else "LONG, night", "eva B. noir") for i in range(50)], "row_id int, title string, director string")
    got = R.best_film(rows, films, directors, 0.6).collect()
    assert compared == [(2, 1)] and {(r["film_id"], r["row_id"] % 2, round(r["score"], 6)) for r in got} == {(2, 0, 1.0), (2, 1, round(11 / 15, 6))} and len(got) == 50


def test_find_or_create_gives_gapless_ids_and_matches_nulls(spark):
    old = spark.createDataFrame([(4, "a", None)], "id int, n string, m string")
    new = spark.createDataFrame([("a", None), ("b", None), ("b", None), ("a", "x")], "n string, m string")
    got = U.find_or_create(old, new, ["n", "m"])
    assert rows(got.select("n", "m")) == sorted([("a", None), ("a", "x"), ("b", None)], key=repr) and sorted(r["id"] for r in got.collect()) == [4, 5, 6]


def test_update_reload_and_delete(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "k int, v string, w int")
    assert rows(U.create_or_update(old, new, ["k"])) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    assert rows(U.update(old, new, ["k"])) == [(1, "a", 1), (2, "b", 5)]
    once = U.reload(old, new, ["k"])
    assert rows(once) == rows(U.reload(once, new, ["k"])) == [(1, "a", 1), (2, None, 5), (3, "c", None)]
    assert rows(U.delete_where(old, new, ["k"])) == [(1, "a", 1)]


def test_replace_swaps_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        U.replace(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    U.replace(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"] and spark.read.parquet(path).count() == 2


def test_classify_logits(spark):
    logits = [float(x) for x in (0, 9, 0, 0, 0, 0, 0, 1, 2, 0, 0, 0, 5, 0, 0, 0, 0, 0)]
    r = spark.createDataFrame([(logits,)], "l array<double>").select(V.classify(F.col("l")).alias("c"), V.softmax(F.slice("l", 8, 2)).alias("s")).first()
    assert tuple(r["c"]) == ("Black", "Female", "20-29") and sum(r["s"]) == pytest.approx(1) and r["s"][1] == pytest.approx(np.e / (1 + np.e))
    ages = spark.createDataFrame([("20-29",), ("70+",), (None,)], "a string").select(V.age_bounds(F.col("a")).alias("b")).collect()
    assert [tuple(a["b"]) for a in ages] == [(20, 29), (70, None), (None, None)]


def by_rounds(nodes, links, seed, coins, rounds=100):
    """The rounds of whispers in plain Python; coins: (round, node) -> 0 or 1."""
    labels, near = {n: n for n in nodes}, {n: [b for a, b in links if a == n] for n in nodes}
    for r in range(rounds):
        wants = {}
        for n in nodes:
            counts = {}
            for m in near[n]:
                counts[labels[m]] = counts.get(labels[m], 0) + 1
            if counts and max(counts.values()) > counts.get(labels[n], 0):
                wants[n] = min(k for k, c in counts.items() if c == max(counts.values()))
        if not wants:
            return labels, r, True
        labels |= {n: to for n, to in wants.items() if coins[r, n]}
    return labels, rounds, False


@pytest.mark.parametrize("seed", [0, 5])
def test_whispers_equal_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = list(range(40))
    pairs = {(a, b) for a in range(36) for b in range(36) if a != b and (a // 9 == b // 9 and rng.random() < 0.7 or rng.random() < 0.03)} | {(36, 37), (37, 36)}
    links = sorted(pairs | {(b, a) for a, b in pairs})
    coins = {(r["r"], r["n"]): r["c"] for r in spark.range(40).select(F.col("id").alias("n")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(30)))).select("r", "n", F.xxhash64(F.lit(seed), F.col("r"), "n").bitwiseAND(1).alias("c")).collect()}
    got, n, rest = V.whispers(spark.createDataFrame([(i,) for i in nodes], "node long"), spark.createDataFrame(links, "a long, b long").repartition(3), seed, 30)
    want, m, still = by_rounds(nodes, links, seed, coins, 30)
    assert ({r["node"]: r["label"] for r in got.collect()}, n, rest) == (want, m, still)


def test_whispers_pass_between_first_twins_only(spark, monkeypatch):
    """Two groups of copies and some faces beside them: rounds meet links between first twins, not the square of a group, and labels are those of going over all links."""
    nodes = list(range(70))
    pairs = {(a, b) for g in (range(30), range(30, 60)) for a in g for b in g if a != b} | {(a, b) for a in range(28, 34) for b in range(60, 64)} | {(64, 65)}
    links = sorted(pairs | {(b, a) for a, b in pairs})
    coins = {(r["r"], r["n"]): r["c"] for r in spark.range(70).select(F.col("id").alias("n")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(30)))).select("r", "n", F.xxhash64(F.lit(3), F.col("r"), "n").bitwiseAND(1).alias("c")).collect()}
    written = []

    def noted(df, settled=V.settled):
        written.append(settled(df))
        return written[-1]

    monkeypatch.setattr(V, "settled", noted)
    got, n, rest = V.whispers(spark.createDataFrame([(i,) for i in nodes], "node long"), spark.createDataFrame(links, "a long, b long"), 3, 30)
    assert ({r["node"]: r["label"] for r in got.collect()}, n, rest) == by_rounds(nodes, links, 3, coins, 30)
    passed = [df.count() for df in written if df.columns == ["a", "b"]]
    assert passed[-1] < 80 < 1700 < passed[0] == len(links)


def test_comparing_takes_no_distance_where_none_is_asked_for(spark):
    """Pairs within a radius, with and without their distances, copies and pairs at the radius itself among them, are those of comparing all."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 5)), 40, axis=0), rng.normal(size=(60, 5)), [[9, 0, 0, 0, 0], [9, 0.5, 0, 0, 0], [9, 0.4999999999, 0, 0, 0]]])
    points = spark.createDataFrame([(i, f"l{i % 3}", v.tolist()) for i, v in enumerate(x)], "point_id long, label string, vector array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and d[i, j] < 0.5}
    assert (100, 101) not in want and (100, 102) in want
    plain = [tuple(r) for r in pivots.within(points, 0.5, distance=False).collect()]
    full = pivots.within(points, 0.5).collect()
    assert set(plain) == want and len(plain) == len(want) == len(full)
    assert {(r["query_id"], r["point_id"], r["label"], round(r["distance"], 12)) for r in full} == {(i, j, f"l{j % 3}", round(d[i, j], 12)) for i, j in want}


def test_clusters_within_films(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.01, (15, 4)) for c in (0, 5, 9)])
    rows = [(film, i, v.tolist()) for film in ("a", "b") for i, v in enumerate(x)]  # the same faces, with the same ids, in two films
    got = V.clusters(spark.createDataFrame(rows, "film string, id int, e array<double>").repartition(3), "film", "id", "e").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["label"], set()).add((r["film"], r["id"] // 15))
    assert len(got) == 90 and len(groups) == 6 and all(len(g) == 1 for g in groups.values()) and all(r["settled"] for r in got)


def test_clusters_of_few_faces_go(spark):
    faces = spark.createDataFrame([(1, lab, i, "20-29", "Male", "White", 0, 0, 2, 3) for i, lab in enumerate([7] * 3 + [8] * 2 + [9] * 4)], "film int, label int, id int, age string, gender string, ethnicity string, x1 int, y1 int, x2 int, y2 int")
    got = V.aggregate_clusters(faces, "film", "id", 2).orderBy("label").collect()
    assert [(r["label"], r["occurence"], r["area_occupied"], r["persons_id"]) for r in got] == [(0, 3, 18, [0, 1, 2]), (1, 4, 24, [5, 6, 7, 8])]


def test_pages(spark):
    html = '<title> T </title><div class="x award"><a class="f">Fest</a><div2>z</div2><p class="r">2023 | Lauréat : Prix</p></div><a href="/film/fichearticle_gen_carticle=1.html">no</a><a href="/film/fichefilm_gen_cfilm=42.html">Yes <b>1</b></a>'
    df = spark.createDataFrame([(html,), ("",), (None,)], "h string")
    got = df.select(pages.title(F.col("h")).alias("t"), pages.first_film(F.col("h")).alias("f"), pages.awards(F.col("h"), "div", "award", ("a", "f"), ("p", "r")).alias("a")).collect()
    assert got[0]["t"] == "T" and tuple(got[0]["f"]) == (42, "Yes 1", "/film/fichefilm_gen_cfilm=42.html") and [tuple(x) for x in got[0]["a"]] == [("Fest", "2023", "Lauréat", "Prix")]
    assert got[1]["t"] is None and got[1]["f"] is None and got[2]["f"] is None


def test_trailer_quality_and_duration_cell(spark):
    df = spark.createDataFrame([('{"videos":[{"sources":{"low":"l","high":"h"}}]}', "x | 1h 45min | y")], "m string, d string")
    assert tuple(df.select(pages.trailer_url(F.col("m")), pages.duration_cell(F.col("d"))).first()) == ("h", "1h45min")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "é"])], "n string, l array<string>")
    path = str(tmp_path / "c")
    for _ in range(2):
        files.append_csv(files.as_json_cells(df), path)
    assert rows(files.text_csv(spark, path, ["n", "l"])) == [("a", '["x","é"]')] * 2
    assert files.drop_empty_columns(spark.createDataFrame([(1, None)], "a int, b string")).columns == ["a"]
    assert files.crawl_plan(spark, 2000, 2001, 1, 3).count() == 6
    with pytest.raises(ValueError):
        files.media(spark, path, "song")
    assert sorted(r["batch"] for r in files.batches(spark.range(25), "id", 10).collect()) == [0] * 10 + [1] * 10 + [2] * 5


def test_ledger_and_stream(spark, tmp_path):
    work = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    seen = spark.createDataFrame([(2,)], "k int")
    assert rows(ledger.unseen(work, seen, ["k"], 1)) == [(1,)] and rows(ledger.marks(work, ["k"])) == [(1,), (2,), (3,)]
    source, table, check = (str(tmp_path / x) for x in "abc")
    spark.range(4).write.parquet(source)

    def apply(batch, _):
        batch.write.mode("append").parquet(table)

    for n in (4, 4, 7):
        if n == 7:
            spark.range(10, 13).write.mode("append").parquet(source)
        ledger.upsert_stream(spark, source, "id bigint", check, apply).awaitTermination()
        assert spark.read.parquet(table).count() == n


def test_schema_checks_and_versions(spark):
    t = {n: S.create(spark, n) for n in S.DDL}
    assert S.violations(t).count() == 0
    t["countries"] = spark.createDataFrame([(1, "France"), (2, "France")], S.schema("countries"))
    t["festivals"] = spark.createDataFrame([(1, "F", "d", "i", 9)], S.schema("festivals"))
    assert {r["check"] for r in S.violations(t).collect()} == {"countries: name repeated", "festivals.country_id not in countries"}
    old = {"films": S.create(spark, "films").drop("broadcasters", "budget_category", "genre_categories", "is_french_financed").withColumn("first_language", F.lit("fr"))}
    assert set(S.migrate(old)["films"].columns) == set(S.create(spark, "films").columns)


def test_crop_and_sharpness(spark):
    rng = np.random.default_rng(0)
    noisy, flat = rng.integers(0, 255, (6, 8)).astype(float).tolist(), [[7.0] * 8] * 6
    df = spark.createDataFrame([(1, noisy), (2, flat), (3, None)], "id int, p array<array<double>>")
    got = df.select(V.laplacian_variance(F.col("p")).alias("v"), V.crop(F.col("p"), F.lit(2), F.lit(1), F.lit(5), F.lit(3)).alias("c")).collect()
    assert got[0]["v"] > 1000 and got[1]["v"] == 0 and got[2]["v"] is None and got[0]["c"] == [r[2:5] for r in noisy[1:3]]


def test_match_or_insert(spark):
    old = spark.createDataFrame([(3, "Jean Dupont"), (5, "Anna Karenina")], "id int, name string")
    new = spark.createDataFrame([("Dupont Jean",), ("Bob",), ("Bob",), (None,)], "name string")
    grown, ids = R.match_or_insert(old, new, "name")
    assert rows(grown) == [(3, "Jean Dupont"), (5, "Anna Karenina"), (6, "Bob")] and rows(ids) == [("Bob", 6), ("Dupont Jean", 3)]


def test_people_of_a_trailer(spark):
    from lumenframe.plans.trailers import people

    rng = np.random.default_rng(3)
    logits = [float(x) for x in (9, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 5, 0, 0, 0, 0, 0)]
    faces = [(1, i, i, 0, 0, 40, 40, 0.9, 300.0, -0.5, logits, (rng.normal(i % 2 * 9, 0.01, 4)).tolist()) for i in range(60)]
    faces += [(1, 100 + i, i, 0, 0, 40, 40, 0.3, 300.0, -0.5, logits, [0.0] * 4) for i in range(60)] + [(1, 200, 1, 0, 0, 40, 40, 0.9, 300.0, None, logits, [0.0] * 4)]
    d = spark.createDataFrame(faces, "film int, face_id int, frame_id int, x1 int, y1 int, x2 int, y2 int, conf double, sharpness double, nose_z double, logits array<double>, embedding array<double>")
    got = people(d, spark.createDataFrame([(1, 240, 0.5)], "film int, width int, seconds_per_frame double")).orderBy("label").collect()
    assert [(r["label"], r["gender"], r["age_min"], r["age_max"], r["ethnicity"], r["occurence"], r["time_on_screen"]) for r in got] == [(0, "Female", 20, 29, "White", 30, 15.0), (1, "Female", 20, 29, "White", 30, 15.0)]
    assert got[0]["average_size_on_screen"] == pytest.approx(1600 / 24000)


def test_cast_sections(spark):
    html = '<section class="crew"><h2>Production</h2><div class="c"><span class="r">Producteur</span><a class="n">A</a></div><div class="c"><i class="r2">Co</i><b class="n2">B</b></div><div class="c">x</div></section>'
    df = spark.createDataFrame([(html,), ("",)], "h string")
    got = df.select(pages.cast_sections(F.col("h"), "crew", ("h2", None), ("div", "c"), [("span", "r"), ("i", "r2")], [("a", "n"), ("b", "n2")]).alias("m")).collect()
    assert {k: [tuple(x) for x in v] for k, v in got[0]["m"].items()} == {"Production": [("Producteur", "A"), ("Co", "B")]} and got[1]["m"] == {}


def test_null_keys_match_null_keys(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "k", "b")], "id int, key string, value string")
    new = spark.createDataFrame([(None, "c"), ("n", "d")], "key string, value string")
    pairs = lambda df: sorted(((r["key"] or "", r["value"]) for r in df.collect()))
    assert pairs(U.create_or_update(old, new, ["key"])) == [("", "c"), ("k", "b"), ("n", "d")]
    assert pairs(U.update(old, new, ["key"])) == [("", "c"), ("k", "b")]
    assert pairs(U.keep_first(old, new, ["key"], ["value"])) == [("", "a"), ("k", "b"), ("n", "d")]
    assert pairs(U.delete_where(old, new, ["key"])) == [("k", "b")]
    assert pairs(U.find_or_create(old, new.unionByName(new.withColumn("value", F.lit("z"))), ["key"])) == [("", "a"), ("k", "b"), ("n", "d")]


def test_commit_shows_all_tables_or_none(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert U.current(spark, root) == {}
    U.commit(spark, root, {"a": spark.range(3), "b": spark.range(5)})
    before = U.current(spark, root)
    with pytest.raises(Exception, match="broken"):
        U.commit(spark, root, {"a": spark.range(7), "b": spark.range(1).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))})
    assert {n: df.count() for n, df in U.current(spark, root).items()} == {"a": 3, "b": 5}
    U.commit(spark, root, {"a": spark.range(9)})
    assert {n: df.count() for n, df in U.current(spark, root).items()} == {"a": 9, "b": 5} and before["a"].count() == 3
    assert U.vacuum(spark, root) >= 1 and {n: df.count() for n, df in U.current(spark, root).items()} == {"a": 9, "b": 5}


def test_candidates_hold_what_exact_distances_choose():
    """Far from zero, in ties and beside broken vectors: the exact nearest and all within the radius are among few candidates."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(0, 4, (120, 5)), rng.normal(size=(80, 5))]) + np.array([0, 0, 0, 0, 3e6])
    ids, points, at = np.arange(200), np.concatenate([x, [[np.nan] * 5]]), np.arange(201)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    one = pivots._candidates(x, ids, points, at, None)
    assert all(int(r.argmin()) in c and set(np.flatnonzero(r == r.min())) <= set(c.tolist()) for r, c in zip(d, one, strict=True)) and sum(map(len, one)) < 0.2 * d.size
    for radius in (0.5, 1.0):
        assert all(set(np.flatnonzero(r < radius)) <= set(c.tolist()) and 200 not in c for r, c in zip(d, pivots._candidates(x, ids, points, at, radius), strict=True))


def test_floats_are_stored_as_floats(spark):
    """What is stored and sent of float vectors is as small as it came; results are those of doubles."""
    rows = [(i, "l", [float(i * i % 17), float(i % 5)]) for i in range(40)]
    of = lambda kind: spark.createDataFrame(rows, f"point_id bigint, label string, vector array<{kind}>")
    assert dict(pivots.build(of("float"))[0].dtypes)["vector"] == "array<float>"
    found = [sorted(map(tuple, pivots.nearest(p.select(F.col("point_id").alias("query_id"), "vector"), p)[0].collect())) for p in (of("float"), of("double"))]
    assert found[0] == found[1] and len(found[0]) == 40


def test_nearest_against_brute_force(spark, monkeypatch):


    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (300, 6)).astype(float)  # many ties
    rows = [(i, f"l{i}", v.tolist()) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "point_id bigint, label string, vector array<double>").repartition(4)
    queries = points.where("point_id % 7 = 0").select(F.col("point_id").alias("query_id"), "vector")
    monkeypatch.setattr(pivots, "BLOCK", 16)
    best, met = pivots.nearest(queries, points)
    got = {r["query_id"]: (r["distance"], r["point_id"], r["label"]) for r in best.collect()}
    assert all(r["read"] + r["skipped"] == 300 for r in met.collect()) and met.agg(F.sum("skipped")).first()[0] > 0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == {i: (d[i].min(), int(d[i].argmin()), f"l{d[i].argmin()}") for i in range(0, 300, 7)}


def test_far_cells_are_skipped(spark):
    """Vectors in well-parted groups: a query meets its own group, hardly more; all pairs within a radius are those of comparing all."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.05, (100, 8)) for c in range(12)])
    points = spark.createDataFrame([(i, i // 100, v.tolist()) for i, v in enumerate(x)], "point_id long, label int, vector array<double>").repartition(4)
    queries = points.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector")
    best, met = pivots.nearest(queries, points)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert {r["query_id"]: r["point_id"] for r in best.collect()} == {i: int(d[i].argmin()) for i in range(0, 1200, 20)}
    assert met.agg(F.avg("read")).first()[0] < 240
    pairs = {(r["query_id"], r["point_id"]) for r in pivots.within(points, 0.2).collect()}
    assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(d < 0.2), strict=True)}
    assert pivots.nearest(queries, points.limit(0))[0].count() == 0 and pivots.within(points.limit(0), 1.0).count() == 0


def test_nested_elements_stay_whole(spark):
    markup = "<div class=\"x item\"><b>1</b><div><div>in</div></div>end</div><div class=\"item\">2</div><div class=\"item\"><div class=\"item\">3</div></div><div class=\"item\">open"
    got = spark.createDataFrame([(markup,)], "h string").select(pages.elements(F.col("h"), "div", "item").alias("e")).first()["e"]
    assert got == ["<b>1</b><div><div>in</div></div>end", "2", "<div class=\"item\">3</div>", "3"]


def test_film_page_and_people(spark):
    page = (
        '<img class="thumb big" src="p.jpg"><span class="date">3 mai 1995</span><div class="meta">3 mai 1995 | 2h 07min | Drame</div><a class="genre">Drame</a> <a class="genre">Guerre</a>'
        '<figure class="player x" data-model="{&quot;videos&quot;:[{&quot;sources&quot;:{&quot;medium&quot;:&quot;m.mp4?a=1&amp;b=2&quot;}}]}"></figure>'
        '<div class="item"><span class="what light">Langue</span><span class="that">fr</span></div><div class="item"><span class="what light">N° de Visa</span> <span class="that"> 87654 </span></div>'
        '<section class="dir"><b class="n">Ana Q</b><b class="n">Bo R</b></section>'
    )
    look = lambda h: pages.film_page(h, ("img", "thumb"), ("span", "date"), ("div", "meta"), ("a", "genre"))
    got = spark.createDataFrame([(page,), ("<p>nothing</p>",)], "h string").select(look(F.col("h")).alias("f"), pages.people(F.col("h"), ("section", "dir"), ("b", "n")).alias("d")).collect()
    assert tuple(got[0]["f"]) == ("87654", "p.jpg", "3 mai 1995", "2h07min", ["Drame", "Guerre"], "m.mp4?a=1&b=2") and got[0]["d"] == ["Ana Q", "Bo R"]
    assert tuple(got[1]["f"]) == (None,) * 6 and got[1]["d"] == []
