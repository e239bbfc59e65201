import random
import threading

import pytest
from pyspark.sql import functions as F

from lumenframe import schema as S
from lumenframe.functions.text import _trigrams_by_word, similarity, trigrams
from lumenframe.operators import trigram_index as T
from lumenframe.operators import trigrams as G
from lumenframe.operators import upsert as U
from lumenframe.plans import ingest as I

RAW = "row_id long, title string, director string, country string, festival string, year string, distinction string, reward string"


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def share(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def names(n, seed=1):
    rng = random.Random(seed)
    words = ["night", "foxes", "long", "the", "of", "été", "a", "2", "fox", "nights", "l'eau", "wolf", "𝔸b"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n)] + ["", "!!", " the  NIGHT, of!foxes ", None]


def test_trigrams_by_pattern_and_by_word(spark):
    texts = names(200) + ["a", "ab c", "-x-", "ÉTÉ\nİ", "漢字 テスト", "a\tb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_sort(trigrams(F.col("t"))).alias("a"), F.array_sort(_trigrams_by_word(F.col("t"))).alias("b"))
    for t, a, b in df.collect():
        assert a == b and (t is None or "İ" in t or set(a) == grams(t)), t


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_similar_pairs_lose_none(spark, threshold):
    a, b = names(60, 1), names(60, 2)
    df = lambda x: spark.createDataFrame([(i % 3, t) for i, t in enumerate(x)], "k int, text string")
    got = {tuple(r) for r in G.similar_pairs(df(a), df(b), ["k"], threshold).select("k", "a", "b", F.round("score", 9)).collect()}
    want = {(i % 3, x, y, round(share(x, y), 9)) for i, x in enumerate(a) for j, y in enumerate(b) if i % 3 == j % 3 and x and y and share(x, y) > threshold}
    assert got == want
    assert len(got) == len({g[:3] for g in got})


def test_pairs_are_compared_where_they_meet(spark):
    """Pairs that are not similar must not be sent on: nothing is exchanged above the join."""
    df = spark.createDataFrame([(i % 2, f"night {i} foxes") for i in range(50)], "k int, text string")
    plan = G.similar_pairs(df, df, ["k"], 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan.partition("Join")[0]


def one_by_one(rows, films, threshold=0.8):
    """What going through the rows in order gives."""
    there, out = {k: [(i, None, t) for i, d, t in films if d == k] for k in {d for _, _, d in rows} | {d for _, d, _ in films}}, {}
    for row, title, director in sorted(rows):
        if title is None or director is None or not grams(title):
            out[row] = (None, row)
            continue
        found = [(-share(title, t), 0 if i is not None else 1, i if i is not None else f, i, f) for i, f, t in there[director] if share(title, t) > threshold]
        if found:
            out[row] = min(found)[3:]
        else:
            there[director].append((None, row, title))
            out[row] = (None, row)
    return out


def test_rows_in_order_equal_one_by_one(spark):
    rng = random.Random(9)
    base = ["the long night of the foxes", "long night of the foxes", "long night of foxes", "the long night of foxes ii", "wolf", "wolf!", "the wolf", "!!", None]
    people = ["Zoe Q", "Ana B", None]
    rows = [(i * 7, rng.choice(base + names(3, i)), rng.choice(people)) for i in range(150)]
    rng.shuffle(rows)
    films = [(1, "Zoe Q", "Long night of the fox"), (2, "Ana B", "wolf"), (3, "Ana B", "The Wolf")]
    got = G.arrivals(
        spark.createDataFrame(rows, "row_id long, title string, director string").repartition(3), spark.createDataFrame([(i, t) for i, _, t in films], "id long, original_name string"),
        spark.createDataFrame([(i, *d.split()) for i, d, _ in films], "film_id long, first_name string, last_name string"),
    )
    assert {r["row_id"]: (r["film_id"], r["founder"]) for r in got.collect()} == one_by_one(rows, films)


@pytest.mark.parametrize("first", [3, 8])
def test_rows_in_batches_equal_one_by_one(spark, monkeypatch, first):
    """Titles that all resemble each other, in batches: what founds in one batch is met by the next, and a row's film is the best of those before it."""
    monkeypatch.setattr(G, "FIRST", first)
    rng = random.Random(first)
    words = ["night", "foxes", "long", "wolf", "returning", "shadow"]
    rows = [(i * 3, " ".join(sorted(rng.sample(words, 4))) + rng.choice(["", " ii", " at last"]), rng.choice(["Zoe Q", "Ana B"])) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, title string, director string").repartition(3)
    found = G.arrivals(df, spark.createDataFrame([], "id long, original_name string"), spark.createDataFrame([], "film_id long, first_name string, last_name string"))
    assert {r["row_id"]: (r["film_id"], r["founder"]) for r in found.collect()} == one_by_one(rows, [])


def test_titles_meet_founders_and_not_each_other(spark, monkeypatch):
    """200 titles that resemble one another found one film; of their 19,900 pairs only those of the first batch and those with that film are made."""
    monkeypatch.setattr(G, "FIRST", 10)
    met, own = [], G._alike
    monkeypatch.setattr(G, "_alike", lambda *x: met.append(own(*x)) or met[-1])
    df = spark.createDataFrame([(i, f"the long night of the returning foxes and wolves {i}", "Zoe Q") for i in range(200)], "row_id long, title string, director string")
    found = G.arrivals(df, spark.createDataFrame([], "id long, original_name string"), spark.createDataFrame([], "film_id long, first_name string, last_name string"))
    assert {r["founder"] for r in found.collect()} == {0} and sum(m.count() for m in met) < 2000


def test_two_similar_new_titles_become_one_film(spark):
    """The second row finds the film that the first made; with the rows turned round the other title founds it."""
    t = {n: S.create(spark, n) for n in S.DDL}
    t["roles"] = spark.createDataFrame([(1, "director", None, True, None)], "id int, name string, allocine_name string, is_key_role boolean, inclusive_name string")
    known = spark.createDataFrame([("Fest", "d", "i", "France")], "name string, description string, image_base64 string, country string")
    titles = ["The Long Night of the Foxes", "Long Night of the Foxes"]
    for order in (titles, titles[::-1]):
        raw = spark.createDataFrame([(n, x, "Zoe Q", "France", "Fest", str(2022 + n), "Lauréat", "m") for n, x in enumerate(order)], RAW).orderBy(F.desc("row_id"))
        out, _ = I.awards(t, raw, known)
        assert [r["original_name"] for r in out["films"].collect()] == order[:1]
        assert [r["date"].year for r in out["award_nominations"].collect()] == [2022] and S.violations(out).count() == 0


def test_rows_meet_only_films_that_are_more_similar_than_earlier_ones(spark):
    """Of a title's films each row takes the best founded before it; many rows of one title, with marks of their own, found one film."""
    titles = ["the long night of foxes returns", "the long night of foxes returns again", "the long night of foxes returns at last", "the long night of foxes, returns!"]
    rows = [(i, titles[i * 7 % 4], "Agnès Varda") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, title string, director string")
    found = G.arrivals(df, spark.createDataFrame([], "id long, original_name string"), spark.createDataFrame([], "film_id long, first_name string, last_name string"))
    assert {r["row_id"]: (r["film_id"], r["founder"]) for r in found.collect()} == one_by_one([(i, t, "d") for i, t, _ in rows], [])


def test_index_equals_the_scan(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    held = {i: n for i, n in enumerate(names(150)) if n is not None}
    frame = lambda x: spark.createDataFrame(list(x.items()), "id int, name string")
    T.build(spark, root, frame(held))

    def same():
        for text in ("ight", "fox", "the ni", "o", "NIGHT", "foxes the", "zz", "é", "lo_g", "a%wolf", "!!", "l'eau"):
            got = {(r["id"], r["name"]) for r in T.holding(spark, root, text).collect()}
            want = {(r["id"], r["name"]) for r in frame(held).where(F.ilike("name", F.lit(f"%{text}%"))).collect()}
            assert got == want, text
        queries = ["long night", "the foxes of night", "", "wolf"]
        got = {(r["text"], r["id"]) for r in T.resembling(spark, root, spark.createDataFrame([(q,) for q in queries], "text string"), 0.5).collect()}
        assert got == {(q, i) for q in queries for i, n in held.items() if share(q, n) > 0.5}

    same()
    new, gone = {3: "long wolf", 500: "night of nights"}, {5, 6}
    T.change(spark, root, frame(new), spark.createDataFrame([(i,) for i in gone], "id int"))
    held |= new
    for i in gone:
        held.pop(i, None)
    same()
    T.compact(spark, root)
    same()
    with pytest.raises(ValueError):
        T.holding(spark, f"{root}-none", "night")


def test_postings_lead_to_different_names_not_to_ids(spark, tmp_path):
    """Many ids of one name, also one that takes it later and one that gives it up, make no more postings."""
    root, few = f"file://{tmp_path}/many", f"file://{tmp_path}/few"
    frame = lambda x: spark.createDataFrame(x, "id int, name string")
    T.build(spark, few, frame([(1, "the red ring"), (2, "a blue bolt")]))
    T.build(spark, root, frame([(i, ("the red ring", "a blue bolt")[i % 2]) for i in range(600)]))
    assert T._part(spark, root, "postings").count() == T._part(spark, few, "postings").count()
    T.change(spark, root, frame([(0, "a blue bolt"), (900, "the red ring")]), spark.createDataFrame([(2,)], "id int"))
    want = {*range(4, 600, 2), 900}
    assert {r["id"] for r in T.holding(spark, root, "red ring").collect()} == want
    got = T.resembling(spark, root, spark.createDataFrame([("the red rings",)], "text string"), 0.5).collect()
    assert {r["id"] for r in got} == want and len(got) == len(want) and got[0]["score"] == share("the red rings", "the red ring")


def test_many_found_names_keep_the_order_of_columns(spark, tmp_path):
    """More different names than are listed are joined: the columns stay (id, name)."""
    root = f"file://{tmp_path}/i"
    held = [(i, f"red ring {i}") for i in range(T.LISTED + 20)]
    T.build(spark, root, spark.createDataFrame(held, "id int, name string"))
    got = T.holding(spark, root, "red ring")
    assert got.columns == ["id", "name"] and sorted(map(tuple, got.collect())) == held


def test_index_opens_only_the_buckets_it_needs(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    T.build(spark, root, spark.createDataFrame([(i, n) for i, n in enumerate(names(100)) if n], "id int, name string"))
    plan = T.postings(spark, root, ["fox", " wo"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "gram" in plan.split("PushedFilters:")[1].split("]")[0]


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    U.commit(spark, root, {"a": spark.range(0), "b": spark.range(1)})
    failed = []

    def writer(k):
        try:
            for i in range(3):
                U.transaction(spark, root, lambda t: t | {"a": t["a"].unionByName(spark.range(10 * k + i, 10 * k + i + 1))}, tries=50)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in (1, 2)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed
    assert sorted(r["id"] for r in U.current(spark, root)["a"].collect()) == [10, 11, 12, 20, 21, 22] and U.version(spark, root) == 7
    assert U.current(spark, root, 1)["a"].count() == 0  # as it was
    with pytest.raises(U.Conflict):
        U.commit(spark, root, {"a": spark.range(1)}, since=3)
    assert U.commit(spark, root, {"b": spark.range(2)}, since=3) == 8  # another table: it meets nobody
    with pytest.raises(U.Conflict):
        U.commit(spark, root, {"c": spark.range(2)}, since=3, read=["a"])
    assert U.vacuum(spark, root) > 0 and U.current(spark, root)["b"].count() == 2


def test_an_ingest_takes_effect_whole(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    raw = spark.createDataFrame([("12", "AMOUR (L')", "3000000", "FR-70/BE-30")], "visa_number string, original_name string, budget string, film_country_budget_allocation_rates string")
    version, aside = I.run(spark, root, I.sheets, raw)
    now = U.current(spark, root)
    assert version == 1 and aside.count() == 0 and now["films"].first()["original_name"] == "L'amour" and now["countries"].count() == 2 and set(now) == set(S.DDL)
    broken = raw.withColumn("budget", F.raise_error(F.lit("broken")).cast("string")).withColumn("visa_number", F.lit("13"))
    with pytest.raises(Exception, match="broken"):
        I.run(spark, root, I.sheets, broken)
    assert U.version(spark, root) == 1 and U.current(spark, root)["countries"].count() == 2


def test_cascades(spark):
    a, b, c = (spark.createDataFrame(r, s) for r, s in (([(1,), (2,)], "id int"), ([(1, 1), (2, 2), (3, None)], "id int, a_id int"), ([(1, 1, 2), (2, 3, 1), (3, 3, 2), (4, None, None)], "id int, b_id int, a_id int")))
    refs = [("b", "a_id", "a"), ("c", "b_id", "b"), ("c", "a_id", "a")]
    out = S.deleted({"a": a, "b": b, "c": c}, "a", a.where("id = 1"), references=refs)
    assert {n: sorted(r["id"] for r in df.collect()) for n, df in out.items()} == {"a": [2], "b": [2, 3], "c": [3, 4]}
    assert {n: df.count() for n, df in S.truncated({"a": a, "b": b, "c": c}, ["b"], refs).items()} == {"a": 2, "b": 0, "c": 0}
    order = S.parents_first(S.DDL)
    assert all(order.index(p) < order.index(ch) for ch, _, p in S.FOREIGN_KEYS)
    with pytest.raises(KeyError):
        S.truncated({"a": a}, ["nope"], refs)


def test_schema_versions_on_read(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    history = [(1, "t", S.add_column("a", "string")), (2, "t", S.rename_column("n", "m")), (3, "t", S.drop_column("old", "int")), (3, "u", S.add_column("z", "int"))]
    S.append(spark, root, "t", spark.createDataFrame([(1, 5)], "n int, old int"), 0, history)
    S.append(spark, root, "t", spark.createDataFrame([(2, 6, "x")], "m int, old int, a string"), 2, history)
    S.append(spark, root, "t", spark.createDataFrame([(3, "y")], "m int, a string"), history=history)
    read = lambda to, *c: sorted(tuple(r) for r in S.stored(spark, root, "t", to, history).select(*c).collect())
    assert read(None, "m", "a") == sorted([(1, None), (2, "x"), (3, "y")]) and set(S.stored(spark, root, "t", None, history).columns) == {"m", "a"}
    assert {(r["n"], r["old"]) for r in S.stored(spark, root, "t", 0, history).collect()} == {(1, 5), (2, 6), (3, None)}
    with pytest.raises(ValueError):
        S.stored(spark, root, "u", None, history)
    films = S.create(spark, "films")
    assert set(S.migrated(S.migrated(films, "films", 9, 0), "films", 0).columns) == set(films.columns)
