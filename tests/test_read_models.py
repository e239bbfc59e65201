"""Documents and ingest on a few films."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lumenframe import schema as S
from lumenframe.plans import ingest as I
from lumenframe.plans import read_models as Q


def table(spark, name, values):
    columns = S.schema(name)
    return spark.createDataFrame([tuple(v.get(c.name) for c in columns) for v in values], columns)


@pytest.fixture(scope="module")
def tables(spark):
    t = {n: S.create(spark, n) for n in S.DDL}
    t["films"] = table(spark, "films", [dict(id=1, original_name="Le Film", visa_number="10", release_date=date(2020, 5, 1), duration_minutes=178), dict(id=2, original_name="Film 50%", visa_number="11"), dict(id=3, original_name="film", visa_number=None)])
    t["roles"] = table(spark, "roles", [dict(id=1, name="director", allocine_name="Réalisateur", is_key_role=True), dict(id=2, name="actor", allocine_name="Acteur", is_key_role=False), dict(id=3, name="paying_broadcaster", is_key_role=False), dict(id=4, name="free_broadcaster", is_key_role=False), dict(id=5, name="production", allocine_name="Production", is_key_role=False)])
    t["credit_holders"] = table(spark, "credit_holders", [dict(id=1, type="Individual", first_name="agnès", last_name="v", gender="female"), dict(id=2, type="Individual", first_name="jean-paul", last_name="b", gender="male"), dict(id=3, type="Individual", first_name="x", last_name="", gender="unknown"), dict(id=4, type="Company", legal_name="les films d'ici")])
    t["film_credits"] = table(spark, "film_credits", [dict(id=1, film_id=1, role_id=1, credit_holder_id=1), dict(id=2, film_id=1, role_id=2, credit_holder_id=2), dict(id=3, film_id=1, role_id=2, credit_holder_id=1), dict(id=4, film_id=1, role_id=2, credit_holder_id=3), dict(id=5, film_id=1, role_id=5, credit_holder_id=4), dict(id=6, film_id=2, role_id=1, credit_holder_id=2)])
    t["countries"] = table(spark, "countries", [dict(id=1, name="France"), dict(id=2, name="Belgique")])
    t["film_country_budget_allocations"] = table(spark, "film_country_budget_allocations", [dict(country_id=2, film_id=1, budget_allocation=10.0), dict(country_id=1, film_id=1, budget_allocation=90.0)])
    t["posters"] = table(spark, "posters", [dict(id=1, image_base64="u1", film_id=1), dict(id=2, image_base64="u2", film_id=1)])
    t["poster_characters"] = table(spark, "poster_characters", [dict(id=1, poster_id=1, gender="Female", ethnicity="White", poster_percentage=0.39), dict(id=2, poster_id=1, gender="Male", ethnicity="Middle Eastern", poster_percentage=0.89)])
    t["trailers"] = table(spark, "trailers", [dict(id=1, url="t", film_id=1)])
    t["trailer_characters"] = table(spark, "trailer_characters", [dict(id=1, trailer_id=1, gender="Female", ethnicity="White", time_on_screen=6.292)])
    t["festivals"] = table(spark, "festivals", [dict(id=1, name="Fest", description="d", image_base64="i", country_id=1), dict(id=2, name="Empty", description="d", image_base64="i", country_id=1)])
    t["festival_awards"] = table(spark, "festival_awards", [dict(id=1, mubi_label="m1", french_label="Z", festival_id=1), dict(id=2, mubi_label="m2", french_label="Autre", festival_id=1), dict(id=3, mubi_label="m3", festival_id=1)])
    t["award_nominations"] = table(spark, "award_nominations", [dict(id=1, film_id=1, award_id=1, date=date(2021, 1, 1), is_winner=True), dict(id=2, film_id=2, award_id=2, date=date(2021, 1, 1), is_winner=False), dict(id=3, film_id=1, award_id=3, date=date(2019, 1, 1), is_winner=False)])
    return t


def test_film_details(tables):
    r = Q.film_details(tables, F.col("id") == 1).first().asDict(True)
    assert r["duration"] == "2h58" and r["countries_sorted_by_budget"] == ["France", "Belgique"] and r["poster"] == "u1"
    assert (r["female_representation_in_key_roles"], r["female_representation_in_casting"]) == (100.0, 50.0)
    assert (r["female_screen_time"], r["non_white_screen_time"]) == (6.292, 0.0)
    assert r["female_visible_ratio_on_poster"] == pytest.approx(39.0) and r["non_white_visible_ratio_on_poster"] == pytest.approx(89.0)
    assert [c["name"] for c in r["credits"]["casting"]] == ["Jean-Paul B", "Agnès V", "X"] and r["credits"]["distribution"]["production"][0]["name"] == "Les Films D'Ici"
    assert r["credits"]["key_roles"] == [{"role": "director", "is_key_role": True, "is_company": False, "name": "Agnès V", "gender": "female"}] and r["credits"]["distribution"]["financiers"] == []
    assert [a["award_name"] for a in r["awards"]] == [None, "Z"]
    empty = Q.film_details(tables, F.col("id") == 3).first()
    assert empty["genres"] == [] == empty["awards"] == empty["credits"]["casting"] and empty["credits"]["distribution"]["budget"] is None
    assert empty["female_visible_ratio_on_poster"] is None and empty["female_representation_in_casting"] is None


def test_companies_are_cast_but_direct_nothing(spark, tables):
    more = table(spark, "film_credits", [dict(id=7, film_id=2, role_id=1, credit_holder_id=4), dict(id=8, film_id=2, role_id=2, credit_holder_id=4), dict(id=9, film_id=2, role_id=3, credit_holder_id=4), dict(id=10, film_id=2, role_id=4, credit_holder_id=2)])
    t = tables | {"film_credits": tables["film_credits"].unionByName(more)}
    assert Q.directors(t).where("film_id = 2").first()["directors"] == ["Jean-Paul B"]
    c = Q.film_details(t, F.col("id") == 2).first()["credits"]
    assert [(e["name"], e["is_company"]) for e in c["casting"]] == [("Les Films D'Ici", True)] and [e["role"] for e in c["distribution"]["financiers"]] == ["paying_broadcaster"]
    groups = Q.film_details(t, F.col("id") == 2).select(Q.shown_groups(F.col("credits.distribution")).alias("g")).first()["g"]
    assert set(groups) == {"financiers"}


def test_a_film_reads_only_its_rows(tables):
    plan = Q.film_details(tables, F.col("id") == 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 6


def test_search(tables):
    assert [r["film_id"] for r in Q.search(tables, "FILM").collect()] == [1, 2]
    assert [r["film_id"] for r in Q.search(tables, "film 5_%").collect()] == [2]
    assert Q.search(tables, "f_lm", escape_wildcards=True).count() == 0 and Q.search(tables, "50%", escape_wildcards=True).first()["directors"] == ["Jean-Paul B"]


def test_festival_details(tables):
    got = Q.festival_details(tables, 1).collect()
    assert [(r["film_id"], r["award_id"], r["year"], r["female_nominated_percentage"], r["female_awarded_percentage"]) for r in got] == [(2, 2, 2021, 50.0, 100.0)]  # 'Autre' comes before 'Z'
    page = got[0]
    assert (page["festival_name"], page["image_base64"], page["award_name"], page["available_years"]) == ("Fest", "i", "m2", [2021, 2019]) and [a["award_id"] for a in page["available_awards"]] == [2, 1]
    won, nominated = Q.winners_and_nominees(Q.festival_details(tables, 1, 2021, 1))
    assert [r["film_id"] for r in won.collect()] == [1] and nominated.count() == 0
    assert [r["film_id"] for r in Q.festival_details(tables, 1, 2019).collect()] == [1]
    assert Q.festival_details(tables, 9) == Q.ERRORS["festival"] and Q.festival_details(tables, 2) == Q.ERRORS["years"]
    assert Q.festival_details(tables, 1, 1950) == Q.ERRORS["year"] and Q.festival_details(tables, 1, 2021, 3) == Q.ERRORS["award"]


def test_sheets_are_idempotent(spark, tables):
    raw = spark.createDataFrame([("12", "AMOUR (L')", "A / B", "3000000", "OUI", "FR-70/BE-30/TOGO-x", "canal tf1", "France 2", "2020", "2ème apres"), ("10", "known", "", "", "", "", "", "", "2020", "")], "visa_number string, original_name string, directors_names string, budget string, eof string, film_country_budget_allocation_rates string, paying_broadcasters string, free_broadcasters string, cnc_agrement_year string, asr string")
    out, unknown = I.sheets(tables, raw)
    film = out["films"].where("visa_number = '12'").first()
    assert (film["original_name"], film["budget_category"], film["eof"], film["is_french_financed"], film["broadcasters"], film["id"], film["asr"]) == ("L'amour", "2 à 5 M€", True, True, "Canal+, France2, FranceTV", 4, "2ème après")
    assert {(r["name"]) for r in out["countries"].collect()} == {"France", "Belgique"} and out["film_credits"].count() == 9 and unknown.count() == 0
    again, _ = I.sheets(out, raw)
    assert again["films"].count() == 4 and again["film_credits"].count() == 9 and S.violations(again).count() == 0


def test_details_and_predictions(spark, tables):
    raw = spark.createDataFrame([("11", "77", "12 janvier 2023", "1h45min", "tr", "po", '["Drame", "Comédie"]', '["anna a"]', "[]", '[{"role":"Acteur","name":"bob b"},{"role":"Nobody","name":"z"}]'), ("10", "1", "1 mai 2000", "1h", "", "", "[]", "[]", "[]", "[]")], "visa_number string, allocine_id string, release_date string, duration string, trailer_url string, poster_url string, genres string, Casting string, Direction string, `Production` string")
    genders = spark.createDataFrame([("anna", "female")], "first_name string, gender string")
    out, unknown = I.details(tables, raw, genders)
    film = out["films"].where("id = 2").first()
    assert (film["allocine_id"], film["release_date"], film["duration_minutes"], film["genre_categories"]) == (77, date(2023, 1, 12), 105, "Comédie/Comédie dramatique, Drame")
    assert out["films"].where("id = 1").first()["allocine_id"] is None  # it had both date and duration
    assert {r["name"] for r in out["genres"].collect()} == {"drame", "comédie"} and out["films_genres"].count() == 2 and [r["role"] for r in unknown.collect()] == ["Nobody"]
    assert out["credit_holders"].where("first_name = 'anna'").first()["gender"] == "female" and out["trailers"].count() == 2
    seen = spark.createDataFrame([("11", "Female", "20", "70+", "White", "0.5")], "visa_number string, gender string, age_min string, age_max string, ethnicity string, poster_percentage string")
    once = I.predictions(out, seen, "poster")
    twice = I.predictions(once, seen, "poster")
    assert once["poster_characters"].count() == twice["poster_characters"].count() == 3 and twice["poster_characters"].where("gender = 'female' and age_max = 70").count() == 1


def test_awards(spark, tables):
    raw = spark.createDataFrame([("le film!", "AGNES V", "France", "fest", "2022", "Lauréat", "m1"), ("New", "Zoe Q", "Italie", "Fest", "2022", "Nommé", "m9"), ("New", "Zoe Q", "Italie", "Nowhere", "2022", "Nommé", "m9")], "title string, director string, country string, festival string, year string, distinction string, reward string")
    known = spark.createDataFrame([("Fest", "d", "i", "France")], "name string, description string, image_base64 string, country string")
    out, unknown = I.awards(tables, raw, known)
    assert out["films"].count() == 4 and unknown.count() == 1 and out["festival_awards"].count() == 4
    first = out["award_nominations"].where("film_id = 1 and award_id = 1").collect()
    assert len(first) == 1 and first[0]["date"] == date(2021, 1, 1)  # the year is not part of the key: the first stays
    assert out["award_nominations"].count() == 4 and S.violations(out).count() == 0


@pytest.mark.parametrize("name, found", [("agnes v", True), ("Agnès Maria V", True), ("  Agnès \t V ", True), ("Agnès", False), ("V Agnès", False)])
def test_films_are_found_by_first_and_last_name(spark, tables, name, found):
    raw = spark.createDataFrame([("Le Film", name, "France", "Fest", "2022", "Lauréat", "m7")], "title string, director string, country string, festival string, year string, distinction string, reward string")
    out, _ = I.awards(tables, raw, spark.createDataFrame([("Fest", "d", "i", "France")], "name string, description string, image_base64 string, country string"))
    assert out["films"].count() == (3 if found else 4)


def test_known_roles_are_made_when_named(spark, tables):
    known = spark.createDataFrame([("screenwriter", "Scénariste", True, "Scénariste"), ("composer", "Compositeur", True, "x")], "name string, allocine_name string, is_key_role boolean, inclusive_name string")
    empty = tables | {"roles": S.create(spark, "roles")}
    rows = spark.createDataFrame([(1, "scénariste", "Individual", "Zoe Q"), (1, "Nobody", "Individual", "A B")], "film_id int, role string, kind string, name string")
    out, unknown = I.add_credits(empty, rows, None, known)
    assert [(r["id"], r["name"]) for r in out["roles"].collect()] == [(1, "screenwriter")] and [r["role"] for r in unknown.collect()] == ["Nobody"] and out["film_credits"].count() == 7


def test_crawl(spark):
    films = spark.createDataFrame([(1, "1"), (2, "2"), (3, "3"), (4, "4")], "film_id int, visa_number string")
    pages = spark.createDataFrame([("1", '<a href="/film/fichefilm_gen_cfilm=5.html">T</a>'), ("2", "<p>none</p>"), ("3", None)], "visa_number string, html string")
    done = spark.createDataFrame([("4",)], "visa_number string")
    got = I.crawl_matches(films, pages, done)
    assert {(r["visa_number"], r["status"], r["allocine_id"]) for r in got.collect()} == {("1", "found", 5), ("2", "not_found", None), ("3", "error", None)}
    details = spark.createDataFrame([(5, "1", "d1"), (6, "9", "d2")], "allocine_id bigint, allocine_visa_number string, release_date string")
    matches = spark.createDataFrame([("1", "5"), ("2", "6"), ("3", "Not found")], "visa_number string, allocine_id string")
    assert {(r["visa_number"], r["release_date"]) for r in I.enrich_matches(matches, details).collect()} == {("1", "d1"), ("2", None), ("3", None)}


def test_allocation_rows_agree_with_the_cells_own_maps(spark):
    from lumenframe.functions import parse as P
    from lumenframe.operators import metrics as M

    cells = ["FR-60 / BE-40", "fr-10/FR-20", "NC-1", "x", "", None, "Pays-Bas - 5/ -7", "Syldavie-3 / syldavie-x", "FR-1.5", "FR-"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, cell string")
    got = {}
    for r in M.allocation_rows(df, "k", "cell").collect():
        got.setdefault(r["k"], {})[r["country"]] = r["rate"]
    want = {r["k"]: r["m"] for r in df.select("k", P.allocations(F.col("cell")).alias("m")).collect() if r["m"]}
    assert got == want
    assert M.allocation_rows(df.limit(0), "k", "cell").count() == 0


def test_sheets_of_a_visa_that_are_equal_in_year_and_title(spark, tables):
    """The first by row_id counts, or, without it, by the other columns, however the rows lie."""
    rows = [(row, "77001", "NUIT", "2003", budget) for row, budget in enumerate(["400", "300", "900", "200", "800"])]
    for order in (rows, rows[::-1]):
        raw = spark.createDataFrame(order, "row_id long, visa_number string, original_name string, cnc_agrement_year string, budget string").repartition(3)
        for given, want in ((raw, 400.0), (raw.drop("row_id"), 200.0)):
            out, _ = I.sheets(tables, given)
            assert [r["budget"] for r in out["films"].where("visa_number = '77001'").collect()] == [want]
