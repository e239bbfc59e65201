"""Scalar functions: the known cases, evaluated as Columns."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import names as N
from lumenframe.functions import parse as P
from lumenframe.functions import text as X


def value(spark, column, text=None, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, first, last", [("Agnès Varda", "Agnès", "Varda"), ("  Céline\tSciamma ", "Céline", "Sciamma"), ("Zouzou", "Zouzou", ""), (" ", "", ""), ("Marie de la Tour d'Auvergne", "Marie", "d'Auvergne"), ("Anne-Lise  K.  O'Hara", "Anne-Lise", "O'Hara"), (None, None, None)])
def test_split_full_name(spark, text, first, last):
    assert value(spark, lambda x: F.struct(X.first_name(x), X.last_name(x)), text) == (first, last)


@pytest.mark.parametrize("text, want", [("Alice \t Guy", "Alice Guy"), ("\n Ida  Lupino\r\n", "Ida Lupino"), ("x  y z", "x y z"), ("Musidora", "Musidora"), ("\t", ""), (None, None)])
def test_remove_extra_spaces(spark, text, want):
    assert value(spark, X.remove_extra_spaces, text) == want


@pytest.mark.parametrize("text, want", [(" 41 ", 41), ("8", 8), ("60+", 60), ("110++", 110), ("00", None), ("+", None), (None, None), ("vingt", None), ("-", None), ("33,5", None)])
def test_age(spark, text, want):
    assert value(spark, P.age, text) == want


@pytest.mark.parametrize("text, want", [("7 mars 1987", date(1987, 3, 7)), (" 29 février 2024 ", date(2024, 2, 29)), ("1 decembre 1900", date(1900, 12, 1)), ("30 Juin 2011", date(2011, 6, 30)), ("14 aout 1961", date(1961, 8, 14)), ("mars 1987", None), ("7 march 1987", None), (" ", None), (None, None)])
def test_release_date(spark, text, want):
    assert value(spark, P.release_date, text) == want


@pytest.mark.parametrize("text, want", [("1h07min", 67), ("3h 05 min", 185), ("4h", 240), ("52min", 52), ("0h01min", 1), ("0h", None), ("h", None), ("2 heures", None), (" ", None), (None, None)])
def test_duration(spark, text, want):
    assert value(spark, P.duration, text) == want


@pytest.mark.parametrize("text, want", [(" 1968 ", (date(1968, 1, 1), date(1968, 12, 31))), ("2044", (date(2044, 1, 1), date(2044, 12, 31))), ("0", None), ("MCMX", None), ("", None), (None, None)])
def test_year_range(spark, text, want):
    assert value(spark, P.year_range, text) == want


@pytest.mark.parametrize("x, want", [(0.0, "Moins de 2 M€"), (2e6, "2 à 5 M€"), (4999999.0, "2 à 5 M€"), (5e6, "5 à 10 M€"), (2e7, "Plus de 20 M€"), (-1.0, None), (float("nan"), None), (None, None)])
def test_budget_category(spark, x, want):
    assert value(spark, P.budget_category, x, "double") == want


@pytest.mark.parametrize("text, want", [("jean-paul d'ARC o'neil", "Jean-Paul D'Arc O'Neil"), ("éric 3d", "Éric 3D"), ("", "")])
def test_title_case(spark, text, want):
    assert value(spark, X.title_case, text) == want


@pytest.mark.parametrize("text, want", [("PETITE VIE (LA)", "La petite vie"), ("AMOUR", "Amour"), ("Ours (L')", "L'ours"), ("Enfants (Les) ", "Les enfants"), ("La Vie", "La Vie"), (None, None), ("(LE)", "Le")])
def test_clean_title(spark, text, want):
    assert value(spark, X.clean_title, text) == want


@pytest.mark.parametrize("text, want", [("France-60 / BE-40", {"France": 60, "Belgique": 40}), ("FR - 50/ fr -30", {"France": 30}), ("xx-1/broken/It-y", {"Xx": 1}), ("", {}), (None, {}), ("bosnie-herzégovine-10", {"Bosnie-Herzégovine": 10})])
def test_allocations(spark, text, want):
    assert value(spark, P.allocations, text) == want


@pytest.mark.parametrize("m, want", [({"France": 50, "Italie": 50}, True), ({"Italie": 60, "France": 40}, False), ({}, False), ({"Belgique": 0}, True), (None, False)])
def test_is_french_financed(spark, m, want):
    assert value(spark, P.is_french_financed, m, "map<string,int>") is want


@pytest.mark.parametrize("text, want", [("TF1 france 2", ["TF1", "FranceTV", "France2"]), ("m6 M6", ["M6", "M6"]), ("nothing", []), (None, [])])
def test_broadcasters(spark, text, want):
    assert value(spark, lambda x: P.broadcasters(x, False), text) == want


def test_all_broadcasters_are_sorted_and_empty_is_text(spark):
    assert value(spark, lambda x: P.all_broadcasters(P.broadcasters(x, True), P.broadcasters(x, False)), "tv5 canal tf1") == "Canal+, TF1, TV5"
    assert value(spark, lambda x: P.all_broadcasters(P.broadcasters(x, True), P.broadcasters(x, False)), None) == ""


@pytest.mark.parametrize("text, want", [("2023 | Lauréat : Prix", ("2023", "Lauréat", "Prix")), ("2023 | Prix", ("2023", None, "Prix")), ("Prix", (None, None, "Prix")), (None, (None, None, None))])
def test_reward(spark, text, want):
    assert value(spark, P.reward, text) == want


@pytest.mark.parametrize("names, want", [(["Drame", " Animation"], "Animation, Drame"), (["Divers"], None), ([], None)])
def test_genre_categories(spark, names, want):
    assert value(spark, P.genre_categories, names, "array<string>") == want


@pytest.mark.parametrize("a, b, want", [("abc", "abc", 1.0), ("", "", 1.0), ("abc", "", 0.0), ("abcd", "axyz", 0.55), ("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333)])
def test_jaro_winkler(a, b, want):
    assert N.jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("a, b, want", [("word", "two words", 0.363636), ("cat", "cat", 1.0), ("", "", 0.0)])
def test_trigram_similarity(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(X.similarity(F.col("a"), F.col("b")).alias("y")).first()["y"]
    assert got == pytest.approx(want, abs=1e-6)


def test_unaccent_and_same_name(spark):
    assert value(spark, X.unaccent, "Œuvre à Noël, ça Straße") == "OEuvre a Noel, ca Strasse"
    assert value(spark, lambda x: X.same_name(x, F.lit("helene")), "HÉLÈNE") is True


def test_spoken_time_keeps_its_rounding(spark):
    assert value(spark, P.format_seconds, 90.0, "double") == "2 minutes 30 secondes"
    assert value(spark, P.format_duration, 178, "int") == "2h58"
