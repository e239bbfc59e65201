"""Parsers of messy cells as Columns. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.fixed import BUDGETS, COUNTRIES, FREE_BROADCASTERS, GENRES, PAYING_BROADCASTERS
from lumenframe.functions.text import capitalize, let, tokens

_ACCENTED = {"fevrier": "février", "aout": "août", "decembre": "décembre"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, null where the key is missing."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, key)


def age(s: Column) -> Column:
    """'70+' -> 70; zero, blank and anything that is no whole number -> null."""
    return F.nullif(F.regexp_replace(F.trim(s), r"\++$", "").try_cast("int"), F.lit(0))


def number(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def flag(s: Column) -> Column:
    """X or OUI, in any case, with blanks around it; null is false."""
    return F.upper(F.trim(F.coalesce(s, F.lit("")))).isin("X", "OUI")


def rank(s: Column) -> Column:
    """The first run of digits."""
    return F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).try_cast("int")


def release_date(s: Column) -> Column:
    """A long French date."""
    lowered = F.lower(F.trim(s))
    for plain, accented in _ACCENTED.items():
        lowered = F.replace(lowered, F.lit(plain), F.lit(accented))
    return F.from_csv(F.nullif(lowered, F.lit("")), F.lit("d date"), {"dateFormat": "d MMMM yyyy", "locale": "fr-FR"})["d"]


def french_date(d: Column) -> Column:
    """A date as a long French text."""
    return F.to_csv(F.struct(d.cast("date").alias("d")), {"dateFormat": "d MMMM yyyy", "locale": "fr-FR"})


def duration(s: Column) -> Column:
    """'2h05min', '1h' or '90min' in minutes; zero and anything else -> null."""
    t = F.regexp_replace(s, r"\s+", "")
    shape = F.regexp_extract_all(t, F.lit(r"^(?=.)(?:(\d+)h)?(?:(\d+)min)?$"), F.lit(0))
    hours = F.coalesce(F.regexp_extract(t, r"^(\d+)h", 1).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(t, r"(\d+)min$", 1).try_cast("int"), F.lit(0))
    return F.when(F.size(shape) > 0, F.nullif(hours * 60 + minutes, F.lit(0)))


def format_duration(minutes: Column) -> Column:
    m = minutes.cast("int")
    return F.format_string("%dh%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)))


def format_seconds(seconds: Column) -> Column:
    """Minutes and seconds in words; both are rounded half up, the minutes before the rest is taken."""
    minutes, rest = F.floor(seconds / 60 + 0.5).cast("int"), F.floor(F.pmod(seconds, F.lit(60)) + 0.5).cast("int")
    return F.format_string("%d minutes %d secondes", minutes, rest)


def year_range(y: Column) -> Column:
    """The first and last day of a year as a struct, null for what is no year."""
    n = F.trim(y.cast("string")).try_cast("int")
    ok = n.between(1, 9999)
    return F.when(ok, F.struct(F.make_date(n, F.lit(1), F.lit(1)).alias("first"), F.make_date(n, F.lit(12), F.lit(31)).alias("last")))


def budget_category(x: Column) -> Column:
    value = x.try_cast("double")
    out = F.when(value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf")), F.lit(None).cast("string"))
    for name, least in reversed(BUDGETS):
        out = out.when(value >= least, F.lit(name))
    return out


def genre_categories(names: Column) -> Column:
    """The buckets of an array of genres, sorted and joined; null if none is known."""
    found = F.filter(F.transform(names, lambda g: lookup(GENRES, F.lower(F.trim(g)))), lambda g: g.isNotNull())
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(found)), ", "), F.lit(""))


def broadcasters(s: Column, paying: bool) -> Column:
    """The known broadcasters of a blank-separated cell, in order, repeats kept; none for null."""
    table = PAYING_BROADCASTERS if paying else FREE_BROADCASTERS
    return F.coalesce(F.filter(F.transform(tokens(s), lambda t: lookup(table, F.lower(t))), lambda t: t.isNotNull()), F.array().cast("array<string>"))


def all_broadcasters(paying: Column, free: Column) -> Column:
    """Both lists as one sorted text without repeats; empty if both are."""
    both = F.filter(F.concat(F.coalesce(paying, F.array().cast("array<string>")), F.coalesce(free, F.array().cast("array<string>"))), lambda b: b.isNotNull())
    return F.array_join(F.array_sort(F.array_distinct(F.transform(both, lambda b: F.trim(b)))), ", ")


def allocations(s: Column) -> Column:
    """'FR-60 / BE-40' -> {France: 60, Belgique: 40}; parts without a whole number are skipped, and of a country named twice the last stays."""

    def part(e: Column) -> Column:
        code = F.regexp_extract(e, r"^(.*)-[^-]*$", 1)
        rate = F.nullif(F.trim(F.regexp_extract(e, r"-([^-]*)$", 1)), F.lit("")).try_cast("int")
        return F.struct(F.coalesce(lookup(COUNTRIES, F.lower(F.trim(code))), capitalize(F.trim(code))).alias("key"), rate.alias("value"))

    parts = F.filter(F.transform(F.filter(F.split(F.trim(F.coalesce(s, F.lit(""))), r"\s*/\s*"), lambda e: F.contains(e, F.lit("-"))), part), lambda p: p["value"].isNotNull())
    last = let(parts, lambda p: F.filter(p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.greatest(F.size(p) - i - 1, F.lit(0))), lambda l: l["key"] == e["key"])))
    return F.map_from_entries(last)


def is_french_financed(m: Column) -> Column:
    """Whether France's share is the largest or tied for it; false for no shares at all. A film without France counts if all shares are 0."""
    return F.coalesce((F.size(m) > 0) & (F.coalesce(F.try_element_at(m, F.lit("France")), F.lit(0)) == F.array_max(F.map_values(m))), F.lit(False))


def slash_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), "/"), lambda x: F.trim(x)), lambda x: x != "")


def reward(s: Column) -> Column:
    """'2023 | Lauréat : Prix' -> (year, distinction, award), all text; without ':' there is no distinction, without '|' an award only."""
    bar = F.split(s, r"\|")
    rest = F.get(bar, F.lit(1))
    colon = F.split(rest, ":")
    piped, named = F.contains(s, F.lit("|")), F.contains(rest, F.lit(":"))
    return F.struct(
        F.when(piped, F.trim(F.get(bar, F.lit(0)))).alias("year"),
        F.when(piped & named, F.trim(F.get(colon, F.lit(0)))).alias("distinction"),
        F.when(piped & named, F.trim(F.get(colon, F.lit(1)))).when(piped, F.trim(rest)).otherwise(F.trim(s)).alias("award"),
    )


def name_list(s: Column) -> Column:
    """A JSON array of names in a cell; null for anything else."""
    return F.from_json(s, "array<string>")


def credit_list(s: Column) -> Column:
    """A JSON array of {role, name}; entries without either are dropped."""
    got = F.from_json(s, "array<struct<role:string,name:string>>")
    return F.filter(got, lambda e: (F.coalesce(e["role"], F.lit("")) != "") & (F.coalesce(e["name"], F.lit("")) != ""))


def visa(x: Column) -> Column:
    """A visa number as text without a fraction."""
    return x.try_cast("double").try_cast("bigint").cast("string")
