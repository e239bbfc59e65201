"""The composed queries: film and festival documents, search, directors. Each is one plan for all films asked for, without a loop over films."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.parse import format_duration
from lumenframe.functions.text import capitalize, display_name, full_name
from lumenframe.operators import metrics as M

Tables = dict[str, DataFrame]

FILM_COLUMNS = ["id", "original_name", "visa_number", "release_date", "duration_minutes", "budget", "parity_bonus", "genre_categories", "broadcasters", "budget_category", "is_french_financed"]
ERRORS = {"festival": "Festival not found", "years": "No nominations for this festival", "year": "Year not available", "awards": "No awards for this year", "award": "Award not available"}


def credits(t: Tables) -> DataFrame:
    """(film_id, role, is_key_role, inclusive_name, type, gender, name): every credit with its role and holder."""
    roles = t["roles"].select(F.col("id").alias("role_id"), F.col("name").alias("role"), "is_key_role", "inclusive_name", "allocine_name")
    holders = t["credit_holders"].select(F.col("id").alias("credit_holder_id"), "type", "gender", full_name(F.col("type"), F.col("first_name"), F.col("last_name"), F.col("legal_name")).alias("name"))
    return t["film_credits"].select(F.col("id").alias("credit_id"), "film_id", "role_id", "credit_holder_id").join(F.broadcast(roles), "role_id").join(holders, "credit_holder_id")


def film_shares(t: Tables) -> DataFrame:
    """(film_id, female_representation_in_key_roles, female_representation_in_casting) among known-gender individuals."""
    person = F.col("type") == "Individual"
    return credits(t).groupBy("film_id").agg(
        M.female_share(F.col("gender"), person & F.col("is_key_role")).alias("female_representation_in_key_roles"),
        M.female_share(F.col("gender"), person & (F.lower("role") == "actor")).alias("female_representation_in_casting"),
    )


def trailer_times(t: Tables) -> DataFrame:
    """(film_id, trailer_url, female_screen_time, non_white_screen_time) of each film's first trailer; null without characters."""
    first = M.first_by(t["trailers"], ["film_id"], ["id"]).select(F.col("id").alias("trailer_id"), "film_id", F.col("url").alias("trailer_url"))
    sums = t["trailer_characters"].groupBy("trailer_id").agg(
        M.female_time(F.col("gender"), F.col("time_on_screen")).alias("female_screen_time"), M.non_white_time(F.col("ethnicity"), F.col("time_on_screen")).alias("non_white_screen_time")
    )
    return first.join(sums, "trailer_id", "left").drop("trailer_id")


def poster_shares(t: Tables) -> DataFrame:
    """(film_id, poster, female_visible_ratio_on_poster, non_white_visible_ratio_on_poster) of each film's first poster; null without characters."""
    first = M.first_by(t["posters"], ["film_id"], ["id"]).select(F.col("id").alias("poster_id"), "film_id", F.col("image_base64").alias("poster"))
    means = t["poster_characters"].groupBy("poster_id").agg(
        M.female_poster_share(F.col("gender"), F.col("poster_percentage")).alias("female_visible_ratio_on_poster"), M.non_white_poster_share(F.col("ethnicity"), F.col("poster_percentage")).alias("non_white_visible_ratio_on_poster")
    )
    return first.join(means, "poster_id", "left").drop("poster_id")


def genres(t: Tables) -> DataFrame:
    g = t["genres"].select(F.col("id").alias("genre_id"), capitalize(F.col("name")).alias("genre"))
    return t["films_genres"].join(g, "genre_id").groupBy("film_id").agg(F.array_sort(F.collect_list("genre")).alias("genres"))


def countries_by_budget(t: Tables) -> DataFrame:
    """(film_id, countries_sorted_by_budget): largest share first, ties by name."""
    c = t["countries"].select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    known = t["film_country_budget_allocations"].where("budget_allocation is not null").join(c, "country_id")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("budget_allocation")).alias("a"), "country")))
    return known.groupBy("film_id").agg(F.transform(ordered, lambda s: s["country"]).alias("countries_sorted_by_budget"))


def nominations(t: Tables) -> DataFrame:
    """(film_id, awards): each film's nominations with festival and award, by date and id."""
    a = t["festival_awards"].select(F.col("id").alias("award_id"), display_name(F.col("mubi_label"), F.col("french_label")).alias("award_name"), "festival_id")
    f = t["festivals"].select(F.col("id").alias("festival_id"), F.col("name").alias("festival_name"))
    rows = t["award_nominations"].select(F.col("id").alias("nomination_id"), "film_id", "award_id", "date", "is_winner").join(a, "award_id").join(f, "festival_id")
    entry = F.struct("date", "nomination_id", "award_id", "award_name", "festival_id", "festival_name", "is_winner")
    return rows.groupBy("film_id").agg(F.array_sort(F.collect_list(entry)).alias("awards"))


GROUPS = ("distribution", "production", "co-production", "financiers")
_ENTRY = "role string, is_key_role boolean, is_company boolean, name string, gender string"


def credit_groups(t: Tables) -> DataFrame:
    """(film_id, casting, key_roles, distribution, production, co-production, financiers): overlapping lists in order of the credits. People and companies are
    cast or have key roles alike; the other lists are of companies, financiers being broadcasters."""
    role, company = F.col("role"), F.col("type") == "Company"
    entry = F.struct("credit_id", "role", "is_key_role", company.alias("is_company"), "name", "gender")
    bucket = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, entry))), lambda e: e.dropFields("credit_id"))
    return credits(t).groupBy("film_id").agg(
        bucket(role == "actor").alias("casting"), bucket(F.col("is_key_role")).alias("key_roles"),
        bucket(company & (role == "distribution")).alias("distribution"), bucket(company & (role == "production")).alias("production"),
        bucket(company & (role == "co_production")).alias("co-production"), bucket(company & role.isin("free_broadcaster", "paying_broadcaster")).alias("financiers"),
    )


def shown_groups(document: Column) -> Column:
    """map<group, entries> of a document's company groups that have any; empty ones are not shown."""
    groups = F.array(*[F.struct(F.lit(g).alias("key"), document[g].alias("value")) for g in GROUPS])
    return F.map_from_entries(F.filter(groups, lambda g: F.size(g["value"]) > 0))


def of_films(t: Tables, ids: DataFrame) -> Tables:
    """The tables with those rows only that belong to the films of ids (film_id); what follows reads nothing of other films."""
    out = {name: df.join(ids, "film_id", "left_semi") if "film_id" in df.columns else df for name, df in t.items()}
    for parent, child, key in (("trailers", "trailer_characters", "trailer_id"), ("posters", "poster_characters", "poster_id")):
        out[child] = t[child].join(out[parent].select(F.col("id").alias(key)), key, "left_semi")
    return out


def film_details(t: Tables, film_ids: Column | None = None) -> DataFrame:
    """A document per film, with empty lists where it has none; `film_ids` is a condition on films.id, which reaches the scan and, by semi-joins, every part."""
    films = t["films"] if film_ids is None else t["films"].where(film_ids)
    if film_ids is not None:
        t = of_films(t, films.select(F.col("id").alias("film_id")))
    return _details(t, films)


def _details(t: Tables, films: DataFrame) -> DataFrame:
    out = films.select(*[c for c in FILM_COLUMNS if c in films.columns]).withColumn("duration", format_duration(F.col("duration_minutes"))).withColumnRenamed("id", "film_id")
    for part in (genres, countries_by_budget, credit_groups, nominations, film_shares, trailer_times, poster_shares):
        out = out.join(part(t), "film_id", "left")
    none = F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':') for f in _ENTRY.split(', '))}>>")
    lists = lambda *names: [F.coalesce(F.col(f"`{n}`"), none).alias(n) for n in names]
    companies = F.struct(*lists(*GROUPS), F.when(F.col("budget") != 0, F.col("budget")).alias("budget"))
    out = out.withColumn("credits", F.struct(*lists("casting", "key_roles"), companies.alias("distribution"))).drop("casting", "key_roles", *GROUPS)
    for c in ("genres", "countries_sorted_by_budget", "awards"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(dict(out.dtypes)[c])))
    return out


def directors(t: Tables) -> DataFrame:
    """(film_id, directors): names of each film's individual directors, in order of their credits."""
    rows = credits(t).where((F.lower("role") == "director") & (F.col("type") == "Individual"))
    return rows.groupBy("film_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("credit_id", "name"))), lambda s: s["name"]).alias("directors"))


def search(t: Tables, text: str, limit: int = 5, escape_wildcards: bool = False) -> DataFrame:
    """Films with a visa whose name holds the text in any case; the shortest names first. % and _ are wildcards unless escaped."""
    if escape_wildcards:
        text = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    hits = t["films"].where(F.ilike(F.lower("original_name"), F.lit(f"%{text.lower()}%"))).where(F.col("visa_number").isNotNull()).orderBy(F.length("original_name"), "original_name", "id").limit(limit)
    t = of_films(t, hits.select(F.col("id").alias("film_id")))
    posters = M.first_by(t["posters"], ["film_id"], ["id"]).select("film_id", F.col("image_base64").alias("poster"))
    return hits.select(F.col("id").alias("film_id"), "original_name", F.year("release_date").alias("release_year")).join(posters, "film_id", "left").join(directors(t), "film_id", "left").orderBy(F.length("original_name"), "original_name", "film_id")


def festival_years(t: Tables, festival_id: int) -> DataFrame:
    """Years with nominations, newest first."""
    a = t["festival_awards"].where(F.col("festival_id") == festival_id).select(F.col("id").alias("award_id"))
    return t["award_nominations"].join(a, "award_id", "left_semi").select(F.year("date").alias("year")).distinct().orderBy(F.desc("year"))


def festival_awards(t: Tables, festival_id: int, year: int | None = None) -> DataFrame:
    """A festival's awards, those with nominations in a year if one is given, by French label with nulls last."""
    out = t["festival_awards"].where(F.col("festival_id") == festival_id)
    if year is not None:
        out = out.join(in_year(t["award_nominations"], "date", year).select(F.col("award_id").alias("id")).distinct(), "id", "left_semi")
    return out.orderBy(F.col("french_label").asc_nulls_last(), "id")


def in_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows dated in a year, as a range that a scan can prune by."""
    return df.where(F.col(column).between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31))))


def festival_metrics(t: Tables, festival_id: int, year: int) -> DataFrame:
    """Shares of women among the directors of nominated and of awarded films of a festival's year; a row per director and nomination counts."""
    a = t["festival_awards"].where(F.col("festival_id") == festival_id).select(F.col("id").alias("award_id"))
    rows = in_year(t["award_nominations"], "date", year).join(a, "award_id", "left_semi").select("film_id", "is_winner")
    people = credits(t).where(F.col("role") == "director").select("film_id", F.lower("gender").alias("gender"))
    return rows.join(people, "film_id").agg(M.female_share(F.col("gender")).alias("female_nominated_percentage"), M.female_share(F.col("gender"), F.col("is_winner")).alias("female_awarded_percentage"))


def festival_details(t: Tables, festival_id: int, year: int | None = None, award_id: int | None = None) -> DataFrame | str:
    """The page of a festival: a row for each nomination of a year and award, with its film, the festival, its years and the year's awards; or the reason
    there is none. 0 counts as not given.

    Two bounded lists come to the driver, a festival's years and a year's awards; all films are then one plan, which reads only what belongs to them.
    """
    festival = t["festivals"].where(F.col("id") == festival_id)
    if festival.isEmpty():
        return ERRORS["festival"]
    years = [r["year"] for r in festival_years(t, festival_id).collect()]
    if not years:
        return ERRORS["years"]
    year = year or years[0]
    if year not in years:
        return ERRORS["year"]
    awards = [(r["id"], r["name"]) for r in festival_awards(t, festival_id, year).select("id", display_name(F.col("mubi_label"), F.col("french_label")).alias("name")).collect()]
    if not awards:
        return ERRORS["awards"]
    if award_id and award_id not in dict(awards):
        return ERRORS["award"]
    award_id = award_id or awards[0][0]
    rows = in_year(t["award_nominations"], "date", year).where(F.col("award_id") == award_id).select(F.col("id").alias("nomination_id"), "film_id", "date", "is_winner")
    wanted = of_films(t, rows.select("film_id").distinct())
    films = t["films"].join(rows.select(F.col("film_id").alias("id")).distinct(), "id", "left_semi")
    films = _details(wanted, films).select("film_id", "original_name", "release_date", "poster", "female_representation_in_key_roles", "female_representation_in_casting")
    listed = rows.join(films, "film_id").join(directors(wanted), "film_id", "left")
    names = F.array(*[F.struct(F.lit(i).alias("award_id"), F.lit(n).cast("string").alias("name")) for i, n in awards])
    head = festival.select(
        F.col("id").alias("festival_id"), F.col("name").alias("festival_name"), "description", F.nullif("image_base64", F.lit("")).alias("image_base64"), F.lit(year).alias("year"), F.lit(award_id).alias("award_id"),
        F.lit(dict(awards)[award_id]).cast("string").alias("award_name"), F.array(*map(F.lit, years)).alias("available_years"), names.alias("available_awards"),
    )
    return listed.join(F.broadcast(head)).join(F.broadcast(festival_metrics(t, festival_id, year)))  # a row each


def winners_and_nominees(page: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A festival page's rows split: winners, and those that were only nominated."""
    won = F.coalesce("is_winner", F.lit(False))
    return page.where(won), page.where(~won)


def dashboard(t: Tables, dimension: str) -> DataFrame:
    """Films by a dashboard dimension; lists in text count once for each entry."""
    return t["films"].select(F.explode_outer(F.split(F.col(dimension).cast("string"), ", ")).alias(dimension)).groupBy(dimension).agg(F.count("*").alias("films"))
