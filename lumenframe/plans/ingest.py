"""Ingest pipelines: approval sheets, film details, awards, predictions. Tables in, tables out; unknown roles and festivals are set aside, not raised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions import parse as P
from lumenframe.functions.text import clean_title, first_name, last_name, remove_extra_spaces
from lumenframe.operators import upsert as U
from lumenframe.operators.settle import settled
from lumenframe.operators.trigrams import arrivals

Tables = dict[str, DataFrame]


def in_file_order(raw: DataFrame, otherwise: list[str]) -> DataFrame:
    """raw with row_id, the number of each row in its file: as it is given (see files.numbered), or in order of other columns where it is not."""
    if "row_id" in raw.columns:
        return raw.withColumn("row_id", F.col("row_id").cast("long"))
    return U.with_ids(raw, raw.limit(0).select(F.lit(0).alias("row_id")), otherwise, "row_id", kind="long")


def run(spark: SparkSession, root: str, step: Callable[..., tuple[Tables, DataFrame] | Tables], raw: DataFrame, **given) -> tuple[int, DataFrame | None]:
    """One ingest (sheets, details, awards, predictions) of the tables stored under root, all or nothing: (version, what it set aside).

    Missing tables are made empty. If another writer changes the tables meanwhile, the ingest is made anew from what is there then.
    """
    aside: list[DataFrame | None] = []

    def change(tables: Tables) -> Tables:
        done = step({n: schema.create(spark, n) for n in schema.DDL} | tables, raw, **given)
        new, rest = done if isinstance(done, tuple) else (done, None)
        aside[:] = [settled(rest) if rest is not None else None]
        return new

    return U.transaction(spark, root, change), aside[0]


def clean_sheets(raw: DataFrame) -> DataFrame:
    """Typed columns from the text cells of approval sheets."""
    c = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    return raw.select(
        *[F.col(n).cast("long").alias(n) for n in ("row_id",) if n in raw.columns], P.visa(c("visa_number")).alias("visa_number"), clean_title(c("original_name")).alias("original_name"), P.slash_list(c("directors_names")).alias("directors"), P.slash_list(c("producers_names")).alias("producers"),
        P.number(c("budget")).alias("budget"), c("cnc_agrement_year").try_cast("int").alias("cnc_agrement_year"), P.rank(c("cnc_rank")).alias("cnc_rank"),
        F.replace(F.coalesce(c("asr"), F.lit("")), F.lit("apres"), F.lit("après")).alias("asr"),
        *[P.flag(c(x)).alias(x) for x in ("parity_bonus", "sofica_funding", "tax_credit", "regional_funding", "eof")],
        P.allocations(c("film_country_budget_allocation_rates")).alias("allocations"), P.broadcasters(c("paying_broadcasters"), True).alias("paying"), P.broadcasters(c("free_broadcasters"), False).alias("free"),
    ).withColumns({"budget_category": P.budget_category(F.col("budget")), "is_french_financed": P.is_french_financed(F.col("allocations")), "broadcasters": P.all_broadcasters(F.col("paying"), F.col("free"))})


def holders(names: DataFrame, genders: DataFrame | None = None) -> DataFrame:
    """(kind, name) -> the columns of credit_holders; people's names are split and their gender looked up by first name, else 'unknown'."""
    person = F.col("kind") == "Individual"
    clean = remove_extra_spaces(F.col("name"))
    out = names.select("kind", "name").distinct().select(
        "name", F.col("kind").alias("type"), F.when(person, first_name(clean)).alias("first_name"), F.when(person, last_name(clean)).alias("last_name"), F.when(~person, clean).alias("legal_name")
    )
    if genders is None:
        return out.withColumn("gender", F.when(F.col("type") == "Individual", "unknown"))
    known = U.first_of(genders.select(F.initcap("first_name").alias("__first"), F.col("gender").alias("__gender")), ["__first"])
    joined = out.join(known, F.initcap("first_name") == F.col("__first"), "left")
    return joined.withColumn("gender", F.when(F.col("type") == "Individual", F.coalesce("__gender", F.lit("unknown")))).drop("__first", "__gender")


_HOLDER_KEY = ["type", "first_name", "last_name", "legal_name", "gender"]


def with_roles(t: Tables, rows: DataFrame, known: DataFrame | None) -> Tables:
    """The tables with those known roles (name, allocine_name, is_key_role, inclusive_name) added that rows name and the table lacks."""
    if known is None:
        return t
    wanted = rows.select(F.lower("role").alias("label")).distinct()
    have = t["roles"].select(F.lower("name").alias("label")).unionByName(t["roles"].select(F.lower("allocine_name").alias("label"))).where("label is not null")
    missing = wanted.join(have, "label", "left_anti")
    labelled = known.withColumn("label", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("allocine_name")))))
    fresh = labelled.join(missing, "label", "left_semi").drop("label")
    return dict(t) | {"roles": U.find_or_create(t["roles"], fresh.select("name", "allocine_name", "is_key_role", "inclusive_name"), ["name"])}


def add_credits(t: Tables, rows: DataFrame, genders: DataFrame | None = None, known_roles: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """rows: (film_id, role, kind, name), role by name or by the source's label; a role that the table lacks is made if it is among the known ones. Returns the tables with holders and credits added, and the rows whose role is unknown."""
    t = with_roles(t, rows, known_roles)
    by_name = t["roles"].select(F.col("id").alias("role_id"), F.lower("name").alias("label")).unionByName(t["roles"].select(F.col("id").alias("role_id"), F.lower("allocine_name").alias("label")))
    known = by_name.where("label is not null").groupBy("label").agg(F.min("role_id").alias("role_id"))  # the first of several
    found = settled(rows.withColumn("label", F.lower("role")).join(known, "label", "left").drop("label"))
    good, unknown = found.where("role_id is not null"), found.where("role_id is null").drop("role_id")
    made = settled(holders(good.select("kind", "name"), genders))
    out = dict(t)
    out["credit_holders"] = U.find_or_create(t["credit_holders"], made.drop("name"), _HOLDER_KEY)
    ids = out["credit_holders"].groupBy(*_HOLDER_KEY).agg(F.min("id").alias("credit_holder_id"))
    named = made.join(ids, [made[k].eqNullSafe(ids[k]) for k in _HOLDER_KEY]).select("name", made["type"].alias("kind"), "credit_holder_id")
    triples = good.join(named, ["kind", "name"]).select("film_id", "role_id", "credit_holder_id")
    out["film_credits"] = U.find_or_create(t["film_credits"], triples, ["film_id", "role_id", "credit_holder_id"])
    return out, unknown


def sheets(t: Tables, raw: DataFrame, known_roles: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """Films that the tables lack, with their countries, allocations and broadcasters. A film without a visa is always new. Of several rows of a visa the first by
    year and title counts; of those that are equal in both the first by row_id, or, without it, by the other columns."""
    clean = clean_sheets(raw)
    order = ["cnc_agrement_year", "original_name", *(["row_id"] if "row_id" in raw.columns else [F.array_sort(F.map_entries(n)) if n == "allocations" else n for n in clean.columns if n not in ("cnc_agrement_year", "original_name", "visa_number")])]
    fresh = clean.join(t["films"].select("visa_number").where("visa_number is not null").distinct(), "visa_number", "left_anti")
    numbered = fresh.where("visa_number is null").withColumn("__n", F.lit(1)).unionByName(fresh.where("visa_number is not null").withColumn("__n", F.row_number().over(Window.partitionBy("visa_number").orderBy(*order)))).where("__n = 1").drop("__n")
    films = settled(U.with_ids(numbered, t["films"], ["cnc_agrement_year", "visa_number", *order[1:]]).drop("row_id"))
    out = dict(t)
    out["films"] = t["films"].unionByName(films.drop("allocations", "paying", "free", "directors", "producers"), allowMissingColumns=True)
    shares = films.select(F.col("id").alias("film_id"), F.explode("allocations").alias("name", "budget_allocation"))
    out["countries"] = U.find_or_create(t["countries"], shares.select("name"), ["name"])
    allocated = shares.join(out["countries"].select(F.col("id").alias("country_id"), "name"), "name").select("country_id", "film_id", F.col("budget_allocation").cast("double"))
    out["film_country_budget_allocations"] = U.keep_first(t["film_country_budget_allocations"], allocated, ["country_id", "film_id"], ["budget_allocation"])
    rows = None
    for column, role in (("paying", "paying_broadcaster"), ("free", "free_broadcaster")):
        own = films.select(F.col("id").alias("film_id"), F.lit(role).alias("role"), F.lit("Company").alias("kind"), F.explode(column).alias("name"))
        rows = own if rows is None else rows.unionByName(own)
    return add_credits(out, rows, None, known_roles)


_SECTIONS = ["Scénaristes", "Production", "Equipe technique", "Soundtrack", "Distribution", "Sociétés"]


def details(t: Tables, raw: DataFrame, genders: DataFrame | None = None, known_roles: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """Release dates, durations, genres, posters, trailers and credits for known films that lack date or duration. Of several rows of a film the first by row_id counts, or, without it, by the other columns."""
    films = t["films"].where(~(F.col("release_date").isNotNull() & F.col("duration_minutes").isNotNull())).select(F.col("id").alias("film_id"), "visa_number")
    order = ["row_id"] if "row_id" in raw.columns else None
    rows = settled(U.first_of(raw.withColumn("visa_number", P.visa(F.col("visa_number"))).join(films, "visa_number"), ["film_id"], order).drop("row_id"))
    new = rows.select(F.col("film_id").alias("id"), F.col("allocine_id").try_cast("int").alias("allocine_id"), P.release_date(F.col("release_date")).alias("release_date"), P.duration(F.col("duration")).alias("duration_minutes"), P.genre_categories(P.name_list(F.col("genres"))).alias("genre_categories"))
    out = dict(t)
    out["films"] = U.update(t["films"], new, ["id"])
    for table, column, source in (("trailers", "url", "trailer_url"), ("posters", "image_base64", "poster_url")):
        given = rows.where(F.coalesce(F.col(source), F.lit("")) != "").select("film_id", F.col(source).alias(column))
        old = U.create_or_update(t[table], given, ["film_id"])
        out[table] = old.where("id is not null").unionByName(U.with_ids(old.where("id is null").drop("id"), t[table], ["film_id"]))
    named = rows.select("film_id", F.explode(P.name_list(F.col("genres"))).alias("g")).select("film_id", F.lower(F.trim("g")).alias("name")).where("name <> ''")
    out["genres"] = U.find_or_create(t["genres"], named.select("name"), ["name"])
    pairs = named.join(out["genres"].groupBy("name").agg(F.min("id").alias("genre_id")), "name").select("film_id", "genre_id").distinct()
    out["films_genres"] = U.keep_first(t["films_genres"], pairs, ["film_id", "genre_id"], ["genre_id"])
    entries = None
    for column, role in (("Casting", "actor"), ("Direction", "director")):
        own = rows.select("film_id", F.lit(role).alias("role"), F.lit("Individual").alias("kind"), F.explode(P.name_list(F.col(column))).alias("name"))
        entries = own if entries is None else entries.unionByName(own)
    for column in _SECTIONS:
        if column in raw.columns:
            kind = "Company" if column == "Sociétés" else "Individual"
            own = rows.select("film_id", F.explode(P.credit_list(F.col(column))).alias("e")).select("film_id", F.col("e.role").alias("role"), F.lit(kind).alias("kind"), F.col("e.name").alias("name"))
            entries = entries.unionByName(own)
    return add_credits(out, entries, genders, known_roles)


def awards(t: Tables, raw: DataFrame, festivals: DataFrame, labels: DataFrame | None = None, genders: DataFrame | None = None, known_roles: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """raw: (title, director, country, festival, year, distinction, reward or award). Rows come in the order of row_id (see in_file_order): each joins its director's most similar film among those that are there by then, or makes one. festivals: the known ones
    (name, description, image_base64, country). Returns the tables and the rows of unknown festivals."""
    reward = "reward" if "reward" in raw.columns else "award"
    rows = in_file_order(raw.withColumnRenamed(reward, "mubi_label"), ["title", "director", "festival", "year"])
    out = dict(t)
    out["countries"] = U.find_or_create(t["countries"], rows.select(F.col("country").alias("name")).where("name is not null"), ["name"])
    role = t["roles"].where(F.lower("name") == "director").select(F.col("id").alias("role_id"))
    people = t["film_credits"].join(role, "role_id", "left_semi").join(t["credit_holders"].select(F.col("id").alias("credit_holder_id"), "first_name", "last_name"), "credit_holder_id")
    matched = settled(arrivals(rows, t["films"], people.select("film_id", "first_name", "last_name")))
    made = settled(U.with_ids(matched.where("founder = row_id").select("row_id", F.col("title").alias("original_name"), "director"), t["films"], ["row_id"]))
    out["films"] = t["films"].unionByName(made.select("id", "original_name"), allowMissingColumns=True)
    out, _ = add_credits(out, made.select(F.col("id").alias("film_id"), F.lit("director").alias("role"), F.lit("Individual").alias("kind"), F.col("director").alias("name")), genders, known_roles)
    full = settled(matched.join(made.select(F.col("id").alias("__made"), F.col("row_id").alias("founder")), "founder", "left").withColumn("film_id", F.coalesce("film_id", "__made")).drop("founder", "__made", "score"))
    c = out["countries"].select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    out["film_country_budget_allocations"] = U.keep_first(out["film_country_budget_allocations"], full.join(c, "country").select("country_id", "film_id", F.lit(100.0).alias("budget_allocation")), ["country_id", "film_id"], ["film_id"])
    known = festivals.select(F.lower("name").alias("__f"), F.col("name").alias("festival_name"), "description", "image_base64", F.col("country").alias("__country"))
    placed = full.withColumn("__f", F.lower("festival")).join(known, "__f", "left").drop("__f")
    good, unknown = placed.where("festival_name is not null"), placed.where("festival_name is null").select("title", "director", "festival", "year")
    out["countries"] = U.find_or_create(out["countries"], good.select(F.col("__country").alias("name")), ["name"])
    wanted_f = good.select("festival_name", "description", "image_base64", "__country").distinct().join(out["countries"].select(F.col("id").alias("country_id"), F.col("name").alias("__country")), "__country").select(F.col("festival_name").alias("name"), "description", "image_base64", "country_id")
    out["festivals"] = U.find_or_create(t["festivals"], wanted_f, ["name"])
    good = settled(good.join(out["festivals"].select(F.col("id").alias("festival_id"), F.col("name").alias("festival_name")), "festival_name"))
    labelled = good.select("mubi_label", "festival_id").where("mubi_label is not null").distinct()
    if labels is not None:
        labelled = labelled.join(U.first_of(labels.select(F.trim("mubi_label").alias("__l"), "english_label", "french_label"), ["__l"]), F.trim("mubi_label") == F.col("__l"), "left").drop("__l")
    else:
        labelled = labelled.withColumns({"english_label": F.lit(None).cast("string"), "french_label": F.lit(None).cast("string")})
    labelled = labelled.withColumns({"english_label": F.coalesce("english_label", F.lit("")), "french_label": F.coalesce("french_label", F.lit(""))})
    out["festival_awards"] = U.find_or_create(t["festival_awards"], labelled, ["mubi_label", "festival_id"])
    ids = out["festival_awards"].select(F.col("id").alias("award_id"), "mubi_label", "festival_id")
    noms = good.join(ids, ["mubi_label", "festival_id"]).select("film_id", "award_id", (F.col("distinction") == "Lauréat").alias("is_winner"), F.make_date(F.col("year").try_cast("int"), F.lit(1), F.lit(1)).alias("date"), "row_id").where("date is not null").withColumn("is_winner", F.coalesce("is_winner", F.lit(False)))
    # the first nomination of a film for an award stays, whatever its year
    first = noms.withColumn("__n", F.row_number().over(Window.partitionBy("film_id", "award_id").orderBy("row_id"))).where("__n = 1").drop("__n", "row_id")
    out["award_nominations"] = U.find_or_create(t["award_nominations"], first, ["film_id", "award_id"])
    return out, unknown


def predictions(t: Tables, raw: DataFrame, kind: str) -> Tables:
    """kind: poster or trailer. The named films' characters are deleted and inserted anew; running it twice gives the same."""
    parent, child, reference = f"{kind}s", f"{kind}_characters", f"{kind}_id"
    measures = ["poster_percentage"] if kind == "poster" else ["time_on_screen", "average_size_on_screen"]
    text = lambda c: F.lower(F.trim(c))
    films = t["films"].select(F.col("id").alias("film_id"), "visa_number")
    first = t[parent].groupBy("film_id").agg(F.min("id").alias(reference))
    rows = raw.withColumn("visa_number", P.visa(F.col("visa_number"))).join(films, "visa_number").join(first, "film_id")
    new = rows.select(reference, text(F.col("gender")).alias("gender"), _age("age_min"), _age("age_max"), F.col("ethnicity"), *[P.number(F.col(m)).alias(m) for m in measures])
    kept = U.delete_where(t[child], new, [reference])
    out = dict(t)
    out[child] = kept.unionByName(U.with_ids(new, t[child], [reference, *measures, "gender"]), allowMissingColumns=True)
    return out


def _age(column: str) -> Column:
    return P.age(F.col(column)).alias(column)


def crawl_matches(films: DataFrame, pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """films (film_id, visa_number, ...) not in the ledger, with the first film that their search page (visa_number, html) shows, and a status."""
    from lumenframe.sources.pages import first_film
    from lumenframe.streaming.ledger import unseen, with_status

    found = pages.select("visa_number", first_film(F.col("html")).alias("hit"), F.col("html").isNull().alias("failed")).select("visa_number", "failed", F.col("hit.id").alias("allocine_id"), F.col("hit.title").alias("allocine_title"), F.col("hit.link").alias("allocine_url"))
    return with_status(unseen(films, ledger, ["visa_number"]), found, ["visa_number"], "allocine_id")


def enrich_matches(matches: DataFrame, details_: DataFrame) -> DataFrame:
    """matches with details (allocine_id, allocine_visa_number, ...) where the id is a positive whole number and the visas do not contradict; all other rows pass as they are."""
    usable = matches.withColumn("__id", F.expr("try_cast(allocine_id as bigint)"))
    joined = usable.join(details_.withColumnRenamed("allocine_id", "__id"), "__id", "left")
    own, theirs = F.expr("try_cast(visa_number as bigint)"), F.coalesce(F.expr("try_cast(allocine_visa_number as bigint)"), F.lit(-1))
    clash = (F.coalesce(own, F.lit(0)) > 0) & (theirs > 0) & (own != theirs)
    extra = [c for c in details_.columns if c not in matches.columns and c != "allocine_id"]
    return joined.select(*matches.columns, *[F.when((F.col("__id") > 0) & ~F.coalesce(clash, F.lit(False)), F.col(c)).alias(c) for c in extra])
