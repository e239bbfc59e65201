"""Schemas of the fifteen tables, their keys and checks, and schema versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from graphlib import TopologicalSorter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns and types; `not null` where a value is required.
DDL = {
    "films": "id int not null, original_name string not null, visa_number string, release_date date, duration_minutes int, budget double, parity_bonus boolean, eof boolean, asr string, sofica_funding boolean, tax_credit boolean, regional_funding boolean, cnc_agrement_year int, cnc_rank int, allocine_id int, mubi_id int, budget_category string, genre_categories string, broadcasters string, is_french_financed boolean",
    "genres": "id int not null, name string not null",
    "films_genres": "film_id int not null, genre_id int not null",
    "countries": "id int not null, name string not null",
    "film_country_budget_allocations": "country_id int not null, film_id int not null, budget_allocation double not null",
    "trailers": "id int not null, url string not null, film_id int not null",
    "trailer_characters": "id int not null, trailer_id int not null, gender string, age_min int, age_max int, ethnicity string, time_on_screen double, average_size_on_screen double",
    "posters": "id int not null, image_base64 string not null, film_id int not null",
    "poster_characters": "id int not null, poster_id int not null, gender string, age_min int, age_max int, ethnicity string, poster_percentage double",
    "roles": "id int not null, name string not null, allocine_name string, is_key_role boolean not null, inclusive_name string",
    "credit_holders": "id int not null, type string not null, first_name string, last_name string, legal_name string, gender string, birthdate date",
    "film_credits": "id int not null, film_id int not null, role_id int not null, credit_holder_id int not null",
    "festivals": "id int not null, name string not null, description string not null, image_base64 string not null, country_id int not null",
    "festival_awards": "id int not null, mubi_label string not null, english_label string, french_label string, festival_id int not null",
    "award_nominations": "id int not null, film_id int not null, credit_holder_id int, award_id int not null, date date not null, is_winner boolean not null",
}
PRIMARY_KEYS = {t: ["id"] for t in DDL} | {"films_genres": ["film_id", "genre_id"], "film_country_budget_allocations": ["country_id", "film_id"]}
UNIQUE = {"countries": ["name"]}
FOREIGN_KEYS = [
    ("films_genres", "film_id", "films"), ("films_genres", "genre_id", "genres"),
    ("film_country_budget_allocations", "film_id", "films"), ("film_country_budget_allocations", "country_id", "countries"),
    ("trailers", "film_id", "films"), ("trailer_characters", "trailer_id", "trailers"), ("posters", "film_id", "films"), ("poster_characters", "poster_id", "posters"),
    ("film_credits", "film_id", "films"), ("film_credits", "role_id", "roles"), ("film_credits", "credit_holder_id", "credit_holders"),
    ("festivals", "country_id", "countries"), ("festival_awards", "festival_id", "festivals"),
    ("award_nominations", "film_id", "films"), ("award_nominations", "award_id", "festival_awards"), ("award_nominations", "credit_holder_id", "credit_holders"),
]
HOLDER_TYPES = ("Company", "Individual")


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def create(spark: SparkSession, table: str) -> DataFrame:
    """An empty table."""
    return spark.createDataFrame([], schema(table))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference is set and points nowhere."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, n) of every key, uniqueness, reference and value check that fails."""
    found = []
    for t, df in tables.items():
        for key in [PRIMARY_KEYS[t], *([UNIQUE[t]] if t in UNIQUE else [])]:
            found.append(duplicate_keys(df, key).agg(F.count("*").alias("n")).select(F.lit(f"{t}: {'+'.join(key)} repeated").alias("check"), "n"))
    for child, column, parent in FOREIGN_KEYS:
        if child in tables and parent in tables:
            found.append(orphans(tables[child], column, tables[parent]).agg(F.count("*").alias("n")).select(F.lit(f"{child}.{column} not in {parent}").alias("check"), "n"))
    if "credit_holders" in tables:
        bad = tables["credit_holders"].where(~F.coalesce(F.col("type").isin(*HOLDER_TYPES), F.lit(False)))
        found.append(bad.agg(F.count("*").alias("n")).select(F.lit("credit_holders.type").alias("check"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


# --- cascades -----------------------------------------------------------------------------------------------------------------------


def parents_first(tables: Iterable[str], references: Sequence[tuple] = FOREIGN_KEYS) -> list[str]:
    """The tables so that each comes after those that it refers to. references: (child, column, parent) or (child, column, parent, the parent's key)."""
    above: dict[str, set[str]] = {t: set() for t in tables}
    for child, _, parent, *_ in references:
        if child in above and parent in above and child != parent:
            above[child].add(parent)
    return list(TopologicalSorter(above).static_order())


def truncated(tables: dict[str, DataFrame], names: Iterable[str], references: Sequence[tuple] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """The tables with those named, and all that refer to them directly or by others, emptied."""
    gone = set(names)
    if unknown := gone - set(tables):
        raise KeyError(f"no table {', '.join(sorted(unknown))}")
    for t in parents_first(tables, references):
        if any(child == t and parent in gone for child, _, parent, *_ in references):
            gone.add(t)
    return {t: df.limit(0) if t in gone else df for t, df in tables.items()}


def deleted(tables: dict[str, DataFrame], table: str, rows: DataFrame, key: str = "id", references: Sequence[tuple] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """The tables without the rows of `table` whose key is among rows, and without all rows that refer to a row that goes. A null reference points to nothing.

    One pass parents first: each table loses what points to the rows that its parents lost, by semi- and anti-joins.
    """
    keys = rows.select(F.col(key).alias("__k")).distinct()
    met = lambda df, column, gone, how: df.join(gone, df[column] == gone["__k"], how)
    lost = {table: met(tables[table], key, keys, "left_semi")}
    out = dict(tables) | {table: met(tables[table], key, keys, "left_anti")}
    for child in parents_first(tables, references):
        for _, column, parent, *parent_key in (r for r in references if r[0] == child and r[2] in lost and r[2] != child):
            gone = lost[parent].select(F.col(*(parent_key or ["id"])).alias("__k")).where("__k is not null").distinct()
            pointing = met(out[child], column, gone, "left_semi")
            lost[child] = lost[child].unionByName(pointing) if child in lost else pointing
            out[child] = met(out[child], column, gone, "left_anti")
    return out


# --- versions ---------------------------------------------------------------------------------------------------------------------


class Step(NamedTuple):
    """A change of one table's columns, with the way there and the way back."""

    up: Callable[[DataFrame], DataFrame]
    down: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.up(df)


def _empty(name: str, kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(name, F.lit(None).cast(kind))


def add_column(name: str, kind: str) -> Step:
    """The column is there, without values; back, it is gone."""
    return Step(_empty(name, kind), lambda df: df.drop(name))


def drop_column(name: str, kind: str = "string") -> Step:
    """The column is gone; back, it is there without values."""
    return Step(lambda df: df.drop(name), _empty(name, kind))


def change_type(name: str, kind: str, before: str = "string") -> Step:
    """The column is dropped and added anew, either way: its values are lost."""
    return Step(lambda df: _empty(name, kind)(df.drop(name)), lambda df: _empty(name, before)(df.drop(name)))


def rename_column(name: str, to: str) -> Step:
    """The column keeps its values under another name, either way."""
    return Step(lambda df: df.withColumnRenamed(name, to), lambda df: df.withColumnRenamed(to, name))


History = Sequence[tuple[int, str, Step]]
#: (version, table, step), in order.
VERSIONS: list[tuple[int, str, Step]] = [
    (1, "roles", add_column("allocine_name", "string")),
    (2, "roles", add_column("inclusive_name", "string")),
    (3, "films", change_type("cnc_agrement_year", "int")),
    (4, "films", change_type("asr", "string", "boolean")),
    (5, "films", drop_column("first_language")),
    (6, "films", add_column("budget_category", "string")),
    (7, "films", add_column("genre_categories", "string")),
    (8, "films", add_column("broadcasters", "string")),
    (9, "films", add_column("is_french_financed", "boolean")),
]


def newest(history: History = VERSIONS) -> int:
    return max((v for v, _, _ in history), default=0)


def migrated(df: DataFrame, table: str, since: int, to: int | None = None, history: History = VERSIONS) -> DataFrame:
    """One table brought from a version to another, forth or back."""
    to = newest(history) if to is None else to
    steps = [(v, s) for v, t, s in history if t == table]
    for v, step in steps:
        if since < v <= to:
            df = step.up(df)
    for v, step in reversed(steps):
        if to < v <= since:
            df = step.down(df)
    return df


def migrate(tables: dict[str, DataFrame], since: int = 0, to: int | None = None, history: History = VERSIONS) -> dict[str, DataFrame]:
    """The tables brought from version `since` to the newest, or to another one."""
    return {name: migrated(df, name, since, to, history) for name, df in tables.items()}


def append(spark: SparkSession, root: str, table: str, df: DataFrame, version: int | None = None, history: History = VERSIONS) -> int:
    """Adds rows to a stored table, as files of the schema version that they have; nothing that is there is written again. Returns the commit's version."""
    from lumenframe.operators.upsert import commit

    return commit(spark, root, {f"{table}@{newest(history) if version is None else version}.{uuid.uuid4().hex}": df})


def stored(spark: SparkSession, root: str, table: str, to: int | None = None, history: History = VERSIONS) -> DataFrame:
    """A stored table as the newest schema version has it, or another one: each file set is brought there from its own version as it is read."""
    from lumenframe.operators.upsert import current

    found = [migrated(df, table, int(name.split("@")[1].split(".")[0]), to, history) for name, df in sorted(current(spark, root).items()) if name.split("@")[0] == table]
    if not found:
        raise ValueError(f"no table {table} under {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
