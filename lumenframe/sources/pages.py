"""Lists and records from stored web pages. What a pattern can find is found in the JVM; elements, which nest, in one pass over the page (see markup)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.parse import reward
from lumenframe.sources.markup import Page, Selector

#: Pages whose elements a worker holds at a time.
SENT = 256


def strip_tags(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]*>", ""), r"\s+", " "))


def _each(html: Column, of, kind: str) -> Column:
    """of(page) for each page that is not null, in Arrow batches; what is found goes on after each SENT pages, so that no more is held."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            for i in range(0, len(pages), SENT):
                yield pd.Series([None if h is None else of(Page(h)) for h in pages.iloc[i : i + SENT]], dtype=object)

    return F.pandas_udf(run, kind)(html)


def elements(html: Column, tag: str, css_class: str | None = None) -> Column:
    """The inner markup of each element of a tag, and of a class if given, in order; elements of the same tag inside it are part of it. One never closed gives nothing."""
    return _each(html, lambda p: [p.html[e.start : e.end] for e in p.elements((tag, css_class))], "array<string>")


def element_texts(html: Column, tag: str, css_class: str | None = None) -> Column:
    return _each(html, lambda p: [p.text(e) for e in p.elements((tag, css_class))], "array<string>")


def first_text(html: Column, tag: str, css_class: str | None = None) -> Column:
    return _each(html, lambda p: p.text(p.first((tag, css_class))), "string")


def attribute(markup: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(markup, rf"\b{name}=\"([^\"]*)\"", 1), F.lit(""))


def links(html: Column) -> Column:
    """array<struct<href, text>> of the page's links, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)(<a\b[^>]*\bhref=\"[^\"]*\"[^>]*>.*?)</a>"), F.lit(1))
    return F.transform(found, lambda a: F.struct(attribute(a, "href").alias("href"), strip_tags(a).alias("text")))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)), F.lit(""))


def records(html: Column, tag: str, css_class: str, fields: dict[str, Selector]) -> Column:
    """array<struct> with a row for each element; a field is the text of a (tag, class) in it, or null; a class of '@href' takes that attribute."""
    kind = ", ".join(f"`{n}`: string" for n in fields)
    return _each(html, lambda p: [dict(zip(fields, r, strict=True)) for r in p.records((tag, css_class), list(fields.values()))], f"array<struct<{kind}>>")


def awards(html: Column, tag: str, css_class: str, festival: tuple[str, str | None], text: tuple[str, str | None]) -> Column:
    """array<struct<festival, year, distinction, award>>."""
    found = records(html, tag, css_class, {"festival": festival, "reward": text})
    return F.transform(found, lambda r: F.struct(r["festival"].alias("festival"), reward(r["reward"])["year"].alias("year"), reward(r["reward"])["distinction"].alias("distinction"), reward(r["reward"])["award"].alias("award")))


def first_film(html: Column) -> Column:
    """struct<id, title, link> of the first link to a film's page in search results, null if there is none."""
    hits = F.filter(F.transform(links(html), lambda l: F.struct(F.regexp_extract(l["href"], r"/\w+/fichefilm_gen_c\w+=([0-9]+)\.html", 1).try_cast("bigint").alias("id"), l["text"].alias("title"), l["href"].alias("link"))), lambda h: h["id"].isNotNull())
    return F.get(hits, F.lit(0))


def trailer_url(data_model: Column) -> Column:
    """The best of a player's sources: standard, then medium, high, low."""
    return F.coalesce(*[F.get_json_object(data_model, f"$.videos[0].sources.{q}") for q in ("standard", "medium", "high", "low")])


def duration_cell(text: Column) -> Column:
    """The middle of 'date | 1h 45min | genres', without blanks; null for other shapes."""
    parts = F.split(text, r"\|")
    return F.when(F.size(parts) == 3, F.replace(F.get(parts, F.lit(1)), F.lit(" "), F.lit("")))


def opening(html: Column, tag: str, css_class: str | None = None) -> Column:
    """The first opening tag of that name, and of a class if given; null if there is none."""
    attributes = rf"[^>]*\bclass=\"[^\"]*\b{css_class}\b[^\"]*\"[^>]*" if css_class else r"[^>]*"
    return F.nullif(F.regexp_extract(html, rf"(?is)(<{tag}\b{attributes}>)", 1), F.lit(""))


def film_page(html: Column, poster: Selector, release_date: Selector, meta: Selector, genres: Selector, player: Selector = ("figure", "player"), item: Selector = ("div", "item"), label: Selector = ("span", "what"), value: Selector = ("span", "that"), visa: str = "N° de Visa") -> Column:
    """struct<allocine_visa_number, poster_url, release_date, duration, genres, trailer_url>; each part null where the page lacks it.

    The visa is the value of the first item whose label names it; the trailer is the best source of the player's data model.
    """

    def found(p: Page) -> list[dict]:
        named = next((e for e in p.elements(item) if visa in (p.value(label, e) or "")), None)
        listed = [p.text(e) for e in p.elements(genres)]
        return [{"visa": p.value(value, named) if named else None, "date": p.text(p.first(release_date)), "meta": p.text(p.first(meta)), "genres": listed or None}]

    f = F.get(_each(html, found, "array<struct<visa: string, date: string, meta: string, genres: array<string>>>"), F.lit(0))
    model = F.replace(F.replace(attribute(opening(html, *player), "data-model"), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.struct(
        f["visa"].alias("allocine_visa_number"), attribute(opening(html, *poster), "src").alias("poster_url"), f["date"].alias("release_date"), duration_cell(f["meta"]).alias("duration"), f["genres"].alias("genres"), trailer_url(model).alias("trailer_url"),
    )


def people(html: Column, section: Selector, name: Selector) -> Column:
    """The names in the first section of a kind, such as directors or actors, in order; none without such a section."""

    def found(p: Page) -> list[str]:
        within = p.first(section)
        return [p.text(e) for e in p.elements(name, within)] if within else []

    return F.coalesce(_each(html, found, "array<string>"), F.array().cast("array<string>"))


def cast_sections(html: Column, section: str, heading: Selector, credit: Selector, role: list[Selector], name: list[Selector]) -> Column:
    """map<section, array<struct<role, name>>>; of the selectors for role and name the first pair that finds both counts, and of sections of one heading the last."""
    pairs = list(zip(role, name, strict=True))

    def found(p: Page) -> list[dict]:
        out: dict[str, list[dict]] = {}
        for s in p.elements(("section", section)):
            key = p.value(heading, s)
            if key is None:
                continue
            credits = []
            for c in p.elements(credit, s):
                both = next(((r, n) for r, n in ((p.value(a, c), p.value(b, c)) for a, b in pairs) if r is not None and n is not None), None)
                if both:
                    credits.append({"role": both[0], "name": both[1]})
            out.pop(key, None)
            out[key] = credits
        return [{"key": k, "value": v} for k, v in out.items()]

    return F.map_from_entries(_each(html, found, "array<struct<key: string, value: array<struct<role: string, name: string>>>>"))
