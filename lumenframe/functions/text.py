"""Text functions as Columns: names, titles, accents, trigrams. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(s: Column) -> Column:
    """The runs of a text that hold no white space."""
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def remove_extra_spaces(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def first_name(s: Column) -> Column:
    """First token of a full name; empty if there is none."""
    return F.coalesce(F.get(tokens(s), F.lit(0)), F.when(s.isNotNull(), F.lit("")))


def last_name(s: Column) -> Column:
    """Last token of a full name; empty if it has fewer than two. Middle names are dropped."""
    return let(tokens(s), lambda t: F.when(F.size(t) > 1, F.element_at(t, -1)).when(s.isNotNull(), F.lit("")))


def capitalize(s: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))


def title_case(s: Column) -> Column:
    """Every run of letters capitalized, whatever stands before it: also after a hyphen, an apostrophe or a digit."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


def upper_first_letters(s: Column) -> Column:
    """First letter of each space-separated token in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(s, " "), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))), " ")


def full_name(kind: Column, first: Column, last: Column, legal: Column) -> Column:
    """A company's legal name, or a person's first and last names that are not empty, in title case; null if there is none."""
    person = F.trim(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))
    return title_case(F.nullif(F.when(kind == "Company", legal).otherwise(person), F.lit("")))


def unaccent(s: Column) -> Column:
    """Letters without accents; ligatures become two letters."""
    plain = F.translate(s, _ACCENTS, _PLAIN)
    for one, two in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(one), F.lit(two))
    return plain


def same_name(a: Column, b: Column) -> Column:
    """Equality that neither case nor accents disturb."""
    return unaccent(F.lower(a)) == unaccent(F.lower(b))


def trigrams(s: Column) -> Column:
    """The set of three-character runs of each word, in lower case, with two blanks before it and one after.

    All words are padded in one text and its overlapping runs of three are taken by one pattern, but for those that end in two blanks, which lie between
    words. Texts with characters beyond U+FFFF, which the pattern would cut in two, go word by word.
    """
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    runs = F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=(.[^ ].|..[^ ]))"), F.lit(1)))
    return F.when(s.rlike(r"[\x{10000}-\x{10FFFF}]"), _trigrams_by_word(s)).otherwise(runs)


def words_only(s: Column) -> Column:
    """The runs of letters and digits, in lower case, with one blank between: texts that differ in nothing else have the same trigrams."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def _trigrams_by_word(s: Column) -> Column:
    ws = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: let(F.concat(F.lit("  "), w, F.lit(" ")), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(F.transform(ws, of)))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams; 0 if there are none."""
    return let(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), lambda t: F.coalesce(F.try_divide(F.size(F.array_intersect(t["a"], t["b"])), F.size(F.array_union(t["a"], t["b"]))), F.lit(0.0)))


def clean_title(s: Column) -> Column:
    """A title set in capitals is lowered; an article in parentheses goes to the front, and the letter after it is lowered; a lowered title without one is capitalized."""

    def of(x: Column) -> Column:
        text, was_upper = x["t"], x["u"]
        article = F.regexp_extract(text, r"(?i)\((L'|Le|La|Les)\)", 1)

        def moved(a: Column) -> Column:
            rest = F.trim(F.regexp_replace(F.replace(text, F.concat(F.lit("("), a, F.lit(")")), F.lit("\u0001")), r"\s*\u0001", ""))
            tail = F.concat(F.lower(F.substring(rest, 1, 1)), rest.substr(F.lit(2), F.length(rest)))
            gap = F.when((F.lower(a) == "l'") | (rest == ""), F.lit("")).otherwise(F.lit(" "))
            return F.concat(capitalize(a), gap, tail)

        return F.trim(F.when(article != "", let(article, moved)).when(was_upper, capitalize(text)).otherwise(text))

    upper = (s == F.upper(s)) & (s != F.lower(s))
    return let(F.struct(F.when(upper, F.lower(s)).otherwise(s).alias("t"), upper.alias("u")), of)


def normalized_tokens(s: Column) -> Column:
    """Letters, digits and white space only, lower case, as sorted tokens."""
    return F.array_sort(tokens(F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}\s]", ""))))


def url_text(s: Column) -> Column:
    return F.replace(F.lower(F.replace(s, F.lit(" - "), F.lit("+"))), F.lit(" "), F.lit("+"))


def seo_text(*parts: Column) -> Column:
    """The parts that are not null, as sentences."""
    return F.concat_ws(". ", *parts)


def display_name(mubi_label: Column, french_label: Column) -> Column:
    """An award's label; a French label of 'Autre' gives way to the source's own."""
    return F.when(french_label == "Autre", mubi_label).otherwise(french_label)
