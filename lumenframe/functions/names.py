"""Fuzzy comparison of names. Jaro needs a scan with state, so it is an Arrow-batched function; everything else is native."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.text import normalized_tokens


def jaro(a: str, b: str) -> float:
    """Jaro similarity; 1 for two empty strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(range(len(b)))  # places of b not matched yet, ascending
    left, right = [], []
    for i, c in enumerate(a):
        j = next((j for j in free if i - reach <= j <= i + reach and b[j] == c), None)
        if j is not None:
            free.remove(j)
            left.append(c)
            right.append(j)
    if not left:
        return 0.0
    m = len(left)
    swaps = sum(x != b[j] for x, j in zip(left, sorted(right), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro raised by a tenth of what is missing for each of up to four equal leading characters, at any value."""
    base, prefix = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + 0.1 * prefix * (1 - base)


def jaro_winkler(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else jaro_winkler_of(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def levenshtein_share(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; null for two empty strings."""
    return F.lit(1.0) - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def sorted_name(s: Column) -> Column:
    return F.array_join(normalized_tokens(s), " ")


def compare(a: Column, b: Column) -> Column:
    """Mean of edit-distance and Jaro-Winkler similarity of sorted names; null if both are empty."""
    return (levenshtein_share(a, b) + jaro_winkler(a, b)) / 2
