import random

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, key string, block string, size string, added string, media string, sketch string, taken string, `group` string, copy string, draw string, __id string, __draw string, __draws string, __pass string, bands string"


def documents(rows):
    """Rows (doc_id, text, source) with extra columns whose names operators use inside."""
    return [(i, t, None if k % 3 else "en", s, None if t is None else len(t), *["x"] * 17) for k, (i, t, s) in enumerate(rows)]


def texts():
    rng = random.Random(4)
    words = [a + b for a in ("lo", "ré", "x", "Th", "on", "ß") for b in ("a", "ne", "t.", "ly,", "'s", "9")]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = body(300)
    near = base.split()
    near[17], near[200] = "changed", "words"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "two words", "b"), (6, base, "a"), (7, " ".join(near), "c"), (8, base, "c"), (9, "".join(c.upper() if c.isascii() else c for c in base), "a"), (10, "a  b\n\nc  d\r\n", "a"), (11, "漢字🙂 <|endoftext|> \x00", None)]
    rows += [(12, "same line\n" * 400, "a"), (13, body(30_000), "b"), (14, "y" * 70_000, "b"), (6, base, "a"), (6, base, "a"), (None, "no id", "c"), (None, None, None)]
    return rows + [(100 + i, body(rng.randint(1, 120)), rng.choice("abc")) for i in range(60)]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(documents(rows), DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
