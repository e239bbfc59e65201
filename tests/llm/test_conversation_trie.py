import hashlib
import random
import re
import zlib

import pytest

from lumenframe.llm import conversation_trie as T

DDL = "conv_id long, turn long, role string, text string, depth string, k1 string, part string, id string"


def brute(rows):
    """The trie of the rebuilt conversations, held whole."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [v[1:] for v in sorted(rs)] for c, rs in convs.items()}
    rebuilt, nodes = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
        for d in range(len(rebuilt[c]) + 1):
            nodes.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums, out = {}, []
    for p in sorted(nodes, key=len, reverse=True):
        mine = children.get(p, [])
        saved = (len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in mine) or 1, saved + sum(sums[k][1] for k in mine))
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(rebuilt[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(mine), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, *"xxxx") for r in rows], DDL).repartition(parts)
    return sorted((tuple(r) for r in T.trie(df).collect()), key=lambda r: r[:2])


def hard_rows():
    rng = random.Random(3)
    turns = [(None, "user", "hi there"), (1, None, None), (2, "assistant", "ok"), (2, "assistant", "ok"), (3, "user", "")]
    rows = [(None, 1, "user", "lost")] + [(c, *t) for c in (20, 21, 22, 40, 45, -3, -20, 7) for t in turns[: rng.randint(1, 5)]]
    rows += [(60 + i, 0, "user", "same first") for i in range(300)] + [(60 + i, 1, "assistant", str(i % 3)) for i in range(0, 300, 2)]
    return rows + [(900, i, "user", f"turn {i % 7}") for i in range(250)] + [(901, i, "user", "x") for i in range(10)]


def test_trie_equals_brute_force(spark, monkeypatch):
    """Null and tied turns, null texts, ids below 0, a long conversation over several ranges, a common first turn, conversations that end alike."""
    monkeypatch.setattr(T, "PIECE", 50)
    rows = hard_rows()
    assert found(spark, rows) == brute(rows)


def test_trie_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_trie_of_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize(("n", "width", "order"), [(1, 4, "shuffled"), (2000, 64, "even first"), (1500, 16, "shuffled")])
def test_list_ranks(spark, n, width, order):
    """Lists that stay within ranges and lists that jump at random, which go by coins."""
    ids = list(range(n))
    if order == "shuffled":
        random.Random(n).shuffle(ids)
    else:
        ids = ids[::2] + ids[1::2]
    elements = [(x, 1 + x % 3, ids[k + 1] if k + 1 < n else -1) for k, x in enumerate(ids)]
    want, total = {}, 0
    for x, size, _ in elements:
        want[x] = total
        total += size
    got = T.list_ranks(spark.createDataFrame(elements, "id long, size long, next long").repartition(3), n, at_once=300, range_=width)
    assert {r["id"]: r["rank"] for r in got.collect()} == want
