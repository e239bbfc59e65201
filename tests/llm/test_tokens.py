import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import packing as P
from lumenframe.llm import repair as R
from lumenframe.llm import tokens as K
from lumenframe.llm import wordpiece as W


@pytest.fixture(scope="module")
def encoder():
    return K.encoder(K.default_path())


LIBRARY = Tokenizer.from_file(K.default_path())  # as it is read, nothing set


def whole(encoder, text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(7)
    parts = [*"ab'sdt.., \n\n  \t\r09éß漢🙂_-<|>!?x½²Ⅷ \x1c \x85\xa0​　", "'ll", " 're", "<|endoftext|>", "\n \n", "a.", "b,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + [None, "", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\ny", "<|endoftext"]
    assert whole(encoder, "a <|endoftext|> b") == [64, 220, 50256, 275]
    for at in range(0, len(texts), 3000):
        some = texts[at : at + 3000]
        assert [x.tolist() for x in encoder.batch(pa.array(some, pa.string()))] == [whole(encoder, t) for t in some]


def test_packing(docs, rows, empty, encoder):
    got = P.pack(docs, windows=8).collect()
    want = Counter()
    for i, t, _ in rows:
        want[i, tuple([*whole(encoder, t), 1])] += 1
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    for i in {i for i, _ in want}:
        lists = [ids for (j, ids), n in want.items() if j == i for _ in range(n)]
        cover = Counter(p for s, n, _, _ in pieces[i] for p in range(s, s + n))
        assert cover == Counter(p for ids in lists for p in range(len(ids)))
        for s, n, crc, total in pieces[i]:
            assert any(total == len(ids) and crc == P.crc(np.array(ids[s : s + n])) for ids in lists)
    used = sum(n for s in seqs.values() for _, n in s)
    assert used / (2048 * len(seqs)) > 0.97
    assert P.pack(empty).count() == 0


def test_leftovers_of_many_partitions_share_windows(spark):
    """40 partitions of a few short texts: they end in as few windows as their ids can, not in one more a group."""
    texts = [(i, f"some words of a short text, {i}") for i in range(2000)]
    got = P.pack(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(40), windows=4).groupBy("sequence_id").agg({"length": "sum"}).collect()
    sizes = sorted(r[1] for r in got)
    total = sum(len(whole(None, t)) + 1 for _, t in texts)
    assert sum(sizes) == total and max(sizes) <= P.LENGTH and len(sizes) == -(-total // P.LENGTH)


def test_merging_keeps_every_id():
    rng = np.random.default_rng(1)
    held = [(i, 3, np.arange(n, dtype="<u2"), n + 3) for i, n in enumerate(rng.integers(1, 2048, 300))]
    out = P.merged(held, 2048)
    assert all(sum(len(p[2]) for p in w) <= 2048 for w in out) and len(out) <= -(-sum(len(h[2]) for h in held) // 2048) + 1
    assert Counter((p[0], p[1] + k) for w in out for p in w for k in range(len(p[2]))) == Counter((h[0], h[1] + k) for h in held for k in range(len(h[2])))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 60_000])
def test_repair_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.integers(0, 12, n), np.zeros(n, int)):
        ids = ids.astype("<u2")
        s = R.Shard(R.shard_file([4], [n], ids, 50_257))
        assert (s.ids() == ids).all() and s.n_ids == n
        for start in {0, n // 3, max(0, n - 5)}:
            for size in (1, 7, n // 2):
                if size and start + size <= n:
                    assert (s.range(start, size) == ids[start : start + size]).all()
    with pytest.raises(ValueError):
        R.Shard(b"\0" * 64)


def apart(seq):
    """How often each pair of neighbours is met without overlapping itself."""
    last, n = {}, Counter()
    for i, p in enumerate(zip(seq, seq[1:], strict=False)):
        if last.get(p) != i - 1:
            n[p] += 1
            last[p] = i
    return n


@pytest.mark.parametrize("kind", ["two", "zipf", "copies", "runs"])
def test_repair_goes_on_until_no_pair_repeats(kind):
    rng = np.random.default_rng(5)
    ids = {"two": rng.integers(0, 2, 3000), "zipf": rng.zipf(1.4, 20_000) % 400, "copies": np.tile(rng.integers(0, 900, 500), 60), "runs": np.repeat(rng.integers(0, 5, 200), rng.integers(1, 90, 200))}[kind].astype("<u2")
    seq, rules, ends = R.compress(ids, 1000)
    assert max(Counter(zip(seq.tolist(), seq[1:].tolist(), strict=False)).values(), default=0) < R.LEAST and len(rules) == ends[-1]
    assert (R.Shard(R.shard_file([1], [len(ids)], ids, 1000)).ids() == ids).all()
    if kind == "copies":
        assert len(seq) < 600  # of 30,000: a pair met seven times stays


def test_repair_stops_where_symbols_run_out():
    ids = np.random.default_rng(6).integers(0, 40, 30_000).astype("<u2")
    seq, rules, _ = R.compress(ids, (1 << 16) - 25)
    assert len(rules) == 25 and seq.max() == (1 << 16) - 1
    pairs = apart(ids.tolist())
    assert pairs[tuple(rules[0].tolist())] >= 4
    assert (R.Shard(R.shard_file([1], [len(ids)], ids, (1 << 16) - 25)).ids() == ids).all()


def test_shards_in_order(docs, rows, empty, encoder):
    shards = R.write_shards(docs, shard_ids=5000)
    got = R.read_shards(shards).orderBy("start").collect()
    order = sorted((i if i is not None else -(2**63), t or "") for i, t, _ in rows)
    start, want = 0, []
    for i, t in order:
        ids = np.array([*whole(encoder, t), 0], dtype="<u4")
        want.append((None if i == -(2**63) else i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want and shards.count() > 3
    assert R.read_shards(R.write_shards(empty)).count() == 0


def greedy(word, opening, continuing):
    n, known = 0, opening
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in known), 0)
        if not k:
            return -1
        word, n, known = word[k:], n + 1, continuing
    return n


def test_automaton_is_greedy():
    rng = random.Random(3)
    for _ in range(300):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4)))
        opening, continuing = {piece() for _ in range(rng.randint(1, 9))}, {piece() for _ in range(rng.randint(0, 9))}
        a = W.Automaton(sorted(opening), sorted(continuing))
        for _ in range(60):
            w = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 10)))
            assert a.count(w) == a[w] == greedy(w, opening, continuing), (w, opening, continuing)


def test_token_counts(docs, rows, empty):
    opening, continuing = map(set, W.pieces_of(K.default_path()))
    want = Counter()
    for i, t, _ in rows:
        ws = (t or "").encode().split()
        want[i, len(ws), sum(greedy(w, opening, continuing) for w in ws) if len(ws) < 1000 and len(t or '') < 10_000 else None] += 1
    got = Counter()
    for r in W.token_counts(docs).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        got[r["doc_id"], r["n_words"], r["n_tokens"] if not (text and (len(text) >= 10_000 or len(text.split()) >= 1000)) else None] += 1
    assert sum(want.values()) == sum(got.values()) and {k[:2] for k in want} == {k[:2] for k in got}
    assert {k for k in want if k[2] is not None and k[0] is not None} <= set(got)
    assert W.token_counts(empty).count() == 0


def test_packing_encodes_few_documents_at_once(spark, tmp_path, monkeypatch):
    """A batch of many documents gives its windows slice by slice, with the pieces of one that is taken whole."""
    texts = [(i, " ".join(f"w{i * j % 97}" for j in range(i % 50))) for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(P, "AT_ONCE", 7)
    few = sorted(tuple(r) for r in P.pack(df, windows=16).collect())
    monkeypatch.setattr(P, "AT_ONCE", 10_000)
    assert few == sorted(tuple(r) for r in P.pack(df, windows=16).collect())
