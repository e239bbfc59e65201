import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import xxhash

from lumenframe.llm import simhash as S


def brute_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, limit):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_against_brute_force(docs, rows, empty):
    got = S.near_duplicates(docs).collect()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    root = brute_components(prints, 4)
    least = {}
    for r, (i, _, _) in zip(root, rows, strict=True):
        key = -(2**63) if i is None else i
        least[r] = min(least.get(r, key), key)
    want = Counter((i, f"{p:016x}", None if least[r] == -(2**63) else least[r]) for (i, _, _), p, r in zip(rows, prints, root, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert S.near_duplicates(empty).count() == 0


def test_plans_cover_every_close_pair():
    rng = random.Random(1)
    sample = np.array([rng.getrandbits(64) for _ in range(3000)], dtype=np.uint64)
    seen = set()
    for n in (10, 10**5, 10**7, 10**9):
        for limit in (4, 7):
            chosen = S.plan(sample, n, limit)
            assert sum(t + 1 for _, t in chosen) == limit + 1
            seen.add(tuple(t for _, t in chosen))
            masks = [m for m, _ in chosen]
            assert sum(m.bit_count() for m in masks) <= 64 and sum(masks) <= (1 << 64) - 1
            for _ in range(300):
                flips = sum(1 << b for b in rng.sample(range(64), limit))
                assert any((flips & m).bit_count() <= t for m, t in chosen)
    assert any(len(set(t)) > 1 for t in seen)  # thresholds are unequal where that costs least


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    sample = np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    masks = S.group_bits(sample, 4)
    assert any(m >> (63 - 3) & 1 and m >> (63 - 40) & 1 for m in masks) and sum(masks) == (1 << 64) - 1


def test_large_buckets_are_split_without_loss(monkeypatch):
    monkeypatch.setattr(S, "HOT", 50)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fp = np.array([b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(40)], dtype=np.uint64)
    a, b = S.linked(fp, 4)
    assert all((int(fp[i]) ^ int(fp[j])).bit_count() <= 64 for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert S._forest(len(fp), a, b).tolist() == brute_components([int(x) for x in fp], 4)


def test_a_dense_bucket_takes_little_memory():
    rng = np.random.default_rng(8)
    flips = np.zeros(20_000, dtype=np.uint64)
    for _ in range(3):
        flips ^= np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64)
    fp = np.unique(np.uint64(0x0123456789ABCDEF) ^ flips)
    tracemalloc.start()
    a, b = S.linked(fp, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) < len(fp) and peak < 200e6  # all pairs would be some 200 million
    assert (S._forest(len(fp), a, b) == 0).all()


def test_links_with_unequal_thresholds(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(6)})
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id bigint, fp bigint")
    chosen = [((1 << 22) - 1, 0), (((1 << 21) - 1) << 22, 1), (((1 << 21) - 1) << 43, 1)]
    got = {r["id"]: r["component"] for r in S.components(S.links(df, chosen, 4)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(fps, 4)


def test_hot_buckets_are_dealt_out_without_loss(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 20)
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 9))) for _ in range(300)})
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id bigint, fp bigint")
    chosen = S.plan(np.array(fps, dtype=np.uint64), len(fps), 4)
    got = {r["id"]: r["component"] for r in S.components(S.links(df, chosen, 4)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(fps, 4)


def test_components_of_a_long_chain(spark):
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)] + star, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500} | {i: 1000 for i in range(1001, 1300)}


def test_deduplicate_keeps_one_of_each_group(docs, rows, empty):
    got = S.deduplicate(docs)
    assert got.columns == docs.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    want = {}
    texts = [((t or "").encode().translate(S._LOWER).decode().split(), t or "", i) for i, t, _ in rows]
    root = brute_alike([w for w, _, _ in texts], 0.8)
    exact = {}
    for k, (w, t, i) in enumerate(texts):  # exact copies are one, words or not
        root[k] = root[exact.setdefault(t, k)]
    for k, (_, t, i) in enumerate(texts):
        key = -(2**63) if i is None else i
        want[root[k]] = min(want.get(root[k], key), key)
    assert ids == Counter(None if k == -(2**63) else k for k in want.values())
    assert S.deduplicate(empty).count() == 0


def test_deduplicate_links_by_fingerprints(spark, monkeypatch):
    """Near copies are met by their SimHash fingerprints, also without any band; texts without words stay apart."""
    monkeypatch.setattr(S, "band_links", lambda reps: spark.createDataFrame([], "a bigint, b bigint"))
    rng = random.Random(4)
    texts = []
    while len(texts) < 20:
        words = [f"w{rng.randrange(5000)}" for _ in range(800)]
        pair = [" ".join(words), " ".join([*words[:-1], "end"])]
        if bin(S.fingerprint_of(pair[0]) ^ S.fingerprint_of(pair[1])).count("1") <= 4:
            texts += pair
    rows = list(enumerate([*texts, "", " ", "  "]))
    stay = {r["doc_id"] for r in S.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert stay == {*range(0, 20, 2), 20, 21, 22}


def test_deduplicate_against_exact_jaccard(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(200)]
        texts.append(base)
        for edits in (1, 2, 12, 60):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(200)] = rng.choice(vocabulary)
            texts.append(copy)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    stay = {r["doc_id"] for r in S.deduplicate(df).collect()}
    missed = 0
    grams = [{tuple(t[i : i + 5]) for i in range(196)} for t in texts]
    for i, g in enumerate(grams):
        base = i - i % 5
        like = len(g & grams[base]) / len(g | grams[base])
        if i != base and like >= 0.85:
            missed += i in stay
        if i != base and like <= 0.6:
            assert i in stay
        if i == base:
            assert i in stay
    assert missed <= 2  # of 120: fingerprints of 64 bits stay within the limit for some 99.9 in 100


def words_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_alike_is_exact_over_large_groups(spark, monkeypatch):
    rng = random.Random(12)
    base = words_of(rng, 404)  # 400 shingles; a tail of e new words leaves 400 - e of 400 + e
    tails = [base[: 404 - e] + words_of(rng, e) for e in (44, 45, 50, 60) for _ in range(12)]
    monkeypatch.setattr(S, "HALF", 5)
    df = spark.createDataFrame([(0, " ".join(base))] + [(1 + i, " ".join(t)) for i, t in enumerate(tails)], "key bigint, text string")
    loose = spark.createDataFrame([(i, 0) for i in range(49)], "key bigint, component bigint")
    got = {r["id"]: r["component"] for r in S.components(S.settled(df, loose, 0.8)).collect()}
    assert got == {i: 0 for i in range(1, 13)}  # 44 new words: 356 / 444 = 0.802; 45: 355 / 445 = 0.798


def brute_alike(texts, least):
    grams = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if grams[i] and grams[j] and len(grams[i] & grams[j]) >= least * len(grams[i] | grams[j]) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_groups_of_many_parts_against_brute_force(spark, monkeypatch):
    """Chains from the centre outwards, texts at the bound, and some alike to no other: those past the centre's reach are decided too."""
    monkeypatch.setattr(S, "HALF", 7)
    rng = random.Random(21)
    texts = [words_of(rng, 120)]
    for _ in range(90):
        base = list(texts[rng.randrange(len(texts))] if rng.random() < 0.8 else texts[0])
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            base[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
        texts.append(base)
    texts += [words_of(rng, 3), []]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "key bigint, text string")
    loose = spark.createDataFrame([(i, 0) for i in range(len(texts))], "key bigint, component bigint")
    got = {r["id"]: r["component"] for r in S.components(S.settled(df, loose, 0.8)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == brute_alike(texts, 0.8)
    assert len(set(got.values())) > 1 or len(got) < len(texts) - 3


def test_a_tight_group_of_many_parts_is_settled_by_its_centre(spark, monkeypatch):
    monkeypatch.setattr(S, "HALF", 5)
    rng, sent = random.Random(22), []
    base = words_of(rng, 300)
    df = spark.createDataFrame([(i, " ".join([*base[: 300 - i % 5], *words_of(rng, i % 5)])) for i in range(60)], "key bigint, text string")
    loose = spark.createDataFrame([(i, 0) for i in range(60)], "key bigint, component bigint")
    tiles = S._tiles
    monkeypatch.setattr(S, "_tiles", lambda rows, similarity: sent.append(rows.count()) or tiles(rows, similarity))
    got = {r["id"]: r["component"] for r in S.components(S.settled(df, loose, 0.8)).collect()}
    assert got == {i: 0 for i in range(1, 60)} and sent == [60 + 11]  # the centre meets each of the 12 parts; nothing goes on


def test_rows_that_share_an_id_are_treated_apart(spark):
    rng = random.Random(23)
    a, b = words_of(rng, 200), words_of(rng, 200)
    near = [*a[:199], "x"]
    rows = [(1, " ".join(a), "p"), (5, " ".join(near), "q"), (5, " ".join(b), "r"), (5, " ".join(b), "s"), (None, " ".join(words_of(rng, 50)), "t"), (None, " ".join(words_of(rng, 50)), "u")]
    got = S.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string, key string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((i or 0, t) for i, t, _ in [rows[0], rows[2], rows[4], rows[5]])


def test_the_bound_is_decided_without_error(spark):
    rng = random.Random(13)
    rows, want = [], set()
    for i in range(150):
        base, e = words_of(rng, 404), (44, 46)[i % 2]
        copy = base[: 404 - e] + words_of(rng, e)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        want |= {2 * i} | ({2 * i + 1} if e == 46 else set())
    stay = {r["doc_id"] for r in S.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert want <= stay  # pairs below 0.8 are never merged


def test_cut_and_appended_copies_are_found(spark):
    rng = random.Random(14)
    rows, gone, n = [], set(), 0
    for share in (0.81, 0.83, 0.86, 0.9):
        for i in range(60):
            base = words_of(rng, rng.choice((30, 80, 400)))
            grams = len(base) - 4
            if i % 2:
                copy = base[: 4 + -(-grams * int(100 * share) // 100)]
            else:
                copy = base + words_of(rng, int(grams / share) - grams)
            rows += [(n, " ".join(base)), (n + 1, " ".join(copy))]
            gone |= {n + 1}
            n += 2
    stay = {r["doc_id"] for r in S.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(stay & gone) <= 1 and stay >= set(range(0, n, 2))  # of 240
