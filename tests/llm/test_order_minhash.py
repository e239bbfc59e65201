import hashlib
import random
import re

from pyspark.sql import functions as F

from lumenframe.llm import order_minhash as O


def brute_edited(rows):
    """(doc_id, edited text) by ascending id, ties by text, the last followed by the first."""
    order = sorted(((i if i is not None else -(2**63), t or "") for i, t, _ in rows))
    out = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        out.append((None if i == -(2**63) else i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_against_brute_force(docs, rows):
    got = O.compare_with_edited(docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == brute_edited(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (6, 8)}) == 1
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {""}
    same = [r for r in got if r["doc_id"] == 6]
    assert sorted(r["near_next"] for r in same)[-2:] == [1.0, 1.0]


def test_one_row_is_its_own_next(spark, empty):
    r = O.compare_with_edited(spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert O.compare_with_edited(empty).count() == 0


def signature_parts(words, k):
    grams = [tuple(words[max(0, i - k + 1) : i + 1]) for i in range(len(words))]
    seen, out = {}, []
    for g in grams:
        seen[g] = seen.get(g, -1) + 1
        out.append((g, seen[g]))
    return out


def test_numbered_kmers_decide_the_signature(spark):
    """With one bucket and a length above all k-mers, signatures are equal exactly where the numbered k-mer sequences are."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("sig", O.signatures(F.col("text"), k=2, buckets=2, length=50))
    by_sig, by_parts = {}, {}
    for r in df.collect():
        parts = tuple(signature_parts(re.findall(r"\S+", r["text"]), 2))
        by_sig.setdefault(tuple(r["sig"]), set()).add(parts)
        by_parts.setdefault(parts, set()).add(tuple(r["sig"]))
    assert all(len(v) == 1 for v in by_parts.values())
    # the two buckets split a sequence, which may join a few; nearly all stay apart
    assert len(by_sig) >= 0.7 * len(by_parts)


def test_short_texts_keep_what_they_share(spark):
    """A text of any length has a k-mer at each word, so one word more or less changes few of them."""
    df = spark.createDataFrame([("a b c d", "a b c x", "p q r s", "a b c d")], "a string, near string, other string, same string")
    s = lambda c: O.signatures(F.col(c))
    r = df.select(*[O.likeness(s("a"), s(c)).alias(c) for c in ("near", "other", "same")]).first()
    assert r["same"] == 1.0 > r["near"] >= 0.5 and r["other"] == 0.0
    five = spark.createDataFrame([("a b c d e", "a b c d")], "a string, b string").select(O.likeness(s("a"), s("b")).alias("l")).first()["l"]
    assert five >= 0.6


def brute_signature(words, k, buckets, length, hash_of):
    """The method by the book: numbered k-mers, the smallest of each bucket, in text order, as tuples."""
    entries = sorted((hash_of[g, n], i) for i, (g, n) in enumerate(signature_parts(words, k)))
    out = {}
    for h, i in entries:
        out.setdefault(h * buckets >> 33, []).append((i, h))
    return {b: tuple(h for _, h in sorted(x[:length])) for b, x in out.items()}


def test_signatures_against_the_method_by_the_book(spark):
    """Two texts agree in a bucket exactly where the book's tuples do; the hashes are read from texts of a single k-mer."""
    rng = random.Random(12)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(2, 60))] for _ in range(40)]
    parts = sorted({p for t in texts for p in signature_parts(t, 2)})
    grams = spark.createDataFrame([(list(g), n) for g, n in parts], "g array<string>, n int")
    word = F.transform("g", lambda w: F.xxhash64(w))
    inner = F.xxhash64(F.get(word, 0), F.get(word, 1)).bitwiseAND(F.lit((1 << 33) - 1))
    hashes = grams.select("g", "n", F.xxhash64(inner, F.col("n")).bitwiseAND(F.lit((1 << 33) - 1)).alias("h")).collect()
    hash_of = {(tuple(r["g"]), r["n"]): r["h"] for r in hashes}
    got = [dict((x >> 32, x & 0xFFFFFFFF) for x in r["s"]) for r in spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(O.signatures(F.col("t"), k=2, buckets=8, length=2).alias("s")).collect()]
    want = [brute_signature(t, 2, 8, 2, hash_of) for t in texts]
    for g, w in zip(got, want, strict=True):
        assert g.keys() == w.keys()
    for i in range(40):
        for j in range(i):
            assert all((got[i][b] == got[j][b]) == (want[i][b] == want[j][b]) for b in got[i].keys() & got[j].keys())


def test_order_matters(spark):
    rng = random.Random(5)
    a = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    moved = a[200:] + a[:200]
    cut = a[:200] + [f"z{i}" for i in range(200)]
    df = spark.createDataFrame([(" ".join(a), " ".join(moved), " ".join(cut), " ".join(a[:-4]))], "a string, moved string, cut string, near string")
    s = lambda c: O.signatures(F.col(c))
    r = df.select(*[O.likeness(s("a"), s(c)).alias(c) for c in ("moved", "cut", "near")]).first()
    assert r["near"] > 0.85 and 0.3 < r["moved"] < 0.9 and r["cut"] < r["moved"] < r["near"]
