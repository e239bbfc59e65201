import hashlib
import math
from collections import Counter, defaultdict

from test_sharding_and_mixing import brute_targets
from test_simhash import brute_alike
from test_tokens import whole

import corpus_pipeline as C
from lumenframe.llm import simhash, toxicity
from lumenframe.llm.packing import crc


def test_stages(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(6, 1, 0), (100, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs
    for name, stage in C.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    kept = Counter(r["doc_id"] for r in d.collect())
    assert not {7, 8, 9} & set(kept) and max(n for i, n in kept.items() if i is not None) <= 2
    packed = C.run(spark, str(tmp_path)).collect()
    assert Counter({i: n for i, n in Counter(r["doc_id"] for r in packed if r["start"] == 0).items()}) == kept


def words(text):
    return (text or "").encode().translate(simhash._LOWER).decode().split()


def brute_mix(rows, share=1.5, cap=2.0, seed=7):
    """How often each (doc_id, text) is drawn: whole passes, and a partial one that ends at the document nearest to the quota."""
    own = defaultdict(list)
    for i, t, s in rows:
        own[s].append((hashlib.md5("|".join([*([] if i is None else [str(i)]), str(seed)]).encode()).hexdigest(), -(2**63) if i is None else i, len(words(t)), hashlib.md5((t or "").encode()).hexdigest(), (i, t)))
    sizes = {s: sum(r[2] for r in x) for s, x in own.items()}
    out = Counter()
    for s, target in brute_targets(sizes, share, cap).items():
        quota, before = math.floor(target + 0.5), 0
        full = quota // sizes[s] if sizes[s] else 0
        for _, _, n, _, key in sorted(own[s]):
            left = quota - full * sizes[s] - before
            out[key] += (full if n else 0) + int(n > 0 and 2 * left >= n)
            before += n
    return +out


def test_stages_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clean = C.drop_toxic(spark, docs, str(tmp_path))
    bad = {r["doc_id"] for r in toxicity.classify(docs, labels).collect() if r["predicted"]}
    three = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert Counter(three(clean)) == Counter(r for r in three(docs) if r[0] not in bad)

    rows = sorted(set(three(clean)), key=lambda r: (-(2**63) if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).digest()))
    rows = [r for k, r in enumerate(rows) if not any((r[0], r[1] or "") == (q[0], q[1] or "") for q in rows[:k])]
    root, first = brute_alike([words(t) for _, t, _ in rows], 0.8), {}
    for k, (_, t, _) in enumerate(rows):
        root[k] = root[first.setdefault(t or "", k)]
    kept = {(r[0], r[1] or "") for k, r in enumerate(rows) if root[k] == k}
    single = C.drop_near_duplicates(spark, clean, str(tmp_path))
    assert sorted(((i, t or "") for i, t, _ in three(single)), key=repr) == sorted(kept, key=repr)

    mixed = C.mix_sources(spark, single, str(tmp_path))
    assert Counter((i, t) for i, t, _ in three(mixed)) == brute_mix(three(single))

    pieces = C.pack_windows(spark, mixed, str(tmp_path)).collect()
    want = Counter((i, len(whole(None, t)) + 1) for i, t, _ in three(mixed))
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == want
    import numpy as np

    ids = defaultdict(list)
    for i, t, _ in three(mixed):
        ids[i].append(np.array([*whole(None, t), 1]))
    assert all(any(len(x) == r["doc_tokens"] and crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in ids[r["doc_id"]]) for r in pieces)


def test_entries_are_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)
