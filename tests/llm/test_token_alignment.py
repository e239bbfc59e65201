import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumenframe.llm import token_alignment as A
from lumenframe.llm.wordpiece import byte_of_symbol

LIB_A = Tokenizer.from_file(A.default_path())
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=A.piece_path())
OF = byte_of_symbol()


def tokens(text):
    """(ids and bytes of A, of B), or nothing if either doesn't give the text back."""
    whole = (" " + text).encode()
    ids = LIB_A.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(OF[c] for c in LIB_A.id_to_token(i)) if i < 50256 else LIB_A.id_to_token(i).encode()) for i in ids]
    b = [(i, bytes([int(LIB_B.id_to_piece(i)[3:5], 16)]) if LIB_B.is_byte(i) else LIB_B.id_to_piece(i).replace("▁", " ").encode()) for i in LIB_B.encode(text)]
    return (a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    docs, counts = [], Counter()
    for t in texts:
        a, b = map(spans, tokens(t or ""))
        links = Counter()
        j = 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links[i, b[k][0]] += 1
                k += 1
        counts.update(set(links))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, x, y = [], 0, 0
        for end in ends:
            ga, gb = [], []
            while x < len(a) and a[x][2] <= end:
                ga.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= end:
                gb.append(str(b[y][0]))
                y += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        docs.append((len(a), len(b), groups, links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [
        (na, nb, len(g), sum(ls.values()), sum(k for p, k in ls.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in ls.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, ls in docs
    ]


@pytest.mark.parametrize("work", [1, 2, 7, 64, None])
def test_merge_path(work):
    rng = np.random.default_rng(work or 0)
    for n, m in ((1, 1), (1, 9), (30, 5), (400, 700)):
        a, b = (np.unique(np.append(rng.integers(1, 1000, k - 1), 1000)) for k in (n, m))
        li, lj, ga, gb = A.merge_path(a, b, work)
        start = lambda x, i: x[i - 1] if i else 0
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if start(a, i) < b[j] and start(b, j) < a[i]]
        assert list(zip(li.tolist(), lj.tolist(), strict=True)) == want
        both = np.intersect1d(a, b)
        assert (ga == np.searchsorted(both, a)).all() and (gb == np.searchsorted(both, b)).all()


def odd_texts():
    rng = random.Random(7)
    parts = [*"ab'sdt.., \n\n  \t\r09éß漢🙂_-<|>!?x½²Ⅷ \x1c\x85\xa0​　", "'ll", " 're", "<|endoftext|>", "\n \n", "a.", "b,", "</s>", "<unk>", "<0x41>", "▁", "word", " the"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "\n", "\nx", "x\n", "a <|endoftext|> b", "▁", "a▁b", "x" * 5000, "\x00"]


def test_pieces_align_as_whole_texts():
    known, texts = A.aligner(A.default_path(), A.piece_path()), odd_texts()
    rows = []
    for sums, groups, pairs, times in known.batch(pa.array(texts, pa.string())):
        rows += [(*map(int, s), g, dict(zip(p.tolist(), t.tolist(), strict=True))) for s, g, p, t in zip(sums, groups, pairs, times, strict=True)]
    for t, row in zip(texts, rows, strict=True):
        (na, nb, ng, nl, _, _, sha), = brute([t])
        assert row[:4] == (na, nb, ng, nl), t
        assert (hashlib.sha256(row[4].encode()).hexdigest() if row[4] else "") == sha
        assert sum(row[5].values()) == nl


def test_alignment_equals_brute_force(spark, docs, rows, empty):
    got = sorted(map(tuple, A.alignment_digests(docs).collect()), key=repr)
    names = A.alignment_digests(empty).columns
    want = [dict(zip(["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"], r, strict=True)) | {"doc_id": i} for (i, _, _), r in zip(rows, brute([t for _, t, _ in rows]), strict=True)]
    assert got == sorted((tuple(w[c] for c in names) for w in want), key=repr)
    assert A.alignment_digests(empty).count() == 0


def test_links_join_the_counts_where_they_are_too_many_to_broadcast(docs):
    documents = A.written(A.aligned(docs), "t")
    counts = A.written(A.pair_counts(documents, A.id_bits()), "c")
    by = lambda df: sorted(map(tuple, df.select("doc_id", "groups", "n_best", "count_sum").collect()), key=repr)
    assert by(A.scored(documents, counts)) == by(A.scored(documents, counts, most=10))
