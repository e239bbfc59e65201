import hashlib
import random

import pytest

from lumenframe.llm import chat_log as C

DDL = "conv_id long, turn long, role string, text string, message string, seq string, piece string"


def wanted(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, v in convs.items():
        turns = [x[1:] for x in sorted(v, key=lambda x: x[0])]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def hard_rows():
    rng = random.Random(5)
    bits = ["\\", "#", "##", "###", "</turn>", "<", "/turn>", "\n", "\\n", "### assistant\n", "é", "漢🙂", " a", "(sic)", "n"]
    said = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "##\\n", None]), rng.choice([None, "", said()])) for c in range(40) for t in [None, *range(rng.randint(1, 9))]]
    rows += [(50, t, "assistant", said() * 30) for t in range(600)] + [(51, 0, "user", "x" * 30_000), (51, 1, "assistant", said() * 5_000), (None, 1, "assistant", "no id")]
    return rows


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_formatted_conversations_read_back(spark, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rows = hard_rows()
    df = spark.createDataFrame([(*r, *"xxx") for r in rows], DDL).repartition(3)
    got = {r["conv_id"]: r for r in C.formatted_digests(df).collect()}
    want = wanted([*rows, (-7, 1, "user", C.PROBE[1]), (-7, 2, "assistant", C.PROBE[1])])
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    assert got[-7]["formatted_chars"] == len("### user\n\\\\#\\## Assistant: <\\/turn> ok</turn>\n") + len("### assistant\n\\\\#\\## Assistant: <\\/turn> ok</turn>\n")


def test_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:5] for r in C.formatted_digests(df).collect()}
    assert got == wanted([*map(tuple, df.select("conv_id", "turn", "role", "text").collect()), (-7, 1, "user", C.PROBE[1]), (-7, 2, "assistant", C.PROBE[1])])


def test_folding():
    e = lambda seq, kind, text=None, at=None, size=None, role=None: (seq, kind, role, text, at, size)
    assert C.folded([e(0, "open", role="user"), e(1, "delta", "Helo"), e(2, "edit", "l", 2, 0), e(3, "delta", "!")]) == ("user", "Hello!")
    assert C.folded([e(0, "open", role="assistant"), e(1, "delta", "no"), e(2, "regenerate"), e(3, "delta", "yes"), e(3, "delta", "yes")]) == ("assistant", "yes")
    assert C.folded([e(0, "open", role="user"), e(1, "delta", "ab"), e(2, "edit", "X", 9, 3), e(3, "edit", "Y"), e(4, "edit", None, 0, 1)]) == ("user", "bXY")
    assert C.folded([e(0, "open", role="user"), e(1, "delta", "x"), e(2, "delete")]) is None
    assert C.folded([e(0, "open", role="user"), e(1, "delete"), e(2, "open", role="user"), e(3, "delta", None)]) == ("user", "")
    with pytest.raises(ValueError):
        C.folded([e(0, "shout")])


def test_a_log_out_of_order_delivered_twice(spark):
    log = [(1, 0, "m1", 0, "open", "user", None, None, None), (1, 0, "m1", 1, "delta", None, "one", None, None), (1, 1, "m2", 0, "open", "assistant", None, None, None), (1, 1, "m2", 1, "delta", None, "two", None, None), (1, 2, "m3", 0, "open", "user", None, None, None), (1, 2, "m3", 1, "delete", None, None, None, None)]
    random.Random(1).shuffle(log)
    rows = C.formatted(spark.createDataFrame(log * 2, C.LOG).repartition(3)).orderBy("part", "piece").collect()
    assert "".join(r["formatted"] for r in rows) == "### user\none</turn>\n### assistant\ntwo</turn>\n"
    assert [r["formatted"][m["start"] : m["end"]] for r in rows for m in r["mask"]] == ["two"]
    assert C.formatted(spark.createDataFrame([], C.LOG)).count() == 0
