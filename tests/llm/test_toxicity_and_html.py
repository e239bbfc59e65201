import random
import zlib
from collections import Counter

import pytest

from lumenframe.llm import html_blocks as H
from lumenframe.llm import toxicity as X


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    syllables = ["tha", "ner", "ion", "est", "ou", "re", "ble", "ly", "and", "sh", "in", "ea"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(30, 250))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(max(2, len(ws) // 40)):
                ws[rng.randrange(len(ws))] = rng.choice(["grobnik", "vexulous", "dummkopf", "quarzil"])
        out.append((i, " ".join(ws), toxic))
    return out


def test_articles_keep_what_names_only_hint_at():
    p = f"<p>{'word ' * 40}</p>"
    item = lambda t: f"<li><a href='/x'>{t}</a></li>"
    listed = H.main_text(f"<article>{p}<ul>{item('one two')}{item('three four')}{item('five six')}</ul>{p}</article>").split("\n")
    assert listed[1:4] == ["one two", "three four", "five six"]
    kept = H.main_text(f"<article>{p}<p class='alert'>{'prose ' * 50}</p><section id='social'>{'more ' * 50}</section><div class='share-buttons'>Share this</div><div class='comments'>{'spite ' * 30}</div>{p}</article>")
    assert "prose" in kept and "more" in kept and "Share" not in kept and "spite" not in kept


def test_held_out_accuracy(spark):
    rows = corpus()
    documents = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(9001, None, "x", 1.0), (9002, "", "x", 1.0), (None, "a " * 30_000, "x", 1.0)], "doc_id bigint, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 0, None), (None, 1, 1), (77777, 1, 1), (0, 1, rows[0][2])], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in X.classify(documents, labels).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.03 * len(held)
    assert got[9001]["score"] == got[9002]["score"] < 0.7
    kept = X.kept(documents, X.fit(documents, labels))
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_the_toxic_dictionary_holds_what_marks_toxic_text():
    """Segments that toxic documents hold beyond chance, and none of what ordinary ones hold as often, parted the held-out documents."""
    rows = corpus(900, seed=3)
    learn, held = rows[:700], rows[700:]
    model = X.train(learn)
    assert all(w[:6] in model.toxic for w in (b"grobnik", b"vexulous", b"dummkopf", b"quarzil")) and b"grobnik" not in model.ordinary and len(model.toxic) <= X.TOXIC + max(X.LENGTHS)
    pair = model.compressors()
    saved = {y: [X.Model.saved(t, pair) for _, t, z in held if z == y] for y in (0, 1)}
    assert sorted(saved[1])[len(saved[1]) // 10] > max(sorted(saved[0])[: int(0.98 * len(saved[0]))])


def test_segments_are_parted_and_too_rare_ones_left_out():
    """What 20 of 1,500 toxic documents hold may be as frequent in ordinary text; nothing matches across two segments; of few documents a quarter is enough."""
    made = X._contrasted(Counter(), Counter({b" grob": 400, b"nikvex": 300, b"rarely": 20}), 1500, 1500)
    assert made.split(b"\n") == [b"", b"nikvex", b" grob"] and b"\n" not in b"".join(X.windows("a\nb " * 100))
    assert b" grob" in X._contrasted(Counter(), Counter({b" grob": 14}), 24, 24)


def test_words_of_a_small_language_count_too():
    """A tenth of the toxic documents share a stem of their own, with other endings; it is learned beside the rest."""
    rng = random.Random(2)
    rows = [(i, t if not y or rng.random() > 0.1 else t + " schlumpf" + rng.choice(["ig", "er", "ung"]) * 2, y) for i, t, y in corpus(900, seed=6)]
    assert b"schlumpf"[:7] in X.train(rows).toxic


def test_training_reads_whole_texts(spark):
    plain = [t for _, t, y in corpus(1600, seed=5) if not y]
    rows = [(i, " ".join(plain[20 * i : 20 * i + 20]) + (" grobnik vexulous" * 40 if i % 2 else ""), i % 2) for i in range(60)]
    assert min(t.find(" grobnik vexulous grobnik") for _, t, y in rows if y) > 12_000 and max(t.find(" grobnik vexulous grobnik") for _, t, y in rows if y) > 20_000
    model = X.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id bigint, toxic int"))
    assert X.Model.saved("grobnik vexulous grobnik", model.compressors()) > 5 > 1 > X.Model.saved(plain[0], model.compressors())


def test_held_out_labels_teach_nothing(spark):
    rows = corpus(200)
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    learn = [(i, y) for i, _, y in rows]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in learn]
    a, b = (X.fit(documents, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (learn, flipped))
    assert vars(a) == vars(b)


def test_nothing_to_learn_from(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in X.classify(docs, none).collect()} == {0.0} and X.classify(empty, none).count() == 0


def test_windows_cover_whole_texts():
    text = "ab " * 1000 + "z" * 500 + " é\n"
    assert sum(w.count(b"ab") for w in X.windows(text)) == 1000 and max(map(len, X.windows(text))) <= X.WINDOW + 2 and X.windows(None) == X.windows(" ") == []


def test_tree_fits_its_table():
    assert all(H.decide(H.tree(), r[:-1]) == r[-1] for r in H.LABELLED)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<", "<"), ("<p", ""), ("<!-- x", ""), ("<script>abc", ""),
        ("<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>one<br>two&nbsp; three<p>x &lt;b&gt;</article><footer>end</footer>", "A & B\none two three\nx <b>"),
        ("<article><p>a<p>b<div class='ad'>no</div>c<script>var t='</p>';</script>d</article>e", "a\nb\nc d"),
        ("<main><div class=\"comments\"><p>first!</p></div><form><p>mail</p></form><p title='a>b'>kept</p></main>", "kept"),
        ("<article><aside><article>no</article></aside><header><h1>Head</h1></header>body &#x41;&bogus;", "Head\nbody A&bogus;"),
        ("<div class='top'>Site</div><div id='wrap'><div class='post-content'><p>Short.</p><p>Also short.</p><div class=share>Share!</div></div><div class='sidebar'><p>No.</p></div></div>", "Short.\nAlso short."),
        ("<div role=main><p>yes</p></div><div role='navigation'><article>no</article></div>", "yes"),
        ("<article><p>a b</p><div class='share-price'><p>Shares rose by ten.</p></div><section id='search-engines'><p>They find pages.</p></section></article>", "a b\nShares rose by ten.\nThey find pages."),
        ("<body><div><p>Only a short paragraph stands here.</p></div></body>", "Only a short paragraph stands here."),
        ("<article><h1>H</h1><div class='article-header'>in</div><div class='post-comments'>no</div><div class='x ad-slot-3'>no</div><div class='cookie-notice'>no</div><div class='share-buttons'>no</div><div id=comments><p>no</p></div><p>z</p></article>", "H\nin\nz"),
        ("<article></article><div><p>" + "text " * 30 + "</p></div>", ("text " * 30).strip()),
        ("<div><p>" + "word " * 40 + "</p><p>" + "more " * 50 + "</p></div><ul><li><a href=x>a</a></li><li><a href=y>b</a></li></ul>", ("word " * 40).strip() + "\n" + ("more " * 50).strip()),
    ],
)
def test_main_text(page, want):
    assert H.main_text(page) == want


def plain_page(rng):
    """A page without any structure of its own: (html, its content blocks)."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    run = lambda a, b: [word() for _ in range(rng.randint(a, b))]
    link = lambda ws: "<a href='/x'>" + " ".join(ws) + "</a>"
    out, want = [], []
    out += [f"<div>{link(run(1, 2))}</div>" for _ in range(rng.randint(3, 8))]
    head = run(4, 12)
    out.append(f"<div>{' '.join(head)}</div>")
    want.append(" ".join(head))
    for k in range(rng.randint(2, 9)):
        ws = run(25, 120) if k == 0 or rng.random() < 0.7 else run(3, 24)
        want.append(" ".join(ws))
        if len(ws) > 12 and rng.random() < 0.3:
            at = rng.randrange(len(ws) - 4)
            ws = [*ws[:at], link(ws[at : at + 3]), *ws[at + 3 :]]
        out.append(f"<p>{' '.join(ws)}</p>")
    out += [f"<div>{' '.join(run(1, 4))}</div>"] * rng.randint(0, 1)
    out += [f"<li>{link(run(2, 9))} {' '.join(run(0, 2))}</li>" for _ in range(rng.randint(2, 6))]
    out.append(f"<div>{' '.join(run(3, 9))}</div>")
    return "<html><body>" + "".join(out) + "</body></html>", want


def test_tree_on_labelled_plain_pages():
    """Held-out precision and recall of blocks on 300 pages without marks, which link density and neighbours decide."""
    rng, hit, found, wanted = random.Random(8), 0, 0, 0
    for _ in range(300):
        page, want = plain_page(rng)
        got = H.main_text(page).split("\n")
        hit += len(set(got) & set(want))
        found += len(got)
        wanted += len(want)
    assert hit >= 0.95 * found and hit >= 0.95 * wanted, (hit / found, hit / wanted)


def test_neighbours_decide():
    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(H.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(H.tree())
    assert {"density", "density_before", "density_after"} <= used


def test_extract(spark):
    ddl = "page_id bigint, url string, html string, text string, n_chars string"
    pages = [(1, "u", "<article>é x</article>", "x", "x"), (1, "u", "<article>é x</article>", "x", "x"), (None, None, None, None, None), (2, "v", "<article>" + "<p>w</p>" * 20_000 + "</article>", "x", "x")]
    got = H.extract(spark.createDataFrame(pages, ddl)).collect()
    assert sorted(((r["page_id"] or 0, r["url"], r["text"][:9], r["n_chars"]) for r in got), key=repr) == [(0, None, "", 0), (1, "u", "é x", 3), (1, "u", "é x", 3), (2, "v", "w\nw\nw\nw\nw", 39_999)]
    assert H.extract(spark.createDataFrame([], ddl)).count() == 0
