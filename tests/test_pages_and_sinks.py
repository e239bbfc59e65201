import time

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import pages, sink
from lumenframe.sources.markup import Page
from lumenframe.streaming import crawl as C


def test_long_pages_take_one_pass():
    n = 50_000
    html = "".join(f'<li class="f"><a href="/f/{i}">T {i}</a><b class="d">D</b></li>' for i in range(n))
    began = time.perf_counter()
    got = Page(html).records(("li", "f"), [("a", None), ("a", "@href"), ("b", "d"), ("i", None)])
    assert len(got) == n and got[-1] == (f"T {n - 1}", f"/f/{n - 1}", "D", None)
    nested = Page('<div class="a">x' * 2400 + "</div>" * 2400).records(("div", "a"), [("div", "a")])
    assert len(nested) == 2400 and nested[-1] == (None,) and time.perf_counter() - began < 60


def test_misnested_and_open_elements():
    p = Page('</div><div class="a"><p>one<p>two</p></div><div class="a"><b>x</div></b><div class="a">open')
    assert [p.text(e) for e in p.elements(("div", "a"))] == ["onetwo", "x"]
    assert [p.text(e) for e in p.elements(("p", None))] == ["two"]
    assert p.records(("div", "a"), [("b", None)]) == [(None,), (None,)]  # its end lies outside


@pytest.mark.parametrize(
    "href, want",
    [("x", "http://h.e/a/x"), ("./x?q=1#f", "http://h.e/a/x?q=1"), ("../x", "http://h.e/x"), ("../../x", "http://h.e/x"), ("/x/./y/../z", "http://h.e/x/z"), ("//o.e/x", "http://o.e/x"), ("https://o.e/x", "https://o.e/x"), ("mailto:a@b", None), ("", "http://h.e/a/b"), ("#top", "http://h.e/a/b"), ("?q=2", "http://h.e/a/b?q=2"), ("..", "http://h.e/")],
)
def test_addresses(spark, href, want):
    assert spark.createDataFrame([("http://h.e/a/b?z=1", href)], "b string, h string").select(C.resolved(F.col("b"), F.col("h")).alias("u")).first()["u"] == want


def test_a_crawl_goes_on_where_it_stopped(spark, tmp_path):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    stored = [("http://h/1", f"<h1>one</h1>{link('2', '/3')}"), ("http://h/2", link("http://h/4", "5")), ("http://h/3", f"<h1>three</h1>{link('1')}"), ("http://h/4", "<h1>four</h1>")]
    stored = spark.createDataFrame(stored, "url string, html string")
    seeds = spark.createDataFrame([("http://h/1",), (None,)], "url string")
    parse = lambda h: F.transform(pages.element_texts(h, "h1"), lambda x: F.struct(x.alias("title")))
    links = lambda h: F.transform(pages.links(h), lambda l: l["href"])
    root = f"file://{tmp_path}/c"
    run = lambda **k: C.crawl(spark, root, stored, seeds, parse, links, **k)
    marks = lambda: {r["url"][-1]: (r["depth"], r["status"]) for r in C.results(spark, root)[1].collect()}
    assert run(budget=2, per_round=1) == 2 and marks() == {"1": (0, "found"), "2": (1, "empty")}
    assert run() == 3 and marks() == {"1": (0, "found"), "2": (1, "empty"), "3": (1, "found"), "4": (2, "found"), "5": (2, "missing")}
    assert run() == 0 and run(retry=True) == 2  # what gave nothing is tried once more
    assert sorted(r["title"] for r in C.results(spark, root)[2].collect()) == ["four", "one", "three"]


def test_batches_are_appended_once(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    df = spark.createDataFrame([(1, 'a "quoted", cell\nof two lines', [1, None])], "n int, t string, l array<int>")
    assert sink.rows(spark, path) is None
    assert sink.append(df, path, 0, "csv") and not sink.append(df, path, 0, "csv") and sink.append(df.select("t", "l", (F.col("n") + 1).alias("n")), path, 1, "csv")
    assert sorted(map(tuple, sink.rows(spark, path).collect())) == [("1", 'a "quoted", cell\nof two lines', "[1,null]"), ("2", 'a "quoted", cell\nof two lines', "[1,null]")]
    assert [r["value"] for r in sink.lines(spark, path).where("batch = -1").collect()] == ["n,t,l"]
    with pytest.raises(ValueError):
        sink.append(df.drop("t"), path, 2, "csv")


def test_a_stream_stopped_after_writing_gives_each_row_once(spark, tmp_path, monkeypatch):
    spark.range(40).repartition(4).write.parquet(f"{tmp_path}/in")
    path, checkpoint = f"file://{tmp_path}/s", f"{tmp_path}/c"
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    whole, calls = sink.append, []

    def killed(df, *rest):  # the batch is written, and then the stream dies before it can say so
        done = whole(df, *rest)
        calls.append(done)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return done

    monkeypatch.setattr(sink, "append", killed)
    with pytest.raises(Exception, match="killed"):
        sink.stream_into(stream(), path, checkpoint).awaitTermination()
    sink.stream_into(stream(), path, checkpoint).awaitTermination()
    assert calls == [True, True, False, True, True]
    assert sorted(r["id"] for r in sink.rows(spark, path).collect()) == list(range(40))


def test_a_crawl_sends_no_growing_table_by_way_of_the_driver(spark):
    few = spark.createDataFrame([("a",)], "url string")
    plan = C._without(few, few)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_what_is_found_goes_on_in_parts(monkeypatch):
    """A worker must not hold what it finds in a whole batch of pages."""
    import pandas as pd

    taken = []
    monkeypatch.setattr(pages.F, "pandas_udf", lambda f, kind: lambda column: taken.append(f))
    pages.element_texts(None, "b")
    batch = pd.Series(["<b>x</b>", None, "<p>"] * 300)
    parts = list(taken[0](iter([batch, batch.iloc[:0]])))
    assert [x for p in parts for x in p] == [["x"], None, []] * 300 and max(map(len, parts)) <= 256
