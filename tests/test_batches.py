"""Whole batches, the store, and streams."""

import pytest
from pyspark.sql import functions as F

from datatrawl.operators.frontier import first_per_url
from datatrawl.operators.url_filter import with_maybe
from datatrawl.plans.batch import run_batch
from datatrawl.plans.inputs import Inputs
from datatrawl.plans.store import Store
from datatrawl.sources.search import parse_search_payload, search_cursor
from datatrawl.sources.seeds import seed_urls_stream
from datatrawl.streaming.cursors import read_cursor_state, read_cursors, run_cursor_state, run_cursor_stream
from datatrawl.streaming.frontier_stream import cached_dedupe_stream, dedupe_stream, run_frontier_stream
from datatrawl.streaming.recheck import recheck
from datatrawl.streaming.seeds import run_seed_stream

FRONTIER = "parent_url string, url string, source string, from_queue boolean"
PAGES = [
    # a collector page without data: its sub-pages are looked at
    (1, "http://h/", '<title>Home</title><a href="/sub">s</a><a href="/empty">e</a><a href="http://o/x">o</a>'
                     '<a href="/pic.png">p</a><a href="/">self</a>'),
    (2, "http://h/sub", '<title>Sub</title><ul><li><a href="http://h/f/data.zip">get</a></li>'
                        '<li><a href="http://h/m.xml">Metadata</a></li></ul>'),
    (3, "http://h/empty", "<title>Empty</title>"),
    (4, "http://o/x", '<title>Other</title><a href="http://h/f/data.zip">get</a><a href="/y.csv">y</a>'),
    (5, "http://o/later", '<title>Later</title><a href="http://h/f/data.zip">get</a><a href="z.kml">z</a>'),
]


@pytest.fixture(scope="module")
def inputs(spark):
    empty = spark.createDataFrame([], "id long, url string")
    return Inputs(
        pages=spark.createDataFrame(PAGES, "page_id long, url string, html string"),
        link_probes=spark.createDataFrame([("http://h/m.xml", "text/xml")],
                                          "url string, content_type string"),
        metadata_docs=spark.createDataFrame([(
            "http://h/m.xml", "<m><west>1</west><east>2</east><north>3</north><south>4</south></m>\n")],
            "url string, xml string"),
        gazetteer=spark.createDataFrame([("Acme Maps", "organization")], "phrase string, major_type string"),
        lemmas=spark.createDataFrame([("created", "create")], "form string, root string"),
        tab_url=empty, tab_links=empty, phrase_lengths=(2,))


def frontier(spark, *urls):
    return spark.createDataFrame([(None, u, "MANUAL_ENTRY", True) for u in urls], FRONTIER)


def snapshot(store):
    return {t: sorted(tuple(r) for r in store.table(t).drop("updated_at", "batch_id").collect())
            for t in ("tab_url", "tab_links", "tab_url_link_map", "tab_title", "metadata_files",
                      "tab_spatialextent")}


def test_batches_follow_each_other(spark, inputs, tmp_path):
    store = Store(spark, str(tmp_path))
    assert run_batch(store, 0, frontier(spark, "http://h/", "http://h/", "http://gone/"), inputs)
    first = snapshot(store)
    assert first["tab_url"] == [(1, "http://h/sub", "http://h/", 0, "MANUAL_ENTRY")]
    assert [r[2] for r in first["tab_title"]] == ["Sub"]
    (link,) = first["tab_links"]
    assert link[:2] == (1, "http://h/f/data.zip") and link[2].endswith("_data.txt")
    assert first["metadata_files"][0][0] == link[2]
    assert [r[2] for r in first["tab_spatialextent"]] == ["west: 1;east: 2;north: 3;south: 4"]

    assert run_batch(store, 1, frontier(spark, "http://o/x", "http://h/sub"), inputs)
    second = snapshot(store)
    assert [r[:2] for r in second["tab_url"]] == [(1, "http://h/sub"), (2, "http://o/x")]
    assert [r[:2] for r in second["tab_links"]] == [(1, "http://h/f/data.zip"), (2, "http://o/y.csv")]
    assert second["tab_url_link_map"] == [(1, 1), (2, 1), (2, 2)]
    assert [r[0] for r in second["tab_title"]] == [1, 2]

    # counts were taken while the tables were written; the filter knows what is stored
    counts = {r.batch_id: (r.n_urls, r.n_stored, r.n_subpages, r.n_links, r.n_new_links) for r in store.run_counts().collect()}
    assert counts == {0: (4, 1, 2, 1, 1), 1: (2, 1, 0, 2, 1)}
    known = spark.createDataFrame([("http://h/sub",), ("http://o/x",), ("http://new/",)], "url string")
    assert {r.url: r._maybe for r in with_maybe(known, store.url_filter()).collect()} == {
        "http://h/sub": True, "http://o/x": True, "http://new/": False}

    # a batch that is there already is left alone
    assert not run_batch(store, 1, frontier(spark, "http://o/later"), inputs)
    assert snapshot(store) == second and store.run_counts().count() == 2

    probes = spark.createDataFrame([("http://h/sub", 404, None)], "url string, http_code int, error string")
    assert recheck(store, probes, 0)
    assert {r.url: r.status for r in store.current_tab_url().collect()} == {"http://h/sub": 3, "http://o/x": 3}
    alive = spark.createDataFrame([("http://h/sub", 200, None)], "url string, http_code int, error string")
    assert recheck(store, alive, 1) and not recheck(store, alive, 1)
    current = {r.url: r.status for r in store.current_tab_url().collect()}
    assert current == {"http://h/sub": 0, "http://o/x": 3}
    # a merged table stands for the versions up to it
    assert store.merge_status(1) and not store.merge_status(1) and not store.merge_status(9)
    assert {r.url: r.status for r in store.current_tab_url().collect()} == current
    assert recheck(store, probes, 2)
    assert {r.url: r.status for r in store.current_tab_url().collect()} == {"http://h/sub": 3, "http://o/x": 3}


def test_unmarked_batches_do_not_show(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, 1, None)], "url_id long, link_id long, updated_at timestamp")

    class Broken(Exception):
        pass

    class Fails:
        @property
        def write(self):
            raise Broken

    with pytest.raises(Broken):
        store.commit_batch(5, {"tab_url_link_map": rows, "tab_links": Fails()})
    assert store.table("tab_url_link_map").count() == 0
    assert store.commit_batch(5, {"tab_url_link_map": rows})
    assert not store.commit_batch(5, {"tab_url_link_map": rows})
    assert store.table("tab_url_link_map").count() == 1
    assert store.table("tab_url_link_map", without=5).count() == 0


def test_frontier_stream_equals_batches_and_survives_replay(spark, inputs, tmp_path):
    folder, base, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    store = Store(spark, base)

    def feed(*urls):
        frontier(spark, *urls).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(FRONTIER).option("maxFilesPerTrigger", 1).parquet(folder)
        run_frontier_stream(stream, store, inputs, state).awaitTermination()

    feed("http://h/")
    feed("http://o/x", "http://h/sub")
    got = snapshot(store)
    assert [r[:2] for r in got["tab_url"]] == [(1, "http://h/sub"), (2, "http://o/x")]
    # a fresh checkpoint replays batch 0 and 1 against a store that has them
    again = spark.readStream.schema(FRONTIER).option("maxFilesPerTrigger", 1).parquet(folder)
    run_frontier_stream(again, store, inputs, str(tmp_path / "state2")).awaitTermination()
    assert snapshot(store) == got


def drain(stream, spark, name, state):
    query = (stream.writeStream.format("memory").queryName(name)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name)


def test_dedupe_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    for urls in (["a", "b", "a"], ["b", "c"], ["a", "d"]):
        frontier(spark, *urls).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(FRONTIER).option("maxFilesPerTrigger", 1).parquet(folder)
    once = drain(dedupe_stream(stream), spark, "once", str(tmp_path / "s1"))
    batch = first_per_url(spark.read.schema(FRONTIER).parquet(folder))
    assert sorted(r.url for r in once.collect()) == sorted(r.url for r in batch.collect())
    timed = stream.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    bounded = drain(dedupe_stream(timed, "1 hour"), spark, "bounded", str(tmp_path / "s2"))
    assert sorted(r.url for r in bounded.collect()) == ["a", "b", "c", "d"]


def test_seed_stream_moves_used_files(spark, tmp_path):
    seeds, used = tmp_path / "seeds", tmp_path / "used"
    seeds.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for number, lines in enumerate((["http://a/", "", "bad"], ["http://a/", "http://b/"], ["http://c/"])):
        (seeds / f"{number}.txt").write_text("\n".join(lines))
        run_seed_stream(spark, str(seeds), out, state, str(used)).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == [
        "http://a/", "http://a/", "http://b/", "http://c/"]
    archived = sorted(p.name for p in used.rglob("*.txt"))
    left = sorted(p.name for p in seeds.glob("*.txt"))
    assert archived and sorted(archived + left) == ["0.txt", "1.txt", "2.txt"]
    assert seed_urls_stream(spark, str(seeds)).isStreaming


def test_cursor_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "response_id long, term string, payload string"

    def payload(i):
        return (i, f"t{i % 2}", '{"statuses":[{"id_str":"%d","entities":{"urls":[]}}],'
                '"search_metadata":{"max_id_str":"%d","count":%d}}' % (i, i + 5, i % 3))

    for part in ([payload(1), payload(2)], [payload(3)], [payload(5), payload(4)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        run_cursor_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = search_cursor(parse_search_payload(spark.read.schema(schema).parquet(folder)))
    assert sorted(read_cursors(spark, str(tmp_path / "out")).collect()) == sorted(batch.collect())


def test_cursor_state_equals_batch_and_survives_restarts(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "response_id long, term string, payload string"

    def payload(i):
        return (i, f"t{i % 2}", '{"statuses":[{"id_str":"%d","entities":{"urls":[]}}],'
                '"search_metadata":{"max_id_str":"%d","count":%d}}' % (i, i + 5, i % 3))

    for part in ([payload(1), payload(2)], [payload(3)], [payload(8), payload(5)], [payload(4), (9, "t1", "{}")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        run_cursor_state(spark.readStream.schema(schema).parquet(folder), state).awaitTermination()
    batch = search_cursor(parse_search_payload(spark.read.schema(schema).parquet(folder)))
    assert sorted(read_cursor_state(spark, state).collect()) == sorted(batch.collect())


def test_cached_dedupe_forgets_by_time_and_size(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "url string, ts timestamp, n int"

    def feed(name, *rows):
        df = spark.createDataFrame([(u, t, n) for u, t, n in rows], "url string, t long, n int")
        df.select("url", F.timestamp_seconds("t").alias("ts"), "n").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        kept = cached_dedupe_stream(stream, time_to_live=100, idle=30, entries=3, buckets=1)
        query = (kept.writeStream.format("parquet").option("path", str(tmp_path / name))
                 .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted((r.n, r.url) for r in spark.read.parquet(str(tmp_path / name)).collect())

    assert feed("a", ("a", 0, 0), ("a", 5, 1), ("b", 6, 2), (None, 7, 3)) == [(0, "a"), (2, "b")]
    # b was idle too long; a is kept alive until its time is up
    got = feed("a", ("a", 20, 4), ("b", 40, 5), ("a", 45, 6), ("a", 70, 7), ("a", 95, 8), ("a", 101, 9))
    assert got == [(0, "a"), (2, "b"), (5, "b"), (9, "a")]
    # beyond three entries the one seen longest ago goes
    got = feed("a", ("c", 102, 10), ("d", 103, 11), ("a", 104, 12), ("e", 105, 13), ("c", 106, 14), ("a", 107, 15))
    assert [n for n, _ in got[4:]] == [10, 11, 13, 14]
    state = spark.read.format("statestore").load(str(tmp_path / "a-state"))
    assert [len(r.value.groupState.url) for r in state.collect()] == [3]
    # a fresh checkpoint goes over all files to the same rows
    assert feed("again", ("z", 108, 16)) == sorted([*got, (16, "z")])
