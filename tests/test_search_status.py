from datatrawl.operators import status as st
from datatrawl.sources import search as se


def payloads(spark, *rows):
    return spark.createDataFrame(list(rows), "response_id long, term string, payload string")


EMPTY = '{"statuses":[],"search_metadata":{"max_id_str":"9","count":3}}'
FULL = ('{"statuses":[{"id_str":"7","entities":{"urls":[{"expanded_url":"http://a"},{"expanded_url":""}]}},'
        '{"id_str":"5","entities":{"urls":[{"expanded_url":"http://b"}]}}],'
        '"search_metadata":{"max_id_str":"8","count":10}}')


def test_bad_and_null_responses(spark):
    df = se.parse_search_payload(payloads(
        spark, (1, "t", FULL), (2, "t", "{nope"), (3, "t", None), (4, "t", '{"statuses":[]}')))
    assert {r.response_id: r.is_bad for r in df.collect()} == {1: False, 2: True, 4: True}
    assert sorted(r.url for r in se.search_urls(df).collect()) == ["http://a", "http://b"]


def test_cursor_newest_wins_and_empty_page(spark):
    df = se.parse_search_payload(payloads(
        spark, (1, "t", EMPTY), (2, "t", FULL), (3, "u", FULL), (4, "u", EMPTY)))
    got = {r.term: (r.since_id, r.max_id, r.last_count) for r in se.search_cursor(df).collect()}
    assert got == {"t": (8, 4, 10), "u": (9, 2**63 - 2, 3)}


def test_request_plan(spark):
    cursors = spark.createDataFrame(
        [("#GIS #data", 9, 4, 3), ("b", 9, 4, 10), ("new", -1, -1, -1)],
        "term string, since_id long, max_id long, last_count int")
    got = {r.q: (r.since_id, r.max_id) for r in se.search_request_plan(cursors).collect()}
    assert got == {"%23GIS+%23data": (9, None), "b": (None, 4), "new": (None, None)}


def test_one_redirect_only(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "url string, location string")
    assert sorted(r.url for r in se.expand_urls(urls, hops).collect()) == ["b", "c", "c"]


def test_status_transitions(spark):
    rows = [("d0", 0, 500), ("a0", 0, 200), ("d1", 1, None), ("a1", 1, 399), ("x2", 2, 500), ("a3", 3, 200),
            ("d3", 3, 404), ("a4", 4, 200), ("d4", 4, 400), ("a5", 5, 200)]
    table = spark.createDataFrame([(u, s) for u, s, _ in rows], "url string, status int")
    probes = spark.createDataFrame([(u, c, None) for u, _, c in rows if c],
                                   "url string, http_code int, error string")
    changes = st.next_status(st.check_urls(table, probes))
    assert {r.url: r.status for r in changes.collect()} == {"d0": 3, "d1": 4, "a3": 0, "a4": 0}
    after = {r.url: r.status for r in st.apply_status(table, changes).collect()}
    assert after == {"d0": 3, "a0": 0, "d1": 4, "a1": 1, "x2": 2, "a3": 0, "d3": 3, "a4": 0, "d4": 4, "a5": 5}
