"""The page source, the request table, pacing and expiry, against counted calls and plain clocks."""

import json
import time
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from foliospark.sources import pages as P
from foliospark.sources.pages import Harvest, Limiter, Search, read_pages, scan_all, stream_pages
from foliospark.sources.retries import RetryPolicy
from foliospark.sources.requests import endpoint, fetch_pages
from foliospark.sources.providers import Registry

TRANSPORT = "tests.catalogue:logged_get"


@pytest.fixture
def calls(tmp_path, monkeypatch):
    """The requests sent, by any process: the transport writes each to a file of its own."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def seen():
        found = [json.loads(p.read_text()) for p in folder.iterdir()]
        return sorted(found, key=lambda c: c["at"])

    seen.url = f"http://x?{folder}"
    return seen


def search(provider, queries, pages, size, url, delay=0.0):
    return Search(provider, url, "query", "offset", "rows", queries, pages, size, False, True, delay, "total", "items")


def test_searches_of_a_provider_stay_apart(spark, calls):
    asked = [search("a", ["x"], [1, 2], 25, calls.url), search("a", ["y"], [2, 1], 50, calls.url), search("b", ["z"], [1, 7], 100, calls.url)]
    pages = read_pages(spark, asked, TRANSPORT)
    assert pages.rdd.getNumPartitions() == 2
    rows = sorted((r["provider_name"], r["query"], r["page"]) for r in pages.collect())
    assert rows == [("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("a", "y", 2), ("b", "z", 1)]
    sent = Counter((c["query"], c["offset"], c["rows"]) for c in calls())
    assert sent == {("x", 1, 25): 1, ("x", 26, 25): 1, ("y", 1, 50): 1, ("y", 51, 50): 1, ("z", 1, 100): 1}


def test_filters_prune_requests(spark, calls):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    asked = [search(p, ["x", "y"], [1, 2, 3], 20, calls.url) for p in ("a", "b", "c")]
    got = read_pages(spark, asked, TRANSPORT).where("provider_name IN ('a', 'b') AND query = 'y' AND page = 2")
    assert got.rdd.getNumPartitions() == 2
    assert sorted((r["provider_name"], r["query"], r["page"]) for r in got.collect()) == [("a", "y", 2), ("b", "y", 2)]
    assert Counter((c["query"], c["offset"]) for c in calls()) == {("y", 1): 2, ("y", 21): 2}
    assert read_pages(spark, asked, TRANSPORT).where("provider_name = 'nobody'").count() == 0


def test_a_search_ends_alone_and_an_error_ends_all():
    answers = {"q1": (200, {}, '{"total": 30, "items": []}'), "q2": (503, {}, ""), "q3": (200, {}, '{"items": [1]}'), "q4": (404, {}, ""), "q5": (200, {}, "{}")}
    sent = []

    def get(url, params):
        sent.append(params["query"])
        return answers[params["query"]]

    harvest = Harvest(get, Limiter(0), sleep=lambda s: None)
    rows = list(scan_all([search("p", [q], [1, 2, 3], 20, "u") for q in answers], harvest))
    assert [(r[0], r[2], r[3]) for r in rows] == [("q1", 1, "processed"), ("q1", 2, "processed"), ("q2", 1, "error"), ("q3", 1, "processed"), ("q4", 1, "error")]
    assert Counter(sent) == {"q1": 2, "q2": 1 + RetryPolicy().retries, "q3": 1, "q4": 1}


def test_a_validator_decides_what_is_sent_again():
    bodies = iter(["wait", "wait", "done"])
    valid = lambda status, headers, body: body == "done"
    assert RetryPolicy().run(lambda: (429, {}, next(bodies)), lambda s: None, valid=valid)[2] == "done"
    assert RetryPolicy().run(lambda: (200, {}, "wrong"), lambda s: None, valid=valid)[2] == "wrong"  # not worth a retry
    assert RetryPolicy().run(lambda: (503, {}, "kept"), pytest.fail, valid=lambda *a: True)[2] == "kept"
    rows = list(scan_all([search("p", ["q"], [1], 20, "u")], Harvest(lambda u, p: (200, {}, "no"), Limiter(0), valid=valid)))
    assert rows[0][3] == "error"


def test_retry_after_is_kept_for_the_next_search():
    clock = [100.0]
    sent = []

    def sleep(seconds):
        clock[0] += seconds

    def get(url, params):
        sent.append((params["query"], clock[0]))
        return (200, {"Retry-After": "30"} if params["query"] == "a" else {}, '{"total": 1}')

    harvest = Harvest(get, Limiter(2, lambda: clock[0], sleep), sleep)
    list(scan_all([search("p", ["a", "b", "c"], [1], 20, "u")], harvest))
    assert sent == [("a", 100.0), ("b", 130.0), ("c", 132.0)]


def requests(spark, *rows):
    return spark.createDataFrame(rows, "provider_name string, search string, query string, page int, records_per_page int, clash string")


def entries(spark, *rows):
    return spark.createDataFrame(rows, "provider_name string, query string, page int, records_per_page int, status_code int, content_type string, content string, expire_at timestamp")


def test_requests_of_a_table(spark, calls):
    registry = Registry()
    known = [replace(endpoint(registry.get(p), "total", "items", 0.0), base_url=calls.url) for p in ("crossref", "plos")]
    asked = requests(spark, ("crossref", "s1", "x", 1, 20, "c"), ("crossref", "s1", "x", 2, 20, "c"), ("crossref", "s1", "x", 4, 20, "c"), ("crossref", "s2", "x", 1, 60, "c"), ("plos", None, "y", 1, None, None), ("plos", None, "y", 1, None, None), ("none", "s", "x", 1, 5, None), (None, "s", "x", 1, 5, None), ("plos", "s", None, 1, 5, None))
    got = fetch_pages(asked.repartition(3), known, TRANSPORT).collect()
    assert sorted((r["provider_name"], r["search"] or "", r["page"], r["status"], r["error"] or "") for r in got) == [("crossref", "s1", 1, "processed", ""), ("crossref", "s1", 2, "processed", ""), ("crossref", "s1", 4, "processed", ""), ("crossref", "s2", 1, "processed", ""), ("none", "s", 1, "nonresponse", "UnknownProvider"), ("plos", "", 1, "processed", "")]
    assert len(calls()) == 5 and not any(r["from_cache"] for r in got)
    assert fetch_pages(asked.limit(0), known, TRANSPORT).count() == 0


def test_only_misses_are_sent(spark, calls):
    known = [replace(endpoint(Registry().get("crossref"), "total", "items", 0.0), base_url=calls.url)]
    asked = requests(spark, *(("crossref", "s", q, p, 20, "c") for q in ("x", "y") for p in (1, 2, 3)))
    body = json.dumps({"total": 40, "items": [1]})
    old, new = "2020-01-01 00:00:00", "2999-01-01 00:00:00"
    kept = entries(spark, ("crossref", "x", 1, 20, 200, None, body, None), ("crossref", "x", 2, 20, 200, None, body, None), ("crossref", "y", 1, 20, 200, None, body, None), ("crossref", "y", 2, 25, 200, None, body, None)).withColumn("expire_at", F.when(F.col("query") == "x", F.to_timestamp(F.lit(new))).otherwise(F.to_timestamp(F.lit(old))))
    got = fetch_pages(asked, known, TRANSPORT, kept).collect()
    assert sorted((r["query"], r["page"], r["from_cache"]) for r in got) == [("x", 1, True), ("x", 2, True), ("y", 1, False), ("y", 2, False), ("y", 3, False)]
    assert [c["query"] for c in calls()] == ["y", "y", "y"]


def run(query, seconds=60):
    """Until nothing new comes, or fails."""
    query.processAllAvailable()
    query.stop()


def test_a_stream_of_pages_stops_between_pages_and_goes_on(spark, calls, tmp_path):
    asked = [search("a", ["x", "y"], [1, 2, 3, 4], 20, calls.url), search("b", ["z"], [1, 2], 20, calls.url)]
    write = lambda: stream_pages(spark, asked, TRANSPORT, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query = write().start()
    while not (tmp_path / "out" / "_spark_metadata" / "0").exists():
        assert query.exception() is None
        time.sleep(0.05)
    query.stop()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    run(write().start())
    rows = [(r["provider_name"], r["query"], r["page"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == [("a", "x", 1), ("a", "x", 2), ("a", "x", 3), ("a", "y", 1), ("a", "y", 2), ("a", "y", 3), ("b", "z", 1), ("b", "z", 2)]
    assert first <= len(rows)
    run(write().start())
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_stream_offsets_carry_all_that_a_restart_needs(monkeypatch):
    """Every batch read anew from its offsets gives its rows again; the delay holds across readers."""
    from tests import catalogue

    options = {"searches": json.dumps([search("a", ["x", "y"], [1, 2, 3, 4], 20, "u").__dict__]), "transport": "tests.catalogue:catalog_get", "pages_per_batch": "2"}
    at, pages = P._Stream(options).initialOffset(), []
    while True:
        rows, end = P._Stream(options).read(at)
        rows = list(rows)
        assert [r[:8] for r in P._Stream(options).readBetweenOffsets(at, end)] == [r[:8] for r in rows]
        if end["a"]["next"] == at["a"]["next"]:
            break
        at = json.loads(json.dumps(end))
        pages += [(r[0], r[2]) for r in rows]
    assert pages == [("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 2), ("y", 3)]
    waits = []
    monkeypatch.setattr(P, "Limiter", lambda delay, **kept: Limiter(delay, lambda: 1000.0, waits.append, **kept))
    slow = options | {"searches": json.dumps([search("a", ["x"], [1, 2], 20, "u", 5.0).__dict__])}
    stopped = {"a": {"next": 1, "query": "x", "page": 1, "ended": None, "stopped": False, "called": 998.0, "hold": 1009.0}}
    assert [r[2] for r in P._Stream(slow).read(stopped)[0]] == [2] and waits == [9.0]
    assert catalogue.catalog_get("u", {"query": "x", "rows": 20})[0] == 200


def feed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drop(folder, name, *rows):
    path = folder / f".{name}"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    path.rename(folder / name)


def wait_for(spark, query, path, n, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        if (path / "_spark_metadata").exists() and spark.read.schema("slot long").parquet(str(path)).count() >= n:
            return
        time.sleep(0.2)
    raise AssertionError("too slow")


def test_one_limiter_for_all_queries_of_a_provider(spark, tmp_path):
    from foliospark.streaming.limits import SIGNAL, paced, state_store

    state_store(spark)
    landed, out = tmp_path / "in", tmp_path / "out"
    landed.mkdir()
    ask = lambda p, q, *pages: [{"provider_name": p, "query": q, "page": k, "records_per_page": 20} for k in pages]
    start = lambda: paced(feed(spark, landed, SIGNAL), {"slow": 0.8, "fast": 0.0}).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).start()
    drop(landed, "1.json", *ask("slow", "x", 1, 2), *ask("fast", "x", 1, 2, 3))
    query = start()
    wait_for(spark, query, out, 2)
    query.stop()
    drop(landed, "2.json", *ask("slow", "y", 1, 2), {"provider_name": "slow", "retry_after": 3.0}, {"query": "no provider", "page": 1})
    began = time.time()
    query = start()
    wait_for(spark, query, out, 7)
    query.stop()
    rows = spark.read.parquet(str(out)).orderBy("slot").collect()
    slow = [r for r in rows if r["provider_name"] == "slow"]
    assert [(r["query"], r["page"]) for r in slow] == [("x", 1), ("x", 2), ("y", 1), ("y", 2)] and [r["slot"] for r in slow] == [0, 1, 2, 3]
    assert [(r["page"], r["records_per_page"]) for r in rows if r["provider_name"] == "fast"] == [(1, 20), (2, 20), (3, 20)]
    at = [r["send_at"].timestamp() for r in slow]
    assert all(b - a >= 0.799 for a, b in zip(at, at[1:], strict=False))
    assert any(b - a >= 2.5 for a, b in zip(at, at[1:], strict=False)) and began > 0  # what Retry-After asked for


def test_state_expires_while_streaming(spark, tmp_path):
    from foliospark.streaming.limits import remembered, state_store

    state_store(spark)
    landed, out = tmp_path / "in", tmp_path / "out"
    landed.mkdir()

    def batch(name, n, *rows):
        """The rows so far, once there are ``n``; each batch is a query of its own, so that all is read from the checkpoint."""
        drop(landed, name, *({"cache_key": k, "content": c} for k, c in rows))
        made = remembered(feed(spark, landed, "cache_key string, content string"), 8.0)
        query = made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).start()
        wait_for(spark, query, out, n)
        query.stop()
        return [(r["cache_key"], r["content"], r["hit"]) for r in spark.read.parquet(str(out)).collect()]

    assert sorted(batch("1.json", 2, ("a", "1"), ("b", "1"), (None, "x"))) == [("a", "1", False), ("b", "1", False)]
    began = time.time()
    second = batch("2.json", 3, ("a", "2"))
    assert time.time() - began > 7 or ("a", "1", True) in second  # what was stored comes back
    time.sleep(8.5)
    third = batch("3.json", 5, ("a", "3"), ("a", "4"))
    assert ("a", "3", False) in third and ("a", "3", True) in third
