"""Ranks, stops, tries, path order, id batches and the SQL store, against plain Python on hard inputs."""

import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.functions import paths as P
from foliospark.operators import results as X
from foliospark.operators import trie
from foliospark.operators.cache import open_store
from foliospark.plans.workflow import pack_ids, unpack_records
from foliospark.sources.sqlstore import SqlSource


def test_ranks_without_a_window_over_the_group(spark):
    """One provider has nearly all rows and one page holds half of them; nulls come first, ties are numbered once each."""
    rng = random.Random(4)
    rows = [("hot", rng.choice([3, rng.randrange(1, 500)]), i) for i in range(6000)] + [("b", k, k) for k in range(7)] + [(None, 2, 1), (None, 1, 2), ("n", None, 1), ("n", 5, 2), ("n", None, 3)]
    frame = spark.createDataFrame(rows, "provider_name string, page int, n int").repartition(5)
    ranked = X.round_robin(frame)
    assert not [line for line in ranked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line and "row_number" in line and "_salt" not in line]
    own = {}
    for r in ranked.collect():
        own.setdefault(r["provider_name"], []).append((r["turn"], r["page"], r["n"]))
    for provider, found in own.items():
        assert sorted(t for t, _, _ in found) == list(range(1, len(found) + 1))
        pages = [-1 if p is None else p for _, p, _ in sorted(found)]
        assert pages == sorted(pages)
        assert Counter((p, n) for _, p, n in found) == Counter((p, n) for q, p, n in rows if q == provider)
    assert X.round_robin(frame.limit(0)).count() == 0
    tasks = ranked.groupBy("provider_name", "turn").count().where("count > 1").count()
    assert tasks == 0


def test_no_range_of_a_dominant_key_is_large(spark):
    frame = spark.createDataFrame([("hot", k % 2 * 7, k) for k in range(8000)] + [("hot", k, k) for k in range(4000)], "provider_name string, page int, n int")
    largest = X.with_ranges(frame, "provider_name", "page", 64, 16).groupBy("provider_name", "_range", "_salt").count().agg(F.max("count")).first()[0]
    assert largest < 12000 / 16
    salted = X.ranked(frame, "provider_name", "page", "turn")
    assert salted.agg(F.count_distinct("turn"), F.max("turn")).first()[0:2] == (12000, 12000)


def test_halts_with_null_keys_and_without_stops(spark):
    rows = [("a", "q", 1, False), ("a", "q", 2, True), ("a", "q", 3, True), ("a", None, 1, True), ("a", None, 2, False), (None, "q", 1, False), (None, "q", 2, None), ("b", "q", 5, False)]
    frame = spark.createDataFrame(rows, "provider_name string, query string, page int, stop boolean")
    got = sorted(map(str, (tuple(r)[:3] for r in X.until_halt(frame, F.col("stop")).collect())))
    assert got == sorted(map(str, [("a", "q", 1), ("a", "q", 2), ("a", None, 1), (None, "q", 1), (None, "q", 2), ("b", "q", 5)]))


def random_paths(rng, n):
    return [[rng.choice(["a", "b", "1", "12", ""]) for _ in range(rng.randrange(1, 5))] for _ in range(n)]


@pytest.mark.parametrize("nodes", [200_000, 3])
def test_trie(spark, monkeypatch, nodes):
    monkeypatch.setattr(trie, "NODES", nodes)
    paths = random_paths(random.Random(nodes), 300)
    frame = spark.createDataFrame([(p, "x") for p in [*paths, None, [], ["a", None]]], "path array<string>, n_here string").repartition(4)
    want = {}
    for p in paths:
        below = sum(q[: len(p)] == p and len(q) > len(p) for q in paths)
        if below:
            want[tuple(p)] = (paths.count(p), below)
    got = {tuple(r["path"]): (r["n_here"], r["n_below"]) for r in trie.insert_conflicts(frame).collect()}
    assert got == want
    plan = trie.insert_conflicts(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_leaves_above_others_of_a_record(spark):
    rng = random.Random(8)
    records = [random_paths(rng, rng.randrange(0, 9)) for _ in range(200)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, paths array<array<string>>")
    for r in frame.select("id", trie.leaves_above(F.col("paths")).alias("above")).collect():
        own = records[r["id"]]
        want = {tuple(p) for p in own if any(q[: len(p)] == p and len(q) > len(p) for q in own)}
        assert {tuple(p) for p in r["above"]} == want and len(r["above"]) == len(want)


def test_path_order_of_numbers_of_any_length(spark, tmp_path):
    numbers = [0, 1, 9, 10, 99, 100, 99_999_999, 100_000_000, 10**9 - 1, 10**9, 10**17, 10**18, 10**30, 10**31]
    paths = [["r", str(n), "x"] for n in numbers] + [["r", f"item{n}"] for n in numbers] + [["r"], ["r", "z"], ["0007"], ["a"] * 12]
    frame = spark.createDataFrame([(p,) for p in paths], "path array<string>").withColumn("key", P.order_key(F.col("path")))
    order = [r["path"] for r in frame.orderBy("key").collect()]
    assert [p for p in order if len(p) == 3] == [["r", str(n), "x"] for n in numbers]
    assert [p for p in order if len(p) == 2 and p[1] != "z"] == [["r", f"item{n}"] for n in numbers] and [len(p) for p in order] == sorted(len(p) for p in order)
    small = [p for p in paths if all(len(c.removeprefix("item")) <= 8 for c in p) and len(p) < 10]
    padded = spark.createDataFrame([(p,) for p in small], "path array<string>").orderBy(P.sort_key(F.col("path"))).collect()
    assert [r["path"] for r in padded if r["path"][1:2] != [] and r["path"][1].isdigit()] == [p for p in order if p in small and p[1:2] != [] and p[1].isdigit()]
    frame.withColumn("key", P.order_key(F.col("path"), depth_first=False)).orderBy("key").write.parquet(str(tmp_path / "paths"))
    low, high = (frame.limit(1).select(P.order_key(F.array(F.lit("r"), F.lit(n)), depth_first=False)).first()[0] for n in ("99", "1000000000"))
    found = spark.read.parquet(str(tmp_path / "paths")).where((F.col("key") >= low) & (F.col("key") < high))
    assert {tuple(r["path"]) for r in found.collect()} == {("r", str(n), "x") for n in (99, 100, 99_999_999, 100_000_000, 10**9 - 1)}
    assert "GreaterThanOrEqual(key" in found._jdf.queryExecution().executedPlan().toString()


def test_id_batches(spark):
    ids = [("p", str(i)) for i in range(103)] + [("q", "x"), ("q", "x"), ("q", None), (None, "y")]
    asked = pack_ids(spark.createDataFrame(ids, "provider_name string, id string"), 10).collect()
    sizes = {p: sorted(r["records_per_page"] for r in asked if r["provider_name"] == p) for p in ("p", "q")}
    assert sizes == {"p": [3] + [10] * 10, "q": [1]} and all(r["query"].split(",") == r["ids"] and len(r["ids"]) == r["records_per_page"] for r in asked)
    assert sorted((r["provider_name"], i) for r in asked for i in r["ids"]) == sorted({x for x in ids if None not in x})
    content = '{"items": [{"id": "3", "v": "three"}, {"v": "second"}, {"id": "foreign", "v": "last"}]}'
    pages = spark.createDataFrame([("p", "s", "1,2,3,4", "processed", content, "application/json"), ("p", "t", "5", "error", None, None)], "provider_name string, search string, query string, status string, content string, content_type string")
    got = {r["id"]: r["v"] for r in unpack_records(pages, "items", "id").select("id", F.get_json_object("record", "$.v").alias("v")).collect()}
    assert got == {"1": None, "2": "second", "3": "three", "4": None}


def failing_connect(url):
    """A connection whose staging of the key "bad" fails."""
    connection = sqlite3.connect(url, timeout=60)

    class Cursor(sqlite3.Cursor):
        def executemany(self, sql, rows):
            if any(r[0] == "bad" for r in rows):
                raise OSError("disk on fire")
            return super().executemany(sql, rows)

    class Wrapped:
        def __getattr__(self, name):
            return getattr(connection, name)

        def cursor(self):
            return connection.cursor(Cursor)

    return Wrapped()


def test_sql_store(spark, tmp_path):
    url = str(tmp_path / "store.db")
    store = open_store("sqlite", spark, url=url, namespace="ns", ttl=3600)
    put = lambda s, *rows: s.update(spark.createDataFrame(rows, "key string, cache string").repartition(3))
    everything = lambda s: sorted((r["key"], r["cache"]) for r in s.retrieve_all().collect())
    assert everything(store) == []
    put(store, *((f"k{i}", "1") for i in range(50)))
    database = sqlite3.connect(url)
    before = dict(database.execute("SELECT key, rowid FROM cache").fetchall())
    put(store, ("k7", "2"), ("k7", "3"), ("ns:new", "1"))
    after = dict(database.execute("SELECT key, rowid FROM cache").fetchall())
    assert {k for k in after if before.get(k) != after[k]} == {"ns:k7", "ns:new"}  # other rows aren't touched
    assert dict(everything(store))["ns:k7"] == "3" and len(after) == 51
    assert store.verify("k7") and not store.verify("zz") and [r["cache"] for r in store.retrieve("k1", "new").collect()] == ["1", "1"]
    store.delete("k7", "nothing")
    assert not store.verify("k7") and len(everything(store)) == 50
    other = open_store("sql", spark, url=url, namespace="other")
    put(other, ("a", "1"))
    store.delete_all()
    assert everything(store) == [] and everything(other) == [("other:a", "1")]
    assert [t for (t,) in database.execute("SELECT name FROM sqlite_master WHERE type = 'table'")] == ["cache"]
    with pytest.raises(ValueError):
        store.retrieve("")


def test_a_failed_task_leaves_the_sql_store_as_it_was(spark, tmp_path):
    url = str(tmp_path / "store.db")
    store = open_store("sql", spark, url=url)
    store.update(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, cache string"))
    broken = open_store("sql", spark, url=url, connect="tests.test_distributed:failing_connect")
    with pytest.raises(Exception, match="on fire"):
        broken.update(spark.createDataFrame([("a", "2"), ("bad", "2"), ("c", "2")], "key string, cache string").repartition(3))
    assert sorted((r["key"], r["cache"]) for r in store.retrieve_all().collect()) == [("a", "1"), ("b", "1")]
    assert [t for (t,) in sqlite3.connect(url).execute("SELECT name FROM sqlite_master WHERE type = 'table'")] == ["cache"]


def test_sql_store_reads_by_keys_and_ranges(spark, tmp_path):
    store = open_store("sql", spark, url=str(tmp_path / "store.db"))
    store.update(spark.createDataFrame([(f"k{i:03d}", str(i)) for i in range(100)], "key string, cache string"))
    spark.dataSource.register(SqlSource)
    read = spark.read.format("folio_sql").options(**store.options, partitions="4").load()
    assert read.rdd.getNumPartitions() == 4 and read.count() == 100 and read.agg(F.count_distinct("key")).first()[0] == 100
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    few = read.where("key IN ('k001', 'k050', 'none')")
    assert few.rdd.getNumPartitions() == 1 and sorted(r["cache"] for r in few.collect()) == ["1", "50"]
    with pytest.raises(Exception, match="upserts"):
        read.write.format("folio_sql").options(**store.options).mode("overwrite").save()
