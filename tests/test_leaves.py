"""Leaves, prefixes and order of one record's paths in place, against plain Python, and searches that send nothing in many queues."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import paths as P
from foliospark.operators import records as R
from foliospark.operators import trie
from foliospark.plans import queries as library
from foliospark.plans.queries import QUERIES
from foliospark.sources.providers import Registry
from foliospark.sources.requests import endpoint, fetch_pages

DATA = "/root/testdata/sf0.001"


def random_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 6:
        return [1, "téxt", None, True, 2.5, {}][kind]
    if kind == 6:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "1", "", "value"]): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    return [None, "no json", "null", "{}", "[]", "5", '{"a": [[1, 1], {"1": 1}], "1": {}}', *(json.dumps(random_value(rng)) for _ in range(200))]


def plain_leaves(text, depth=99):
    value = R._loaded(text)
    found = [] if value is None else list(R.leaves(value))
    return [([str(p) for p in path], [isinstance(p, int) for p in path], i, R._text(v), type(v).__name__) for i, (path, v) in enumerate(found) if len(path) <= depth]


def test_leaves(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, record string").repartition(3)
    for depth in (99, 1):
        got = {}
        for r in R.nodes(frame, keep=["id"], max_depth=None if depth == 99 else depth).collect():
            got.setdefault(r["id"], []).append(tuple(r)[1:])
        assert got == {i: own for i, t in enumerate(texts) if (own := plain_leaves(t, depth))}


def test_distinct_leaves_in_place(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, record string")
    rows = lambda f: sorted(map(str, f.select("id", "path", "ord", "value").collect()))
    in_place = frame.select("id", F.explode(R.distinct_leaf_list(F.col("record"))).alias("n")).select("id", "n.*")
    assert rows(in_place) == rows(R.distinct_leaves(R.nodes(frame, keep=["id"]), ["id"]))


def test_deepest_and_order_in_place(spark):
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "1", "12", "007", "item9", "item10", "", "1234567890123"])
    records = [[[part() for _ in range(rng.randrange(4))] for _ in range(rng.randrange(9))] for _ in range(300)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate([*records, None])], "id int, paths array<array<string>>")
    paths = F.col("paths")
    keyed = F.transform(paths, lambda p: F.struct(P.order_key(p).alias("k"), p.alias("p")))
    for r in frame.select("id", R.deepest(paths).alias("deepest"), trie.natural_order(paths).alias("ordered"), keyed.alias("keyed")).collect():
        own = records[r["id"]] if r["id"] < len(records) else []
        assert [tuple(p) for p in r["deepest"] or []] == [tuple(p) for p in own if not p or not any(q[: len(p)] == p and len(q) > len(p) for q in own)]
        keys = {tuple(x["p"]): x["k"].encode() for x in r["keyed"] or []}
        assert [keys[tuple(p)] for p in r["ordered"] or []] == sorted(keys[tuple(p)] for p in own)
    rows = frame.select("id", F.explode("paths").alias("path")).withColumn("n", F.monotonically_increasing_id())
    got = sorted((r["id"], tuple(r["path"])) for r in R.deepest_only(rows, ["id"]).collect())
    assert got == sorted((i, tuple(p)) for i, own in enumerate(records) for p in own if not p or not any(q[: len(p)] == p and len(q) > len(p) for q in own))


@pytest.mark.parametrize("name, most", [("deepest_paths", 0), ("path_order", 0), ("distinct_path_data", 0), ("record_conflicts", 1)])
def test_leaves_are_not_shuffled(spark, name, most):
    """Beyond the exchanges of the records themselves and of the paths that are added."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
        own = plan(library.orders_json(spark, DATA)).count("Exchange hashpartitioning")
        assert plan(QUERIES[name](spark, DATA)).count("Exchange hashpartitioning") <= own + most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_order_records_are_made_in_more_tasks_than_the_file_gives(spark):
    assert "BroadcastHashJoin [o_orderkey" not in library.orders_json(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_cached_searches_of_a_provider_are_dealt(spark):
    known = [endpoint(Registry().get(p), "total", "items", 0.0) for p in ("crossref", "plos")]
    asked = spark.createDataFrame([(p, f"q{k}", f"q{k}", n, 2) for p in ("crossref", "plos") for k in range(60) for n in (1, 2, 3)], "provider_name string, search string, query string, page int, records_per_page int")
    body = '{"total": 3, "items": [1, 2]}'
    status = F.when((F.col("provider_name") == "plos") & (F.col("query") == "q30"), 404).when((F.col("provider_name") == "crossref") & (F.col("page") == 3), 503).otherwise(200)
    cache = asked.select("provider_name", "query", "page", "records_per_page", status.alias("status_code"), F.lit("application/json").alias("content_type"), F.lit(body).alias("content"), F.lit(None).cast("timestamp").alias("expire_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fetch_pages(asked, known, cache=cache).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    crossref = [r for r in got if r["provider_name"] == "crossref"]
    assert sorted((r["query"], r["page"]) for r in crossref) == sorted((f"q{k}", n) for k in range(60) for n in (1, 2)) and len({r["task"] for r in crossref}) > 1
    plos = [(r["query"], r["page"], r["status_code"]) for r in got if r["provider_name"] == "plos"]
    before = sorted(f"q{k}" for k in range(60) if f"q{k}" < "q30")
    assert sorted(plos) == sorted([(q, n, 200) for q in before for n in (1, 2)] + [("q30", 1, 404)])  # an answer that ends the provider ends all that come after


def test_records_by_provider_are_dealt(spark):
    for name in ("normalise_by_url", "normalise_by_name"):
        assert QUERIES[name](spark, DATA).rdd.getNumPartitions() > 4


def test_patterns_search_a_path_once_for_a_batch():
    class Counted:
        searched = 0

        def search(self, path):
            self.searched += 1
            return re.search(r"^lines\.1\.", path)

    pattern = Counted()
    kinds, read = R._leaf_reader({"keep": pattern})
    texts = [json.dumps({"id": i, "lines": [{"n": k} for k in range(i % 3)]}) for i in range(300)]
    got = [read(t) for t in texts]
    assert [bool(numbers) for _, numbers, _ in got] == [i % 3 == 2 for i in range(300)]
    assert got[2][2] == ["2", "0", "1"] and pattern.searched == len(kinds) == 4


@pytest.mark.parametrize("most", [100_000, 1])
def test_path_rows_by_patterns_of_odd_records(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MAX_GROUPS", most)
    texts = [None, "{", "5", '"a"', "{}", "[]", "0", '{"a": {"b": null}}', '{"a": {"b": [1, {}, null, "x"]}, "c": []}', '{"c": {"b": 1.5}}', '{"a": 1, "c": true}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, record string")
    rows = lambda **how: {r["id"]: r["fields"] for r in R.path_rows(frame, keep=["id"], **how).collect()}
    assert set(rows(keep_pattern=r"^a\.b")) == {7, 8}
    assert set(rows(ignore_pattern=r"^c$")) == {0, 1, 4, 5, 7, 9}
    assert set(rows(keep_pattern="a", ignore_pattern="a.b", regex=False)) == {10}
    found = rows(keep_pattern="^a")
    assert found[7] == {"b": None} and found[8] == {"b": "1; {}; None; x", "c": "[]"} and found[10] == {"a": "1", "c": "True"}
