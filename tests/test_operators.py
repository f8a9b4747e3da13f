"""Records, results, caches, scans, parsing, workflows and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import records as R
from foliospark.operators.cache import CacheTable, NullTable, ViewTable, open_store
from foliospark.operators.fieldmap import UNIVERSAL_FIELDS, FieldMap, union_normalised
from foliospark.plans.workflow import Step, Workflow
from tests.catalogue import catalog_get
from foliospark.sources.pages import Limiter, Search, read_pages, scan
from foliospark.sources.retries import RetryPolicy, retry_after
from foliospark.sources.parse import parse_pages, parse_xml
from foliospark.sources.providers import FIELD_MAPS, PROVIDERS, Registry


def records(spark, *values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, record string")


@pytest.mark.parametrize(
    "page, n, metadata",
    [
        ({"total": "3", "data": [{"title": "a"}, {"title": "b"}]}, 2, {"total": "3"}),
        ({"data": [{"my_title": "a"}]}, 1, {}),
        ({"data": [{"x": 1}], "q": 2}, 0, {"x": 1, "q": 2}),
        ({"list": [1, 2], "mixed": [{"a": 1}, 2], "empty": []}, 0, {}),
        ({"facets": {"k": [1]}, "a": {"b": {"red": 1}}}, 0, {"facets": {"k": [1]}, "red": 1}),
        ([{"data": [{"a": 1}, {"b": 2}]}], 2, {}),
        ([{"a": 1}, {"b": 2}], 0, {"a": 1, "b": 2}),
    ],
)
def test_identify(page, n, metadata):
    found, meta = R.identify(page)
    assert (len(found), meta) == (n, metadata)


def test_filters(spark):
    frame = records(spark, {"a": {"b": 1}}, {"c": [{"bb": 1}]}, {})
    ids = lambda f: sorted(r["id"] for r in f.collect())
    assert ids(R.filter_records(frame, keep_keys=["b"])) == [0]
    assert ids(R.filter_records(frame, keep_keys=["b+"])) == [0, 1]
    assert ids(R.filter_records(frame, keep_keys=["b+"], regex=False)) == []
    assert ids(R.filter_records(frame, ignore_keys=["b"], regex=False)) == [1, 2]
    assert ids(R.filter_records(frame, keep_keys=[""])) == []
    assert ids(R.filter_records(frame, ignore_keys=[""])) == [0, 1, 2]


def test_nodes_and_flatten(spark):
    frame = records(spark, {"a": [{"b": 1}, {"b": None}, {"b": "x"}], "e": [], "v": {"value": 2}})
    rows = [(r["path"], r["value"], r["value_type"]) for r in R.nodes(frame, keep=["id"]).orderBy("ord").collect()]
    assert rows == [(["a", "0", "b"], "1", "int"), (["a", "1", "b"], None, "NoneType"), (["a", "2", "b"], "x", "str"), (["e"], "[]", "list"), (["v", "value"], "2", "int")]
    assert R.flatten_records(frame, keep=["id"]).first()["fields"] == {"a.b": "1; x", "e": "[]", "v": "2"}
    assert R.nodes(frame, keep=["id"], max_depth=1).count() == 1


def test_names():
    groups = [["author", "name"], ["colleague", "author", "name"], ["name"], ["i", "name"]]
    names = R.simplified_names(groups)
    assert len(set(names.values())) == len(groups)
    assert names["author", "name"] == "name" and names["colleague", "author", "name"] == "author.name"


def test_path_rows_are_ragged(spark):
    frame = records(spark, {"a": {"n": 1}}, {"b": {"n": None}}, {"a": {"n": 3}, "b": {"n": 4}})
    rows = {r["id"]: r["fields"] for r in R.path_rows(frame, keep=["id"]).collect()}
    assert rows == {0: {"n": "1"}, 1: {"b.n": None}, 2: {"n": "3", "b.n": "4"}}
    kept = R.path_rows(frame, keep=["id"], ignore_pattern=r"^b\.")
    assert [r["id"] for r in kept.collect()] == [0]


def test_key_filter_without_criteria(spark):
    keys = R.discover_keys(records(spark, {"a": {"b": 1}}))
    assert R.filter_keys(keys).count() == 0
    assert R.filter_keys(keys, match="all").count() == 2
    assert [r["key"] for r in R.filter_keys(keys, min_length=2).collect()] == ["b"]
    assert [r["key"] for r in R.filter_keys(keys, min_length=2, include=False).collect()] == ["a"]


def test_field_maps(spark):
    row = {"t": "", "u": [{"n": "x"}, {"n": "y"}], "provider_name": "own"}
    m = FieldMap("given", {"title": ["missing", "t", "u"], "names": "u.n", "other": None}, {}, {"other": "d", "title": "untitled"})
    got = m.normalise(records(spark, row), delimiter="; ").first().asDict()
    assert got == {"provider_name": "own", "title": "untitled", "names": "x; y", "other": "d"}
    listed = FieldMap("given", {"authors": "u.n", "keywords": "k", "subjects": "none", "title": "u.n"}, {}, {"subjects": "all"})
    got = listed.normalise(records(spark, {**row, "k": ["u", "v; w", True, 1.5]})).first().asDict()
    assert got == {"provider_name": "own", "authors": ["x", "y"], "keywords": ["u", "v; w", "True", "1.5"], "subjects": ["all"], "title": '["x","y"]'}
    for name, fields in FIELD_MAPS.items():
        out = fields.normalise(records(spark, {})).columns
        assert out[: len(UNIVERSAL_FIELDS)] == list(UNIVERSAL_FIELDS), name
    assert {p.name for p in PROVIDERS} == set(FIELD_MAPS)
    both = union_normalised([m.normalise(records(spark, row)), FieldMap("b", {"x": "t"}).normalise(records(spark, row))])
    assert both.count() == 2 and "x" in both.columns


def test_registry():
    registry = Registry()
    assert registry.get("Springer_Nature").key_required
    registry.add(PROVIDERS[0].__class__("my_own", "https://x.org", "q", None, "n"))
    assert registry.get("MYOWN").records_per_page == 25


@pytest.mark.parametrize("kind", ["parquet", "memory"])
def test_cache(spark, tmp_path, kind):
    store = CacheTable(spark, str(tmp_path), "ns", ttl=3600) if kind == "parquet" else ViewTable(spark, "ns")
    put = lambda *rows: store.update(spark.createDataFrame(rows, "key string, cache string"))
    put(("a", "1"), ("b", "1"))
    put(("a", "2"), ("ns:c", "3"))
    assert sorted((r["key"], r["cache"]) for r in store.retrieve_all().collect()) == [("ns:a", "2"), ("ns:b", "1"), ("ns:c", "3")]
    assert store.verify("a") and not store.verify("z")
    store.delete("a")
    assert sorted(r["key"] for r in store.keys().collect()) == ["ns:b", "ns:c"]
    store.delete_all()
    assert store.retrieve_all().count() == 0
    with pytest.raises(ValueError):
        store.retrieve("")


def test_other_stores(spark):
    null = open_store("null", spark)
    null.update(spark.createDataFrame([("a", "1")], "key string, cache string"))
    assert not null and isinstance(null, NullTable) and null.retrieve_all().count() == 0
    with pytest.raises(ValueError):
        open_store("unknown", spark)


def _search(**more):
    return Search("p", "https://x", "q", "start", "rows", ["a"], [2, 1, 1, 3, 4], 25, False, True, 1.0, "total", "items", **more)


def test_limiter_waits():
    now, slept = [0.0], []
    limiter = Limiter(2.0, lambda: now[0], slept.append)
    limiter.wait()
    now[0] = 0.5
    limiter.wait()
    assert slept == [1.5]


def test_retries_and_stop():
    answers, slept = [(503, {}, ""), (429, {"Retry-After": "3"}, ""), (200, {}, "{}")], []
    assert RetryPolicy().run(lambda: answers.pop(0), slept.append)[0] == 200
    assert slept == [1.0, 3]  # the first wait is the factor doubled once
    quiet = Limiter(0, sleep=lambda s: None)
    assert [r[2] for r in scan(_search(), catalog_get, quiet)] == [1, 2, 3]
    failed = list(scan(_search(), lambda u, p: (404, {}, "no"), quiet))
    assert [(r[3], r[5]) for r in failed] == [("error", 404)]

    def broken(url, params):
        raise OSError("down")

    lost = list(scan(_search(), broken, quiet))
    assert [(r[3], r[10]) for r in lost] == [("nonresponse", "OSError")]


def test_retry_after_forms():
    from datetime import UTC, datetime

    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert retry_after("5", now) == 5 and retry_after("nonsense", now) is None and retry_after(None, now) is None
    assert retry_after("Mon, 01 Jan 2024 00:00:07 GMT", now) == 7 and retry_after("2023-01-01T00:00:00Z", now) == 0


def test_one_partition_per_provider(spark):
    pages = read_pages(spark, [_search(), _search(), Search("p2", "https://y", "q", "start", "rows", ["b"], [1], 25, False, True, 0.0, "total", "items")], "tests.catalogue:catalog_get")
    assert pages.rdd.getNumPartitions() == 2
    assert pages.groupBy("provider_name").count().orderBy("provider_name").collect()[0]["count"] == 3


def test_parsers(spark):
    assert parse_xml('<a x="1"><b>1</b><b>2</b><c/>t</a>') == {"a": {"@x": "1", "b": ["1", "2"], "c": None, "#text": "t"}}
    assert parse_xml('<a:r xmlns:a="u"><a:i>1</a:i></a:r>') == {"a:r": {"a:i": "1"}}
    rows = [("{}", "application/json"), ("{", "application/json"), ("<a>1</a>", "text/xml"), ("<a", "text/xml"), ("a: [1]", "text/yaml"), ("x", "text/plain"), (None, "text/xml")]
    frame = spark.createDataFrame(rows, "content string, content_type string")
    assert [r["content"] for r in parse_pages(frame).collect()] == ["{}", None, '{"a": "1"}', None, '{"a": [1]}', None, None]
    own = parse_pages(frame.where("content = 'x'"), fmt="own", additional={"own": lambda t: {"t": t}})
    assert own.first()["content"] == '{"t": "x"}'


def test_workflow(spark):
    seen = []

    def step(context):
        seen.append(context["parameters"])
        return spark.range(2) if len(seen) < 3 else None

    flow = Workflow(Step("a", step, parameters={"x": 1}, provider="p"), Step("b", step, parameters={"y": 2}, provider="p"), Step("c", step, provider="q"))
    assert flow.run(spark, z=3) is None
    assert seen == [{"x": 1, "z": 3}, {"x": 1, "y": 2, "z": 3}, {"z": 3}]
    assert [n for n, _ in flow.history] == ["a", "b", "c"]


def test_streams(spark, tmp_path):
    from foliospark.streaming.pages import cache_stream, distinct_pages, normalise_stream, read_landed

    landed = tmp_path / "landed"
    pages = read_pages(spark, [Search("crossref", "https://x", "query", "offset", "rows", ["a"], [1, 2], 25, False, True, 0.0, "total", "items")], "tests.catalogue:catalog_get")
    for _ in range(2):
        pages.write.mode("append").json(str(landed))
    stream = read_landed(spark, str(landed))
    normalise_stream(stream, Registry().maps, {"crossref": "items"}, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    store = CacheTable(spark, str(tmp_path / "cache"))
    cache_stream(stream, store, str(tmp_path / "c2")).awaitTermination()
    assert store.retrieve_all().count() == 2
    query = distinct_pages(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").count() == 2


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "id int, record string")
    assert R.nodes(empty, keep=["id"]).count() == 0
    assert R.flatten_records(empty, keep=["id"]).count() == 0
    assert R.path_rows(empty, keep=["id"]).count() == 0
    assert R.discover_keys(empty).count() == 0
    assert FieldMap("p", {"a": "b"}).normalise(empty).count() == 0
    assert R.filter_records(spark.createDataFrame([(1, None)], "id int, record string"), keep_keys=["a"]).count() == 0
