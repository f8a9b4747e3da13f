"""Operator 11: sizes, places, balance, versions of the map and hot slots, against plain counts."""

import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.llm import queries, sharding
from foliospark.llm.sharding import SlotMap, shard_documents, virtual_slot


def size(text):
    return len((text or "").encode()) + 16


def check(rows, got, shards):
    """Every document once, with its size and CRC; places gapless in each shard. Returns the bytes by shard."""
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places, load = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r["shard"] < shards
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return load


def texts(n):
    return [(i, "größe " * (i * 7919 % 97)) for i in range(n)]


def test_balance_and_places(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    rows = [*texts(1500), (1500, None), (1501, ""), (-3, "x"), (None, "no id"), (None, "no id"), (2, "again"), (2, "again")]
    frame = docs(rows).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1.5)).repartition(5)
    load = check(rows, shard_documents(frame, 10).collect(), 10)
    mean = sum(load.values()) / 10
    assert len(load) == 10 and max(load.values()) - min(load.values()) < 0.02 * mean


def test_hot_id_and_rows_without_id_spread(spark, docs):
    rows = [*texts(300), *((7, "hot " * 40) for _ in range(400)), *((None, "none " * 40) for _ in range(300))]
    load = check(rows, shard_documents(docs(rows).repartition(6), 8, slots=64).collect(), 8)
    mean = sum(load.values()) / 8
    assert max(load.values()) < 1.1 * mean and min(load.values()) > 0.9 * mean


def test_one_text_longer_than_a_share(docs):
    rows = [(0, "x" * 1_000_000), *texts(200)]
    load = check(rows, shard_documents(docs(rows), 5).collect(), 5)
    rest = sorted(load.values())[:-1]
    assert max(load.values()) == 1_000_016 and max(rest) < 1.1 * min(rest)


def test_empty(docs):
    assert shard_documents(docs([]), 4).collect() == []


def test_equal_ids_share_a_slot_whatever_the_shards(spark, docs):
    rows = texts(200)
    few, many = (dict((r["doc_id"], r["virtual_slot"]) for r in shard_documents(docs(rows), n).collect()) for n in (3, 11))
    own = {r["doc_id"]: r["s"] for r in docs(rows).select("doc_id", virtual_slot("doc_id").alias("s")).collect()}
    assert few == many == own


def map_of(slot_map, version=None):
    rows = slot_map.at(version).collect()
    assert len({(r["virtual_slot"], r["part"]) for r in rows}) == len(rows)
    for slot, parts in Counter(r["virtual_slot"] for r in rows).items():
        assert {r["parts"] for r in rows if r["virtual_slot"] == slot} == {parts}
    return {(r["virtual_slot"], r["part"]): r["shard"] for r in rows}


def loads(spark, found, bytes_of):
    out = Counter()
    for (slot, _), shard in found.items():
        out[shard] += bytes_of.get(slot, 0)
    return out


def test_versions(spark, tmp_path):
    """Growing, shrinking and repeating edits: old versions stay readable, moves stay near the least that is needed."""
    bytes_of = {s: 1000 + s * 37 % 101 for s in range(200)}
    rows = spark.createDataFrame([(s, (f"f{s % 4}", s), b) for s, b in bytes_of.items()], "virtual_slot int, address struct<file string, row long>, size long")
    slots = SlotMap.create(spark, str(tmp_path / "map"), 8, 256)
    seen = {1: map_of(slots)}
    assert seen[1] == {(s, 0): s % 8 for s in range(256)}
    for version, shards in ((2, 8), (3, 9), (3, 9), (4, 6)):
        slots.rebalance(rows, shards)
        assert slots.version() == version
        seen[version] = map_of(slots)
        load = loads(spark, seen[version], bytes_of)
        assert set(seen[version].values()) <= set(range(shards)) and len(seen[version]) == 256
        assert max(load.values()) - min(load.values()) < 1300
    moved = [k for k in seen[3] if seen[3][k] != seen[2][k]]
    assert sum(seen[3][k] == 8 for k in moved) >= 0.8 * len(moved) and sum(bytes_of.get(s, 0) for s, _ in moved) < 1.4 * sum(bytes_of.values()) / 9
    assert all(map_of(slots, v) == m for v, m in seen.items())
    with pytest.raises(Exception, match="already exists"):
        slots._write(slots.at().limit(1), 4)


def test_a_kept_map_is_edited(docs, tmp_path):
    path = str(tmp_path / "map")
    first = {r["doc_id"]: r for r in shard_documents(docs(texts(600)), 6, map_path=path).collect()}
    again = {r["doc_id"]: r for r in shard_documents(docs(texts(600)), 7, map_path=path).collect()}
    assert {r["map_version"] for r in first.values()} == {2} and {r["map_version"] for r in again.values()} == {3}
    moved = sum(r["size"] for i, r in again.items() if r["shard"] != first[i]["shard"])
    assert moved < 2 * sum(r["size"] for r in again.values()) / 7


def test_query_is_native(spark, tmp_path):
    pd.DataFrame(texts(900), columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    found = queries.op11_sharding(spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    got = found.collect()
    load = check(texts(900), got, 40)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)} and max(load.values()) - min(load.values()) < 600
    assert found.dtypes[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
