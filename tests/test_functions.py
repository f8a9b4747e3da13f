"""Paths, scalars, JSON access and masks on small fixtures."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from foliospark.functions import paths as P
from foliospark.functions import scalars as S
from foliospark.functions.jsonpath import extract_key, path_values, split_key
from foliospark.functions.security import DEFAULT_MASKS, FuzzyKeyMask, KeyMask, StringMask, mask_text


def one(spark, column, **values):
    frame = spark.createDataFrame([(1,)], "x int").select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("out")).first()[0]


@pytest.mark.parametrize(
    "column, path, expected",
    [
        (P.depth, ["a", "b"], 2),
        (P.depth, [""], 0),
        (P.name, ["a", "0", "b", "1"], "b"),
        (P.name, ["0", "1"], "0.1"),
        (P.name, [], ""),
        (P.group, ["0", "a", "1"], ["i", "a"]),
        (P.group, ["0", "a"], ["i", "a"]),
        (P.group, [], None),
        (P.remove_indices, ["0", "a", "1"], ["a"]),
        (P.replace_indices, ["0", "a"], ["i", "a"]),
        (P.ancestors, ["a", "b", "c"], [["a"], ["a", "b"]]),
        (P.ancestors, ["a"], []),
        (P.parent, ["a", "b"], ["a"]),
        (P.parent, ["a"], []),
        (lambda p: P.last_parts(p, 2), ["a"], ["a"]),
        (lambda p: P.last_parts(p, 2), ["a", "b", "c"], ["b", "c"]),
        (lambda p: P.starts_with(p, F.array(F.lit("a"))), ["a", "b"], True),
        (lambda p: P.is_ancestor_of(F.array(F.lit("a")), p), ["a"], False),
        (lambda p: P.has_ancestor(p, F.array(F.lit("a"))), ["a", "b"], True),
        (lambda p: P.replace(p, "a", "z"), ["a", "b", "a"], ["z", "b", "z"]),
        (lambda p: P.replace_prefix(p, F.array(F.lit("a")), F.array(F.lit("x"), F.lit("y"))), ["a", "b"], ["x", "y", "b"]),
        (lambda p: P.replace_prefix(p, F.array(F.lit("q")), F.array(F.lit("x"))), ["a", "b"], ["a", "b"]),
        (P.sort_key, ["a", "2"], "2.a.00000002"),
        (P.info_content, ["0", "a", "value", "i"], 1),
        (lambda p: P.concat(p, F.array(F.lit(""))), ["a"], ["a"]),
        (P.record_index, ["3", "a"], 3),
        (P.record_index, ["x"], None),
        (lambda p: P.append(p, F.lit(1)), ["a"], ["a", "1"]),
    ],
)
def test_paths(spark, column, path, expected):
    assert one(spark, column(F.col("p")), p=path) == expected


def test_delimiters(spark):
    assert one(spark, P.split_path(F.lit("a<>b.c"), "<>")) == ["a", "b.c"]
    assert one(spark, P.infer_delimiter(F.lit("a//b.c"))) == "//"
    assert one(spark, P.infer_delimiter(F.lit("ab"))) is None
    for bad in ("", " ", "ab"):
        with pytest.raises(ValueError):
            P.check_delimiter(bad)


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: S.coerce_int(F.lit(" 12 ")), 12),
        (lambda: S.coerce_int(F.lit("2.0")), None),
        (lambda: S.coerce_int(F.lit(None).cast("string")), None),
        (lambda: S.try_int(F.lit("x1")), "x1"),
        (lambda: S.start_index(F.lit(3), F.lit(25)), 51),
        (lambda: S.start_index(F.lit(3), F.lit(25), zero_indexed=True), 50),
        (lambda: S.start_index(F.lit(3), F.lit(25), auto_calculate=False), 3),
        (lambda: S.start_index(F.lit(0), F.lit(25)), None),
        (lambda: S.pages_remaining(F.lit(1), F.lit(101), F.lit(25)), 4),
        (lambda: S.pages_remaining(F.lit(9), F.lit(101), F.lit(25)), 0),
        (lambda: S.pages_remaining(F.lit(9), F.lit(None).cast("int"), F.lit(25)), None),
        (lambda: S.page_list(F.array(F.lit("3"), F.lit("1"), F.lit("3"))), [1, 3]),
        (lambda: S.normalize_url(F.lit("http://www.a.org/x/")), "https://a.org/x"),
        (lambda: S.normalize_url(F.lit("a.org/x?q=1"), keep_parameters=False), "https://a.org/x"),
        (lambda: S.url_basename(F.lit("https://api.example.ac.uk/x")), "example"),
        (lambda: S.url_basename(F.lit("https://localhost/x")), None),
        (lambda: S.valid_email(F.lit("a.b%40c.org")), True),
        (lambda: S.valid_email(F.lit("a.b")), False),
        (lambda: S.collapse(F.array(F.lit("a"), F.lit(None).cast("string"))), "a; None"),
        (lambda: S.collapse(F.array(F.lit("a"))), "a"),
        (lambda: S.collapse(F.expr("cast(array() as array<string>)")), None),
        (lambda: S.join_elements(F.expr("cast(array() as array<string>)"), ";"), ""),
        (lambda: S.retry_after_seconds(F.lit("7"), F.lit(datetime(2024, 1, 1, tzinfo=UTC))), 7),
        (lambda: S.retry_after_seconds(F.lit("2024-01-01T00:00:05Z"), F.lit(datetime(2024, 1, 1, tzinfo=UTC))), 5),
        (lambda: S.retry_after_seconds(F.lit("Mon, 01 Jan 2024 00:00:09 GMT"), F.lit(datetime(2024, 1, 1, tzinfo=UTC))), 9),
        (lambda: S.retry_after_seconds(F.lit("2023-01-01T00:00:05Z"), F.lit(datetime(2024, 1, 1, tzinfo=UTC))), 0),
        (lambda: S.decode_bytes(F.lit("<hashbytes>YWI=")).cast("string"), "ab"),
        (lambda: S.decode_bytes(F.lit("YWI=")), None),
        (lambda: S.is_base64(F.lit("YWI")), False),
        (lambda: S.non_readable(F.lit(bytearray(b"\x00\x01ab"))), True),
        (lambda: S.non_readable(F.lit(bytearray(b"abcd"))), False),
        (lambda: S.truncated(F.lit("abcdefgh"), 6), "abc..."),
        (lambda: S.first_key(F.create_map(F.lit("A"), F.lit(1)), "b", "a", any_case=True), 1),
        (lambda: S.normalize_name(F.lit(" Springer_Nature ")), "springernature"),
        (lambda: S.namespaced(F.lit("ns:k"), "ns"), "ns:k"),
    ],
)
def test_scalars(spark, column, expected):
    assert one(spark, column()) == expected


def test_cache_keys_differ_by_parameters(spark):
    args = F.lit("P"), F.lit("q"), F.lit(1), F.lit(25)
    keys = {one(spark, S.search_cache_key(*args, F.create_map(F.lit("sort"), F.lit(v)))) for v in "ab"}
    assert len(keys) == 2
    assert one(spark, S.search_cache_key(*args)) == "p_q_1_25"


RECORD = '{"a": {"b": [{"c": 1}, {"c": [2, 3]}, {"d": 0}]}, "x.y": "flat", "e": null, "z": "", "t": "[no list"}'


@pytest.mark.parametrize("path, expected", [("a.b.c", ["1", "2", "3"]), (["a", "b", 0, "c"], ["1"]), ("e", []), ("q.r", []), ("z", [""]), ("t", ["[no list"])])
def test_path_values(spark, path, expected):
    assert one(spark, path_values(F.lit(RECORD), path)) == expected


def test_extract_key_prefers_the_flat_key(spark):
    assert one(spark, extract_key(F.lit(RECORD), "x.y")) == ["flat"]
    assert one(spark, path_values(F.lit("not json"), "a")) == []
    with pytest.raises(TypeError):
        split_key(3)


def test_masks(spark):
    text = 'api_key=abc123 password: "s3cret" mail a.b@c.org Authorization: Bearer tok.en $1'
    masked = one(spark, mask_text(F.lit(text), DEFAULT_MASKS))
    for gone in ("abc123", "s3cret", "a.b@c.org", "tok.en"):
        assert gone not in masked
    assert one(spark, StringMask("a.b").apply(F.lit("a.b axb"))) == "*** axb"
    assert one(spark, KeyMask("Key").apply(F.lit("KEY='v' key"))) == "KEY='***' key"
    assert one(spark, FuzzyKeyMask(("k", "key")).apply(F.lit("key=v"))) == "key=***"
