"""Retries, attempts, metadata maps, accessors and logs against plain versions."""

import json
import logging
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from foliospark.logs import set_up_logging, writable_folder
from foliospark.operators import responses
from foliospark.operators.attempts import due, settled
from foliospark.operators.metadata import MetadataMap, by_provider
from foliospark.sources.pages import Harvest, Limiter
from foliospark.sources.providers import Registry
from foliospark.sources.retries import InvalidAnswer, RetryPolicy, asked_wait

LOG = "request string, attempt int, status_code int, headers map<string,string>, at timestamp"
NOW = datetime(2024, 1, 1, tzinfo=UTC)


def test_waits_double_up_to_the_longest():
    slept, policy = [], RetryPolicy(retries=5, factor=1, longest=6)
    assert policy.run(lambda: (503, {}, ""), slept.append)[0] == 503
    assert slept == [2, 4, 6, 6, 6]
    assert RetryPolicy(retries=-1).run(lambda: (503, {}, ""), pytest.fail)[0] == 503


def test_wait_headers():
    assert asked_wait({"X-RateLimit-Retry-After": "4"}) == 4
    assert asked_wait({"x-ratelimit-retry-after": "4", "RETRY-AFTER": "9"}) == 9
    assert asked_wait({"Retry-After": None}) is None and asked_wait({"Retry-After": "soon"}) is None and asked_wait({}) is None
    assert asked_wait({"Retry-After": "-3"}) == 0
    assert asked_wait({"Retry-After": "Mon, 01 Jan 2024 00:00:05 GMT"}, NOW) == 5


@pytest.mark.parametrize(("answers", "said"), [([(404, {}, "a")], "not worth"), ([(503, {}, "b")] * 4, "ran out")])
def test_a_strict_policy_raises(answers, said):
    left = list(answers)
    with pytest.raises(InvalidAnswer, match=said) as raised:
        RetryPolicy(strict=True).run(lambda: left.pop(0), lambda s: None)
    assert raised.value.answer == answers[-1] and not left


def test_a_scan_takes_a_policy_of_its_own():
    from foliospark.sources.pages import Search

    sent = []

    def transport(url, params):
        sent.append(url)
        return 418, {}, ""

    search = Search("p", "https://x", "q", "start", "rows", ["a"], [1], 5, delay=0.0)
    row = Harvest(transport, Limiter(0, sleep=lambda s: None), lambda s: None, policy=RetryPolicy(retries=2, statuses=(418,))).fetch(search, "a", 1)
    assert row[3] == "error" and len(sent) == 3


def _plain(log, policy):
    """Each request's log replayed through the loop itself; an attempt that isn't logged stops it."""

    class Missing(Exception):
        pass

    found = {}
    for request in {r[0] for r in log}:
        rows, number, slept = {}, [0], []
        for r in log:
            if r[0] == request:
                rows.setdefault(r[1], []).append(r)

        def send():
            if number[0] + 1 not in rows:
                raise Missing
            number[0] += 1
            best = min(rows[number[0]], key=lambda r: (r[2] != 200, -1 if r[2] is None else r[2]))
            return best[2], {k: v for k, v in (best[3] or {}).items()}, ""

        last, seen = [None], []

        def sent():
            last[0] = send()
            seen.append(last[0])
            return last[0]

        try:
            code, _, _ = policy.run(sent, slept.append, lambda s, h, b: s == 200)
            outcome = "valid" if code == 200 else "exhausted" if code in policy.statuses else "refused"
            found[request] = (number[0], outcome, code, sum(slept), None)
        except Missing:
            found[request] = (number[0], "open", last[0][0] if last[0] else None, sum(slept[:-1]), slept[-1] if slept else 0.0)
    return found


def test_attempts_against_the_loop(spark):
    dice, log = random.Random(3), []
    for i in range(300):
        for k in range(1, dice.randint(2, 8)):
            if dice.random() < 0.9:
                headers = dice.choice([None, {}, {"Retry-After": "7"}, {"x-ratelimit-retry-after": "2", "other": "x"}, {"retry-after": "soon"}])
                row = (f"r{i}", k, dice.choice([200, 429, 503, 503, 503, 404, None]), headers, NOW)
                log += [row] * dice.choice([1, 1, 3])
    policy = RetryPolicy(retries=3, factor=0.5, longest=3)
    frame = spark.createDataFrame(log, LOG).repartition(7)
    got = {r[0]: tuple(r)[1:] for r in settled(frame, ["request"], policy).collect()}
    assert got == _plain(log, policy)
    assert {v[1] for v in got.values()} == {"valid", "refused", "exhausted", "open"}
    assert {(r[0], r[1], r[2]) for r in due(frame, ["request"], policy).collect()} == {(k, v[0] + 1, v[4]) for k, v in got.items() if v[1] == "open"}


def test_attempts_at_the_edges(spark):
    log = [(None, 1, 200, None, NOW), ("late", 9, 200, None, NOW), ("twice", 1, 503, {"Retry-After": "1"}, NOW), ("twice", 1, 200, None, NOW), ("none", 1, None, None, None)]
    frame = spark.createDataFrame(log, LOG).withColumn("outcome_of", F.lit("clash"))
    got = {r[0]: tuple(r)[1:] for r in settled(frame, ["request"]).collect()}
    assert got == {None: (1, "valid", 200, 0.0, None), "late": (0, "open", None, 0.0, 0.0), "twice": (1, "valid", 200, 0.0, None), "none": (1, "refused", None, 0.0, None)}
    assert settled(frame.limit(0), ["request"]).collect() == []
    assert settled(frame, ["request"], valid=F.lit(False), policy=RetryPolicy(statuses=())).where("outcome = 'valid'").count() == 0


def test_no_window_over_a_request(spark):
    frame = spark.createDataFrame([], LOG)
    plan = settled(frame, ["request"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan and "Python" not in plan


@pytest.mark.parametrize(
    ("metadata", "expected"),
    [
        ({"a.b": 3, "a": {"b": 4}, "n": "7"}, (3, 7)),
        ({"a.b": None, "a": {"b": 4}, "n": 7.5}, (None, None)),  # the whole key is there, so it counts
        ({"a": {"b": "12"}, "n": [1]}, (12, None)),
        ({"a": "text", "n": {"x": 1}}, (None, None)),
        ({}, (None, None)),
        (None, (None, None)),
    ],
)
def test_metadata_keys(spark, metadata, expected):
    text = None if metadata is None else json.dumps(metadata)
    keyed = None if metadata is None else {k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in metadata.items()}
    frame = spark.createDataFrame([(text, keyed)], "m string, k map<string,string>")
    keys = MetadataMap("a.b", "n")
    row = frame.select(keys.processed(F.col("m")).alias("m"), keys.processed(F.col("k"), keyed=True).alias("k")).first()
    assert tuple(row.m) == expected and tuple(row.k) == expected


def test_pages_left(spark):
    keys = MetadataMap("t", "s")
    frame = spark.createDataFrame([('{"t": "1500", "s": "20"}', 74), ('{"t": 5, "s": 0}', 1), ('{"t": 5}', 1), (None, 1)], "m string, page int")
    assert [r[0] for r in frame.select(keys.pages_left(F.col("page"), F.col("m"))).collect()] == [1, None, None, None]
    assert [r[0] for r in frame.select(keys.pages_left(F.col("page"), F.col("m"), F.lit(0), F.lit(2))).collect()] == [676, 2, 2, None]
    assert frame.select(MetadataMap().processed(F.col("m")).alias("p")).first().p[0] is None


def test_metadata_of_unknown_providers(spark):
    frame = spark.createDataFrame([("plos", '{"numFound": 3}'), ("other", '{"numFound": 3}'), (None, None)], "provider_name string, metadata string")
    got = by_provider(frame, list(Registry().providers.values())).select("processed").collect()
    assert [r[0] and r[0][0] for r in got] == [3, None, None]
    assert by_provider(frame, []).where("processed is not null").count() == 0


def test_accessors(spark):
    rows = [("200", None, b"caf\xc3\xa9", "https://a.org"), ("x", "", b"\xff", "a.org"), (None, None, None, None), ("503", "Busy", b"", "http://b.org/x")]
    frame = spark.createDataFrame(rows, "status_code string, reason string, content binary, url string").select("*", F.lit("mine").alias("text"), F.expr("map('a','b')").alias("headers"), F.lit(1).alias("other"))
    got = [(r.status_code, r.reason, r.status, r.text, r.url, r.other) for r in responses.accessors(frame).collect()]
    assert got == [(200, "OK", "OK", "café", "https://a.org", 1), (None, None, None, None, None, 1), (None, None, None, None, None, 1), (503, "Busy", "Busy", "", "http://b.org/x", 1)]


def test_lone_records_and_search_data(spark):
    texts = ['[{"a":1}]', '[{"a":1},2]', '["{}"]', "[[1]]", "[]", '{"a":1}', "broken", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(responses.lone_record(F.col("t"))).collect()] == ['{"a":1}', *texts[1:]]
    pages = spark.createDataFrame([("processed", ["a", "b"]), ("error", ["c"]), (None, ["d"]), ("processed", None), ("processed", [])], "status string, records array<string>")
    assert [r[0] for r in responses.search_data(pages).collect()] == ["a", "b"]
    assert [r[0] for r in pages.select(responses.length_of(F.col("status"), F.col("records"))).collect()] == [2, 0, 0, 0, 0]


def test_pages_are_relabelled_by_their_url(spark):
    pages = spark.createDataFrame([("https://api.plos.org/search?q=x", "given"), ("https://nowhere.org", "given"), (None, None)], "url string, provider_name string")
    assert [r.provider_name for r in Registry().relabelled(pages).collect()] == ["plos", "given", None]


def test_logs(tmp_path):
    (tmp_path / "taken").write_text("a file")
    assert writable_folder([tmp_path / "taken", tmp_path / "free"]) == tmp_path / "free" / "logs"
    with pytest.raises(RuntimeError):
        writable_folder([tmp_path / "taken"])
    assert writable_folder([tmp_path / "taken"], default="x").name == "x"
    logger = logging.getLogger("foliospark.test")
    for _ in range(2):  # the second call replaces the first's handlers
        set_up_logging(logger, tmp_path, "a.log", logging.INFO, propagate=False, max_bytes=400, backups=1)
    assert len(logger.handlers) == 2
    logger.debug("not this")
    for _ in range(9):
        logger.info("api_key=abc123 sent")
    written = (tmp_path / "a.log").read_text() + (tmp_path / "a.log.1").read_text()
    assert "api_key=***" in written and "abc123" not in written and "not this" not in written
    assert len(set_up_logging(logger, file=None).handlers) == 1
