"""Logged attempts of requests under a retry policy: how each request ended, and which are to be sent again when."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.sources.retries import RetryPolicy


def settled(
    attempts: DataFrame, by: Iterable[str], policy: RetryPolicy = RetryPolicy(), valid: Column | None = None, *,
    attempt: str = "attempt", status: str = "status_code", headers: str = "headers", at: str = "at",
) -> DataFrame:
    """One row per request: ``by``, attempts, outcome, status_code, waited and next_wait (seconds).

    ``valid`` is the validator of an answer (status 200 by default); null counts as not valid. The outcome is *valid*,
    *refused* (not worth a retry), *exhausted*, or *open*: the next attempt isn't logged yet and is due ``next_wait`` after the
    last. Attempts after the one that ended a request, and those numbered beyond the policy, count for nothing.
    Of several rows of one attempt the smallest answer counts: valid ones first, then by status. Null keys are a request of their own.

    A policy allows ``retries`` + 1 attempts, so a request is that number of aggregates, which combine before the
    shuffle; no request's log is gathered or sorted, however often a client has repeated it.
    """
    by = list(by)
    ok = F.coalesce(valid if valid is not None else F.col(status) == 200, F.lit(False))
    ends = ok | ~policy.retryable(F.col(status))
    answer = F.struct((~ok).alias("bad"), F.col(status).cast("int").alias("code"), ends.alias("ends"), policy.wait(F.col(attempt), F.col(headers), F.col(at)).alias("wait"))
    slots = [F.min(F.when(F.col(attempt) == k, answer)).alias(f"_{k}") for k in range(1, policy.retries + 2)]
    sent = attempts.groupBy(*by).agg(*slots).select(*by, F.array(*(f"_{k}" for k in range(1, policy.retries + 2))).alias("_sent"))
    stop = F.array_position(F.transform("_sent", lambda s: s.isNull() | s["ends"]), F.lit(True)).cast("int")
    found = sent.withColumn("_stop", stop).withColumn("_open", (F.col("_stop") > 0) & F.get("_sent", F.col("_stop") - 1).isNull())
    number = F.when(F.col("_stop") == 0, policy.retries + 1).when(F.col("_open"), F.col("_stop") - 1).otherwise(F.col("_stop"))
    found = found.withColumn("attempts", number).withColumn("_last", F.get("_sent", F.col("attempts") - 1))
    outcome = F.when(F.col("_stop") == 0, "exhausted").when(F.col("_open"), "open").when(F.col("_last.bad"), "refused").otherwise("valid")
    before = F.slice("_sent", F.lit(1), F.greatest(F.col("attempts") - 1, F.lit(0)))
    waited = F.aggregate(before, F.lit(0.0), lambda total, s: total + s["wait"])
    next_wait = F.when(F.col("_open"), F.coalesce("_last.wait", F.lit(0.0)))
    return found.select(*by, "attempts", outcome.alias("outcome"), F.col("_last.code").alias("status_code"), waited.alias("waited"), next_wait.alias("next_wait"))


def due(attempts: DataFrame, by: Iterable[str], policy: RetryPolicy = RetryPolicy(), valid: Column | None = None, **columns: str) -> DataFrame:
    """Requests that are to be sent again: ``by``, the number of the next attempt and the wait before it."""
    rows = settled(attempts, by, policy, valid, **columns).where("outcome = 'open'")
    return rows.select(*by, (F.col("attempts") + 1).alias("attempt"), F.col("next_wait").alias("wait"))
