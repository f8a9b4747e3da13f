"""Plans of dependent steps, and the search plan from pages to normalised records."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.jsonpath import extract_key
from foliospark.operators.fieldmap import FieldMap, normalise_pages
from foliospark.operators.records import explode_records
from foliospark.operators.results import ranked, succeeded
from foliospark.sources.parse import parse_pages


@dataclass
class Step:
    """One stage: a function of the context, with optional hooks before and after."""

    name: str
    run: Callable[[dict], DataFrame]
    before: Callable[[dict], dict] | None = None
    after: Callable[[DataFrame, dict], DataFrame] | None = None
    parameters: Mapping[str, object] = field(default_factory=dict)
    provider: str | None = None


class Workflow:
    """Steps in order; each sees the results so far. A step that returns None stops the run."""

    def __init__(self, *steps: Step) -> None:
        self.steps, self.history = steps, []

    def run(self, spark: SparkSession, **passed: object) -> DataFrame | None:
        self.history, result, previous = [], None, None
        parameters: dict = {}
        for step in self.steps:
            same = previous is None or step.provider in (None, previous)
            parameters = (parameters if same else {}) | dict(step.parameters) | passed
            context = {"spark": spark, "parameters": parameters, "previous": result, "results": dict(self.history)}
            if step.before:
                context = step.before(context)
            result = step.run(context)
            if result is not None and step.after:
                result = step.after(result, context)
            self.history.append((step.name, result))
            previous = step.provider or previous
            if result is None:
                return None
        return result


def hand_off(found: DataFrame, fetched: DataFrame, ids: str = "ids", key: str = "id") -> DataFrame:
    """Fetched records of the ids that a first search found, with that search's page columns."""
    return found.withColumn(key, F.explode(ids)).drop(ids).join(fetched, key)


def pack_ids(ids: DataFrame, size: int, provider: str = "provider_name", key: str = "id") -> DataFrame:
    """Ids to fetch -> requests of at most ``size`` ids: (provider_name, search, query, page, records_per_page, ids), as ``fetch_pages`` takes them.

    Ids are numbered within their provider by ranges of their hashes, so one provider's ids are never in one task; a
    request's query is its ids, comma-joined, and its page size is their number. Null and repeated ids are asked for once or not at all.
    """
    given = ids.select(F.col(provider).alias("provider_name"), F.col(key).cast("string").alias("id")).where(F.col("provider_name").isNotNull() & F.col("id").isNotNull()).distinct()
    numbered = ranked(given.withColumn("_hash", F.xxhash64("id")), "provider_name", "_hash", "_n")
    packed = numbered.groupBy("provider_name", F.floor((F.col("_n") - 1) / size).alias("_request")).agg(F.sort_array(F.collect_list(F.struct("_n", "id"))).alias("_ids"))
    listed = packed.select("provider_name", F.col("_request").cast("string").alias("search"), F.col("_ids.id").alias("ids"))
    return listed.select("provider_name", "search", F.array_join("ids", ",").alias("query"), F.lit(1).alias("page"), F.size("ids").alias("records_per_page"), "ids")


def unpack_records(pages: DataFrame, record_path: str, id_path: str | None = None, keep: tuple[str, ...] = ("provider_name", "search")) -> DataFrame:
    """Answered requests of ``pack_ids`` -> one row for each id asked for, with its record (null if none came).

    A record goes to the id that it names at ``id_path`` if that one was asked for, else to the id at its position.
    """
    parsed = parse_pages(succeeded(pages)).withColumn("ids", F.split("query", ","))
    rows = explode_records(parsed, record_path, keep=[*keep, "ids"])
    own = F.get(extract_key(F.col("record"), id_path), F.lit(0)) if id_path else F.lit(None).cast("string")
    named = rows.withColumn("_own", own)
    found = named.select(*keep, F.when(F.array_contains("ids", F.col("_own")), F.col("_own")).otherwise(F.get("ids", F.col("record_idx"))).alias("id"), "record", "record_idx")
    first = found.where(F.col("id").isNotNull()).groupBy(*keep, "id").agg(F.min(F.struct("record_idx", "record")).alias("_first")).select(*keep, "id", F.col("_first.record").alias("record"))
    asked = succeeded(pages).select(*keep, F.explode(F.split("query", ",")).alias("id"))
    return asked.join(first, [*keep, "id"], "left")


def carry_metadata(pages: DataFrame, earlier: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Metadata that a page lacks comes from the earlier step's page of the same key."""
    old = earlier.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in columns))
    joined = pages.join(old, keys, "left")
    return joined.select(*(F.coalesce(c, f"_old_{c}").alias(c) if c in columns else F.col(c) for c in pages.columns))


def search_plan(pages: DataFrame, maps: Mapping[str, FieldMap], record_paths: Mapping[str, str], include: tuple[str, ...] = ("page",), delimiter: str | None = "; ") -> DataFrame:
    """Successful pages -> parsed -> records -> each provider's map -> union, with the page's tags.

    A record whose provider has no path is dropped; the tags win over fields of their names.
    """
    parsed = parse_pages(succeeded(pages))
    rows = None
    for provider, path in record_paths.items():
        part = explode_records(parsed.where(F.col("provider_name") == provider), path, keep=["provider_name", *include])
        rows = part if rows is None else rows.unionByName(part)
    return normalise_pages(rows.withColumnRenamed("provider_name", "_provider"), {p: m for p, m in maps.items() if p in record_paths}, "_provider", keep=[*include, "record_idx"], delimiter=delimiter)
