"""Pages for a table of requests: a table function that runs each provider's requests in order.

The function's ``analyze`` asks Spark to partition the table by provider and to sort it by search and page, so a
provider's limits hold in one call, as in the page source, but the requests are rows of any
DataFrame, each with its own page size and parameters. Answers that a cache holds are joined to the requests before, and
only the others are sent. A provider that sends requests is one task because its limits are; what a task holds is one request. Without a transport nothing is
sent and no limit applies, so each provider's searches are dealt to ``LANES`` queues, unless the cache holds an answer that would stop the provider.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from foliospark.functions.scalars import retryable, status_ok
from foliospark.operators.cache import alive
from foliospark.sources.pages import SCHEMA, Harvest, Limiter, Search, named
from foliospark.sources.providers import Provider

_TYPES = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType(), "map<string,string>": MapType(StringType(), StringType())}


def _struct(ddl: str) -> StructType:
    """A schema without a session, which a table function's analysis lacks."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


#: What a request has; the page size is the provider's where it is null.
REQUEST = _struct("provider_name string, search string, query string, page int, records_per_page int, parameters map<string,string>")
CACHED = _struct("cached_status int, cached_type string, cached_content string")
FETCHED = _struct(f"{SCHEMA}, search string, from_cache boolean")
#: Queues of a provider that sends nothing.
LANES = 4096
KEYS = ("provider_name", "query", "page", "records_per_page")


def endpoint(provider: Provider, hits_path: str | None = None, records_path: str | None = None, delay: float | None = None) -> Search:
    """A provider as the requests of a table need it: without queries and pages."""
    return Search(
        provider.name, provider.base_url, provider.query, provider.start, provider.page_size, [], [], provider.records_per_page,
        provider.zero_indexed, provider.auto_calculate, provider.delay if delay is None else delay, hits_path, records_path, dict(provider.extra),
    )


class FetchPages:
    """The table function: (requests, endpoints as JSON, transport) -> pages."""

    @staticmethod
    def analyze(requests: AnalyzeArgument, endpoints: AnalyzeArgument, transport: AnalyzeArgument) -> AnalyzeResult:
        if not requests.isTable:
            raise ValueError("the first argument must be a table of requests")
        needed = {f.name for f in (*REQUEST, *CACHED)} | {"_lane"}
        missing = needed.difference(f.name for f in requests.dataType)
        if missing:
            raise ValueError(f"requests lack the columns {sorted(missing)}")
        return AnalyzeResult(FETCHED, partitionBy=[PartitioningColumn("provider_name"), PartitioningColumn("_lane")], orderBy=[OrderingColumn(c) for c in ("search", "query", "records_per_page", "page")])

    def __init__(self) -> None:
        self.harvest: Harvest | None = None
        self.base: Search | None = None

    def eval(self, request: Row, endpoints: str, transport: str) -> Iterator[tuple]:
        if self.harvest is None:  # one object a queue
            known = json.loads(endpoints).get(request["provider_name"])
            self.base = Search(**known) if known else None
            self.harvest = Harvest(named(transport), Limiter(self.base.delay if self.base else 0))
        tags = (request["query"], request["provider_name"], request["page"])
        if self.base is None:
            yield (*tags, "nonresponse", None, None, None, None, None, None, "UnknownProvider", "no such endpoint", request["search"], False)
            return
        search = replace(self.base, records_per_page=request["records_per_page"] or self.base.records_per_page, extra=self.base.extra | (request["parameters"] or {}))
        kept = None if request["cached_status"] is None else (request["cached_status"], {"content-type": request["cached_type"] or "application/json"}, request["cached_content"] or "")
        row = self.harvest.fetch(search, request["query"], request["page"], kept, request["search"])
        if row:
            yield (*row, request["search"], kept is not None)


def with_cache(requests: DataFrame, entries: DataFrame | None, now: Column | None = None) -> DataFrame:
    """Adds what a cache holds for a request: entries(provider_name, query, page, records_per_page, status_code, content_type, content, expire_at).

    Expired entries count as none; of several live ones of a key the last to expire counts.
    """
    if entries is None:
        return requests.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in CACHED))
    # no expiry is for ever
    order = F.struct(F.col("expire_at").isNull().alias("ever"), "expire_at", F.col("status_code").alias("cached_status"), F.col("content_type").alias("cached_type"), F.col("content").alias("cached_content"))
    live = alive(entries, now).groupBy(*KEYS).agg(F.max(order).alias("_kept"))
    return requests.join(live, list(KEYS), "left").select(*requests.columns, "_kept.cached_status", "_kept.cached_type", "_kept.cached_content")


def with_lanes(requests: DataFrame, entries: DataFrame | None, now: Column | None = None) -> DataFrame:
    """Adds ``_lane``, the queue of a request within its provider, where nothing is sent: that of its search.

    Searches are independent but for an answer that ends its whole provider; a provider of which the cache holds one keeps one queue.
    """
    lane = F.pmod(F.xxhash64("search", "query", "records_per_page"), F.lit(LANES)).cast("int")
    if entries is None:
        return requests.withColumn("_lane", lane)
    status = F.col("status_code").cast("int")
    ending = alive(entries, now).where(~status_ok(status) & ~retryable(status)).select(F.col("provider_name").alias("_ended")).distinct()
    joined = requests.join(F.broadcast(ending), F.col("provider_name") == F.col("_ended"), "left")
    return joined.withColumn("_lane", F.when(F.col("_ended").isNull(), lane).otherwise(0)).drop("_ended")


def fetch_pages(requests: DataFrame, endpoints: Iterable[Search], transport: str = "", cache: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Pages of a table of requests (columns of ``REQUEST``; ``search``, ``records_per_page`` and ``parameters`` may be absent).

    Requests of one provider are sent in order of search, query, page size and page; each (search, query, page size) ends by itself. A
    request that neither the cache nor a transport can answer gives a row of status nonresponse. A row without provider, query or page is none.
    """
    known = {e.provider: e for e in endpoints}
    columns = []
    for f in REQUEST:
        columns.append((F.col(f.name) if f.name in requests.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    sizes = F.create_map(*(F.lit(x) for e in known.values() for x in (e.provider, e.records_per_page))) if known else None
    asked = requests.select(*columns).where(F.col("provider_name").isNotNull() & F.col("query").isNotNull() & F.col("page").isNotNull())
    if sizes is not None:
        asked = asked.withColumn("records_per_page", F.coalesce("records_per_page", F.try_element_at(sizes, F.col("provider_name"))))
    full = with_cache(asked.dropDuplicates(["provider_name", "search", "query", "page", "records_per_page"]), cache, now)
    full = full.withColumn("_lane", F.lit(0)) if transport else with_lanes(full, cache, now)
    fetch = F.udtf(FetchPages)
    return fetch(full.asTable(), F.lit(json.dumps({p: asdict(e) for p, e in known.items()})), F.lit(transport))
