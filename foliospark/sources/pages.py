"""Python Data Source for paginated APIs: one partition per provider, pages in order within.

Rate limits hold because a provider is one task. The transport is named by import path
(``module:function``) and called as ``transport(url, params) -> (status, headers, body)``, so
tests use a transport in this process's modules and production one that sends requests.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

from foliospark.sources.retries import Answer, RetryPolicy, Validator, asked_wait, well_answered

SCHEMA = "query string, provider_name string, page int, status string, url string, status_code int, content_type string, content string, cache_key string, created_at string, error string, message string"


@dataclass
class Search:
    """One provider's searches: its parameters' names and what is asked of it."""

    provider: str
    base_url: str
    query_param: str
    start_param: str | None
    size_param: str
    queries: list[str]
    pages: list[int]
    records_per_page: int = 25
    zero_indexed: bool = False
    auto_calculate: bool = True
    delay: float = 6.1
    hits_path: str | None = None
    records_path: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def parameters(self, query: str, page: int) -> dict[str, Any]:
        start = 0 if self.zero_indexed else 1
        adjusted = page - 1 if self.zero_indexed else page
        at = start + (adjusted - start) * self.records_per_page if self.auto_calculate else adjusted
        core = {self.query_param: query, self.size_param: self.records_per_page} | ({self.start_param: at} if self.start_param else {})
        return {k: v for k, v in (dict(self.extra) | core).items() if v is not None}


class Limiter:
    """At least ``delay`` seconds between calls, and none before what a Retry-After header asked for; clock and sleep can be replaced."""

    def __init__(self, delay: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, last: float | None = None, hold: float | None = None) -> None:
        self.delay, self.clock, self.sleep, self.last, self.hold = delay, clock, sleep, last, hold

    def wait(self, delay: float | None = None) -> None:
        gap = self.delay if delay is None else delay
        free = max((t for t in (None if self.last is None else self.last + gap, self.hold) if t is not None), default=None)
        if free is not None and (rest := free - self.clock()) > 0:
            self.sleep(rest)
        self.last, self.hold = self.clock(), None

    def hold_for(self, seconds: float) -> None:
        """No call for so long from now on."""
        self.hold = max(self.hold or 0, self.clock() + seconds)


def page_facts(body: str, hits_path: str | None, records_path: str | None) -> tuple[int | None, int | None]:
    """Total hits and number of records of a page, where the paths lead to them."""
    try:
        page = json.loads(body)
    except ValueError:
        return None, None

    def at(path: str | None) -> Any:
        value = page
        for key in (path or "").split("."):
            value = value.get(key) if isinstance(value, dict) else None
        return value

    hits, records = at(hits_path), at(records_path)
    hits = int(hits) if isinstance(hits, int) or isinstance(hits, str) and hits.strip().isdigit() else None
    return hits, len(records) if isinstance(records, list) else None


class Harvest:
    """The requests of one provider, one after the other, under one limiter.

    A search ends when nothing is left, when a page is short while the total is unknown, or by an
    error that retries don't mend; a lost connection or an error that isn't worth a retry ends all
    of the provider's. What a Retry-After header of any answer asks for is kept until the next call, whichever search makes it.
    """

    def __init__(self, transport: Callable | None, limiter: Limiter, sleep: Callable[[float], None] = time.sleep, valid: Validator = well_answered, policy: RetryPolicy = RetryPolicy()) -> None:
        self.transport, self.limiter, self.sleep, self.valid, self.policy = transport, limiter, sleep, valid, policy
        self.ended: object = None
        self.stopped = False

    def fetch(self, search: Search, query: str, page: int, kept: Answer | None = None, of: object = None) -> tuple | None:
        """The row of a page, or None if its search has ended; ``kept`` is an answer from a cache, which costs no call."""
        own = (of, query, search.records_per_page)
        if self.stopped or self.ended == own:
            return None
        params = search.parameters(query, page)
        key = hashlib.sha256(json.dumps([search.provider, query, page, params], sort_keys=True).encode()).hexdigest()
        made = datetime.now(UTC).isoformat(timespec="milliseconds")
        tags = (query, search.provider, page)
        if kept is None and self.transport is None:
            self.ended = own
            return (*tags, "nonresponse", search.base_url, None, None, None, key, made, "NotCached", "no transport")

        def send() -> Answer:
            self.limiter.wait()
            answer = self.transport(search.base_url, params)
            if answer[0] not in self.policy.statuses and (wait := asked_wait(answer[1])):  # a retry waits by itself
                self.limiter.hold_for(wait)
            return answer

        try:
            status, headers, body = kept or self.policy.run(send, self.sleep, self.valid)
        except Exception as error:  # no response: a row, not a failed task
            self.stopped = page > 0
            return (*tags, "nonresponse", search.base_url, None, None, None, key, made, type(error).__name__, str(error))
        good = self.valid(status, headers, body)
        kind = {k.lower(): v for k, v in headers.items()}.get("content-type", "application/json")
        if good:
            hits, count = page_facts(body, search.hits_path, search.records_path)
            last = math.ceil(hits / search.records_per_page) <= page if hits is not None else count is not None and count < search.records_per_page
        if not good or last:
            self.ended = own
            self.stopped = not good and status not in self.policy.statuses
        return (*tags, "processed" if good else "error", search.base_url, status, kind, body, key, made, None if good else "HTTPError", None if good else f"status {status}")


def scan(search: Search, transport: Callable, limiter: Limiter | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Pages of one search's queries in order."""
    yield from scan_all([search], Harvest(transport, limiter or Limiter(search.delay), sleep))


def scan_all(searches: list[Search], harvest: Harvest) -> Iterator[tuple]:
    """Pages of a provider's searches, each with its own queries, pages and page size."""
    for number, search in enumerate(searches):
        for query in search.queries:
            for page in sorted(set(search.pages)):
                row = harvest.fetch(search, query, page, of=number)
                if row:
                    yield row


def named(path: str) -> Callable | None:
    """The function of an import path ``module:function``; none of an empty one."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name) if module else None


@dataclass
class _Partition(InputPartition):
    searches: list[dict]

    def __init__(self, searches: list[dict]) -> None:
        super().__init__(searches[0]["provider"])
        self.searches = searches


def by_provider(searches: list[dict]) -> dict[str, list[dict]]:
    """The searches of each provider, as they were given."""
    found: dict[str, list[dict]] = {}
    for s in searches:
        if s not in found.setdefault(s["provider"], []):
            found[s["provider"]].append(s)
    return found


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.searches = json.loads(options["searches"])
        self.transport = options["transport"]
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists on provider_name, query and page prune requests before any is planned."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("provider_name",), ("query",), ("page",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.allowed.setdefault(f.attribute[0], values)
                self.allowed[f.attribute[0]] = known & values
            yield f  # pages that only lead to those asked for are still sent, so Spark filters again

    def partitions(self) -> list[_Partition]:
        """All searches of a provider are one partition; those that a filter leaves nothing of make none.

        A search runs up to the largest page asked for: whether that page exists shows in those before.
        """
        ok = lambda name, value: name not in self.allowed or value in self.allowed[name]
        last = max(self.allowed.get("page", ()), default=None)
        kept = [
            s | {"queries": [q for q in s["queries"] if ok("query", q)], "pages": [p for p in s["pages"] if last is None or p <= last]}
            for s in self.searches
            if ok("provider_name", s["provider"]) and not ("page" in self.allowed and last is None)
        ]
        return [_Partition(own) for own in by_provider([s for s in kept if s["queries"] and s["pages"]]).values()] or [_Partition([{"provider": ""}])]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        searches = [Search(**s) for s in partition.searches if s["provider"]]
        if searches:
            yield from scan_all(searches, Harvest(named(self.transport), Limiter(max(s.delay for s in searches))))


class _Stream(SimpleDataSourceStreamReader):
    """Pages as a stream: a batch sends at most ``pages_per_batch`` requests to each provider, providers side by side.

    The offset of a provider is the number of requests behind it with the last query and page, whether that
    search or the provider has ended, and the time of the last call, so that a restart neither repeats nor skips
    a page and keeps the delay. What the driver holds is a batch: ``pages_per_batch`` pages of each provider.
    """

    def __init__(self, options: dict) -> None:
        self.searches = {p: [Search(**s) for s in own] for p, own in by_provider(json.loads(options["searches"])).items()}
        self.transport = options["transport"]
        self.size = int(options.get("pages_per_batch", "10"))

    def initialOffset(self) -> dict:
        return {p: {"next": 0, "query": None, "page": None, "ended": None, "stopped": False, "called": None, "hold": None} for p in self.searches}

    def _requests(self, provider: str) -> list[tuple[int, str, int]]:
        return [(k, q, p) for k, s in enumerate(self.searches[provider]) for q in s.queries for p in sorted(set(s.pages))]

    def _advance(self, provider: str, at: dict, upto: int | None) -> tuple[list[tuple], dict]:
        """Rows from an offset on, to a given one or until the batch is full."""
        searches, requests = self.searches[provider], self._requests(provider)
        harvest = Harvest(named(self.transport), Limiter(max(s.delay for s in searches), last=at["called"], hold=at["hold"]))
        harvest.stopped, harvest.ended = at["stopped"], tuple(at["ended"]) if at["ended"] else None
        rows, n, query, page = [], at["next"], at["query"], at["page"]
        while n < len(requests) and (n < upto if upto is not None else len(rows) < self.size):
            k, query, page = requests[n]
            row = harvest.fetch(searches[k], query, page, of=k)
            rows += [row] if row else []
            n += 1
        return rows, {"next": n, "query": query, "page": page, "ended": list(harvest.ended) if harvest.ended else None, "stopped": harvest.stopped, "called": harvest.limiter.last, "hold": harvest.limiter.hold}

    def _all(self, start: dict, upto: dict | None) -> list[tuple[list[tuple], dict]]:
        if not self.searches:
            return []
        with ThreadPoolExecutor(len(self.searches)) as pool:
            return list(pool.map(lambda p: self._advance(p, start[p], upto and upto[p]["next"]), self.searches))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        done = self._all(start, None)
        return iter([r for rows, _ in done for r in rows]), dict(zip(self.searches, (at for _, at in done), strict=True))

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for rows, _ in self._all(start, end) for r in rows])

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the offsets."""


class PageSource(DataSource):
    """``spark.read`` or ``spark.readStream`` with ``.format("folio_pages").option("searches", json).option("transport", "module:function")``."""

    @classmethod
    def name(cls) -> str:
        return "folio_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def stream_pages(spark, searches: list[Search], transport: str, pages_per_batch: int = 10):
    """The pages of all searches as a stream."""
    spark.dataSource.register(PageSource)
    source = spark.readStream.format("folio_pages").option("searches", json.dumps([asdict(s) for s in searches]))
    return source.option("transport", transport).option("pages_per_batch", pages_per_batch).load()


def read_pages(spark, searches: list[Search], transport: str):
    """The pages of all searches as a DataFrame."""
    spark.dataSource.register(PageSource)
    return spark.read.format("folio_pages").option("searches", json.dumps([asdict(s) for s in searches])).option("transport", transport).load()


def http_get(url: str, params: dict, timeout: float = 30.0) -> tuple[int, dict, str]:
    """A transport over the network."""
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    try:
        with urlopen(f"{url}?{urlencode(params)}", timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read().decode("utf-8", "replace")
    except HTTPError as error:
        return error.code, dict(error.headers), error.read().decode("utf-8", "replace")
