"""Search configuration: checked values, defaults, scoped overrides, settings from the environment, and provider parameters."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.sources.providers import DEFAULT_DELAY, DEFAULT_PAGE_SIZE, Provider, Registry, request_parameters, request_url

# Fixed value: the provider of a search that names none.
DEFAULT_PROVIDER = "plos"


@dataclass(frozen=True)
class Parameter:
    """A parameter of one provider: whether it must be given, its default, and a test of its values."""

    name: str
    required: bool = False
    default: str | None = None
    valid: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class SearchConfig:
    """What a search asks of a provider; wrong values are errors when it is made."""

    provider: str = DEFAULT_PROVIDER
    records_per_page: int = DEFAULT_PAGE_SIZE
    request_delay: float = DEFAULT_DELAY
    api_key: str | None = field(default=None, repr=False)
    parameters: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not isinstance(self.records_per_page, int) or self.records_per_page < 1:
            raise ValueError(f"not a page size: {self.records_per_page!r}")
        if self.request_delay < 0:
            raise ValueError(f"not a delay: {self.request_delay!r}")
        if not self.provider.strip():
            raise ValueError("a search needs a provider")

    def checked(self, registry: Registry) -> Provider:
        """The provider, if it is known and has the key that it needs."""
        provider = registry.get(self.provider)
        if provider.key_required and not self.api_key:
            raise ValueError(f"{provider.name} needs an API key")
        return provider

    def with_provider(self, provider: str, **changes: Any) -> SearchConfig:
        """Another provider; the key and the parameters of the old one don't go with it."""
        same = Registry.key(provider) == Registry.key(self.provider)
        kept = {} if same else {"api_key": None, "parameters": {}}
        return replace(self, provider=provider, **(kept | changes))


class Settings:
    """A configuration that can be changed for a while."""

    def __init__(self, config: SearchConfig) -> None:
        self.config = config

    @contextmanager
    def override(self, **changes: Any) -> Iterator[SearchConfig]:
        """The changed configuration inside the block; the old one after it, whatever happens there."""
        before = self.config
        self.config = replace(before, **changes)
        try:
            yield self.config
        finally:
            self.config = before


def from_environment(provider: str = DEFAULT_PROVIDER, environment: Mapping[str, str] | None = None, prefix: str = "FOLIOSPARK_") -> SearchConfig:
    """A configuration from variables: <prefix>PAGE_SIZE, <prefix>DELAY and <PROVIDER>_API_KEY."""
    env = os.environ if environment is None else environment
    size, delay = env.get(f"{prefix}PAGE_SIZE"), env.get(f"{prefix}DELAY")
    return SearchConfig(provider, int(size) if size else DEFAULT_PAGE_SIZE, float(delay) if delay else DEFAULT_DELAY, env.get(f"{Registry.key(provider).upper()}_API_KEY"))


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines and those that start with # are skipped, quotes around a value go."""
    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in map(str.strip, lines):
            name, sign, value = line.partition("=")
            if sign and not line.startswith("#"):
                found[name.strip()] = value.strip().strip("\"'")
    return found


def tolerant(call: Callable[..., Any], *args: Any, errors: tuple[type[Exception], ...] = (Exception,), default: Any = None, logger: logging.Logger | None = None) -> Any:
    """The result of a call, or the default if it raises one of ``errors``."""
    try:
        return call(*args)
    except errors as error:
        if logger:
            logger.warning("%s failed: %s", getattr(call, "__name__", call), error)
        return default


def checked_parameters(provider: Provider, specs: tuple[Parameter, ...], query: Column, page: Column, given: Mapping[str, Column]) -> tuple[Column, Column]:
    """The request's parameters, and whether all given ones pass their tests.

    Unknown and core parameters and missing required ones are errors of the plan; a null value takes the default.
    """
    core = {provider.query, provider.start, provider.page_size}
    known = {s.name: s for s in specs}
    if wrong := [n for n in given if n in core or n not in known]:
        raise ValueError(f"not parameters of {provider.name}: {wrong}")
    if missing := [s.name for s in specs if s.required and s.default is None and s.name not in given]:
        raise ValueError(f"{provider.name} needs {missing}")
    values, valid = {}, F.lit(True)
    for s in specs:
        value = F.coalesce(given[s.name].cast("string") if s.name in given else F.lit(None).cast("string"), F.lit(s.default))
        values[s.name] = value
        if s.valid is not None:
            valid &= value.isNull() | F.coalesce(s.valid(value), F.lit(False))
        if s.required:
            valid &= value.isNotNull()
    return request_parameters(provider, query, page, **values), valid


def endpoint_url(provider: Provider, endpoint: Column | None = None, parameters: Column | None = None) -> Column:
    """The URL of a request without pages: an endpoint below the provider's address, parameters, or both."""
    if endpoint is None and parameters is None:
        raise ValueError("a request without pages needs an endpoint or parameters")
    base = F.lit(provider.base_url.rstrip("/"))
    url = base if endpoint is None else F.concat(base, F.lit("/"), F.regexp_replace(endpoint, r"\A/+", ""))
    if parameters is None:
        return url
    asked = F.substring_index(request_url(provider, F.map_filter(parameters, lambda _, v: v.isNotNull())), "?", -1)
    return F.when(asked == "", url).otherwise(F.concat(url, F.lit("?"), asked))
