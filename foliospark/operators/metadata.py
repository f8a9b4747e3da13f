"""Page metadata through a map of keys: total hits, page size, pages left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.scalars import coerce_int, pages_remaining
from foliospark.sources.providers import Provider


@dataclass(frozen=True)
class MetadataMap:
    """Where a provider's metadata says how many hits a query has and how many records a page.

    A key is looked up whole (also one with dots), then as a dotted path. Whole numbers and text that is one count, anything else is null.
    Metadata are JSON text or, as extraction gives them, a map of JSON texts and plain scalars.
    """

    total_query_hits: str | None = None
    records_per_page: str | None = None

    @classmethod
    def of(cls, provider: Provider) -> MetadataMap:
        return cls(provider.hits, provider.size)

    @staticmethod
    def _in_text(metadata: Column, key: str) -> Column:
        whole = F.get_json_object(metadata, f"$['{key}']")
        if "." not in key:
            return whole
        nested = F.get_json_object(metadata, "$" + "".join(f"['{k}']" for k in key.split(".")))
        return F.when(F.array_contains(F.json_object_keys(metadata), key), whole).otherwise(nested)

    @classmethod
    def value(cls, metadata: Column, key: str | None, *, keyed: bool = False) -> Column:
        """The text at a key; ``keyed`` says that the metadata are a map."""
        if not key:
            return F.lit(None).cast("string")
        if not keyed:
            return cls._in_text(metadata, key)
        first, _, rest = key.partition(".")
        whole = F.try_element_at(metadata, F.lit(key))
        return F.when(F.map_contains_key(metadata, key), whole).otherwise(cls._in_text(F.try_element_at(metadata, F.lit(first)), rest)) if rest else whole

    def hits(self, metadata: Column, *, keyed: bool = False) -> Column:
        return coerce_int(self.value(metadata, self.total_query_hits, keyed=keyed))

    def page_size(self, metadata: Column, *, keyed: bool = False) -> Column:
        return coerce_int(self.value(metadata, self.records_per_page, keyed=keyed))

    def processed(self, metadata: Column, *, keyed: bool = False) -> Column:
        """struct<total_query_hits, records_per_page>."""
        return F.struct(self.hits(metadata, keyed=keyed).alias("total_query_hits"), self.page_size(metadata, keyed=keyed).alias("records_per_page"))

    def pages_left(self, page: Column, metadata: Column, hits: Column | None = None, size: Column | None = None, *, keyed: bool = False) -> Column:
        """Pages after this one; given numbers win over the metadata's unless they are null or 0, and a size of 0 gives null."""
        given = lambda column, own: own if column is None else F.coalesce(F.nullif(column, F.lit(0)), own)
        total, per_page = given(hits, self.hits(metadata, keyed=keyed)), given(size, self.page_size(metadata, keyed=keyed))
        return pages_remaining(page, total, F.nullif(per_page, F.lit(0)))


def by_provider(pages: DataFrame, providers: list[Provider], metadata: str = "metadata", provider: str = "provider_name", *, keyed: bool = False) -> DataFrame:
    """Adds ``processed``: each page's numbers by its own provider's keys; null for a provider that isn't known."""
    chosen = None
    for p in providers:
        of = MetadataMap.of(p).processed(F.col(metadata), keyed=keyed)
        chosen = F.when(F.col(provider) == p.name, of) if chosen is None else chosen.when(F.col(provider) == p.name, of)
    return pages.withColumn("processed", chosen if chosen is not None else F.lit(None).cast("struct<total_query_hits:bigint,records_per_page:bigint>"))
