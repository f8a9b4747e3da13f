"""Field maps: declared paths compiled to column expressions over JSON records.

A field is a path, a list of paths of which the first that has a value counts (empty text
is a value), or absent. Defaults stand in for null and for empty text.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.jsonpath import ANY_TEXT, NO_TEXT, ONE_TEXT, fields_by, values_at
from foliospark.functions.scalars import collapse

# The shared academic schema, in order.
UNIVERSAL_FIELDS = (
    "provider_name", "doi", "url", "record_id", "title", "abstract", "authors", "journal", "publisher", "year", "date_published", "date_created",
    "keywords", "subjects", "full_text", "citation_count", "open_access", "license", "record_type", "language",
)
UNIVERSAL_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in UNIVERSAL_FIELDS])


#: Fields of the shared schema that hold several values.
MULTI = ("authors", "keywords", "subjects")


@dataclass(frozen=True)
class FieldMap:
    """Output field -> path, list of paths, or None; the fields named in ``multi`` are lists."""

    provider_name: str | None
    fields: Mapping[str, str | list[str] | None]
    extras: Mapping[str, str | list[str] | None] = field(default_factory=dict)
    defaults: Mapping[str, str] = field(default_factory=dict)
    multi: tuple[str, ...] = MULTI

    def renamed(self, provider_name: str) -> FieldMap:
        return replace(self, provider_name=provider_name)

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(["provider_name", *self.fields, *self.extras]))

    def paths(self, name: str) -> list[str]:
        """The paths of a field, in the order in which they are tried."""
        found = {**self.fields, **self.extras}.get(name)
        return [p for p in ([found] if isinstance(found, str) else found or []) if p]

    def choices(self, names: Iterable[str], delimiter: str | None) -> list[tuple[list[str], list[str], int]]:
        """For each output name its paths, its defaults, and how many empty texts give way to them."""
        out = []
        for n in names:
            default = [d for d in (self.defaults.get(n), self.provider_name if n == "provider_name" else None) if d is not None]
            paths = ["provider_name"] if n == "provider_name" else self.paths(n) if n in self.names else []
            blank = NO_TEXT if n == "provider_name" else ANY_TEXT if delimiter == "" or delimiter is None and n in self.multi else ONE_TEXT
            out.append((paths, default if n in self.names else [], blank))
        return out

    @property
    def slots(self) -> list[str]:
        """Every path that is read, once; the record's own provider first."""
        return list(dict.fromkeys(["provider_name", *(p for n in self.names for p in self.paths(n))]))

    def normalise(self, records: DataFrame, record: str = "record", keep: Iterable[str] = (), delimiter: str | None = None) -> DataFrame:
        """records -> the kept columns and one column for each field; a kept column wins over a field of its name.

        Without a delimiter the fields of ``multi`` are array<string>, and several values of another
        field are JSON text; with one, every field is text and several values are joined.
        """
        keep = list(keep)
        read = records.select(*keep, values_at(F.col(record), self.slots).alias("_v"))
        return read.select(*keep, *(self.value(n, delimiter).alias(n) for n in self.names if n not in keep))

    def value(self, name: str, delimiter: str | None) -> Column:
        """A field from the slots in column ``_v``."""
        at = {p: F.get("_v", F.lit(i)) for i, p in enumerate(self.slots)}
        default = self.defaults.get(name)
        if name == "provider_name":
            return F.coalesce(F.get(at["provider_name"], F.lit(0)), F.lit(default), F.lit(self.provider_name))
        listed = delimiter is None and name in self.multi
        if listed:
            given = [F.when(F.size(at[p]) > 0, at[p]) for p in self.paths(name)]
            value = F.coalesce(*given) if given else F.lit(None).cast("array<string>")
            return value if default is None else F.when(value.isNull() | (F.array_join(value, "") == ""), F.array(F.lit(default))).otherwise(value)
        given = [F.when(F.size(at[p]) > 0, collapse(at[p], delimiter)) for p in self.paths(name)]
        value = F.coalesce(*given) if given else F.lit(None).cast("string")
        return value if default is None else F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


class AcademicMap(FieldMap):
    """A field map onto the shared schema: all its fields are present, in order, then the extras."""

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys([*UNIVERSAL_FIELDS, *self.extras]))


def rename_flat(frame: DataFrame, fields: Mapping[str, str | None], provider_name: str, keep: Iterable[str] = ()) -> DataFrame:
    """Flat rename of existing columns; fields without a source are null."""
    present = set(frame.columns)
    chosen = [(F.col(src) if src and src in present else F.lit(None)).cast("string").alias(out) for out, src in fields.items()]
    return frame.select(F.lit(provider_name).alias("provider_name"), *keep, *chosen)


def union_normalised(frames: Iterable[DataFrame]) -> DataFrame:
    """Schema-aligned union; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def normalise_pages(records: DataFrame, maps: Mapping[str, FieldMap], provider: str = "provider", record: str = "record", keep: Iterable[str] = (), delimiter: str | None = None) -> DataFrame:
    """Each record by its provider's map, all in one pass; records of other providers are dropped. Columns that a map lacks are null."""
    keep = list(keep)
    names = [n for n in dict.fromkeys(n for m in maps.values() for n in m.names) if n not in keep]
    known = records.where(F.col(provider).isin(list(maps)))
    read = known.select(*keep, fields_by(F.col(provider), F.col(record), {k: m.choices(names, delimiter) for k, m in maps.items()}).alias("_v"))
    listed = {n for m in maps.values() for n in m.multi} if delimiter is None else set()

    def column(at: int, name: str) -> Column:
        found = F.get("_v", F.lit(at))
        if name == "provider_name":
            return F.get(found, F.lit(0)).alias(name)
        return F.when(F.size(found) > 0, found if name in listed else collapse(found, delimiter)).alias(name)

    return read.select(*keep, *(column(i, n) for i, n in enumerate(names)))


#: Tasks per core into which records of unknown providers are dealt.
TASKS_PER_CORE = 4


def normalise_by(records: DataFrame, registry, url: str = "url", name: str | None = None, record: str = "record", keep: Iterable[str] = (), delimiter: str | None = None) -> DataFrame:
    """Each record by the map of the provider of its page's URL, else of the given name; records of unknown providers are dropped."""
    # records are dealt anew: a small file of large tables is one task otherwise, and a record costs much more than its bytes say
    dealt = records.repartition(TASKS_PER_CORE * records.sparkSession.sparkContext.defaultParallelism)
    resolved = registry.resolve(dealt, F.col(url), F.col(name) if name else F.lit(None).cast("string"))
    return normalise_pages(resolved, registry.maps, "provider", record, keep, delimiter)


def coverage(frame: DataFrame, by: str, fields: Iterable[str]) -> DataFrame:
    """Rows, non-null counts and their percentages per group."""
    fields = list(fields)
    counted = [F.count(f).alias(f"n_{f}") for f in fields]
    shares = [F.round(100.0 * F.count(f) / F.count("*"), 4).alias(f"pct_{f}") for f in fields]
    return frame.groupBy(by).agg(F.count("*").alias("n_rows"), *counted, *shares)


def first_by(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; null keys are one group. Combines before the shuffle."""
    ranked = F.struct(*order, *[c for c in frame.columns if c not in order])
    return frame.groupBy(*keys).agg(F.min(ranked).alias("_first")).select("_first.*").select(*frame.columns)
