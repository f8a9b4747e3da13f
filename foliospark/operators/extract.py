"""From pages to records: the choice between explicit paths and shape, and the contracts of custom parts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.records import explode_records, extract_dynamic, page_metadata

#: A custom extractor: pages, content column, kept columns -> kept columns, records array<string>, metadata map<string,string>.
Extractor = Callable[[DataFrame, str, list[str]], DataFrame]
#: A custom processor: records with a ``record`` column -> the same rows, or fewer, with the columns that it declares.
Processor = Callable[[DataFrame], DataFrame]


def extract(
    pages: DataFrame, content: str = "content", keep: Iterable[str] = (), *,
    record_path: str | None = None, metadata_paths: Mapping[str, str] | None = None, extractor: Extractor | None = None,
) -> DataFrame:
    """The kept columns, records array<string> and metadata map<string,string> of each page.

    Any explicit path makes both explicit; without one, records and metadata are found by their shape. A custom extractor
    replaces both. What is not a list has no records (null).
    """
    keep = list(keep)
    if extractor is not None:
        found = extractor(pages, content, keep)
        if found.columns != [*keep, "records", "metadata"]:
            raise ValueError(f"an extractor returns {[*keep, 'records', 'metadata']}, not {found.columns}")
        return found
    if record_path is None and not metadata_paths:
        return extract_dynamic(pages, content, keep)
    names = dict(metadata_paths or {})
    target = F.get_json_object(F.col(content), "$." + record_path if record_path else "$")
    records = F.when(target.startswith("["), F.from_json(target, "array<string>")) if record_path else F.lit(None).cast("array<string>")
    with_records = pages.select(*keep, F.col(content).alias("_content"), records.alias("records"))
    read = page_metadata(with_records, names, "_content", keep=[*keep, "records"])
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    metadata = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return read.select(*keep, "records", metadata.alias("metadata"))


def process(records: DataFrame, processor: Processor, columns: Iterable[str]) -> DataFrame:
    """Runs a custom processor and holds it to the columns that it declares."""
    done = processor(records)
    if missing := [c for c in columns if c not in done.columns]:
        raise ValueError(f"the processor lacks {missing}")
    return done.select(*columns)


__all__ = ["Extractor", "Processor", "explode_records", "extract", "process"]
