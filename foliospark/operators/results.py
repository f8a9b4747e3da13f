"""Result pages as a DataFrame: filter, select, join with records, order and stop rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.scalars import normalize_name, pages_remaining

PAGE_COLUMNS = "query string, provider_name string, page int, status string, url string, status_code int, content_type string, content string, cache_key string, created_at timestamp, error string, message string"
TAGS = ("query", "provider_name", "page")


def succeeded(pages: DataFrame, *, invert: bool = False) -> DataFrame:
    """Processed pages; inverted, all others."""
    good = F.coalesce(F.col("status") == "processed", F.lit(False))
    return pages.where(~good if invert else good)


def select_pages(pages: DataFrame, query: str | None = None, provider: str | None = None, page: Iterable[int] | None = None) -> DataFrame:
    """By exact query, normalised provider name and page numbers; None means all."""
    if query is not None:
        pages = pages.where(F.col("query") == query)
    if provider is not None:
        pages = pages.where(normalize_name(F.col("provider_name")) == normalize_name(F.lit(provider)))
    wanted = list(page) if page is not None else []
    return pages.where(F.col("page").isin(wanted)) if wanted else pages


def join_records(pages: DataFrame, records: str = "records", include: Iterable[str] = ("provider_name", "page")) -> DataFrame:
    """One row per record with its page's tags; a tag replaces a record's field of its name."""
    include = [t for t in include if t in TAGS]
    rows = pages.select(*include, F.posexplode(records).alias("record_idx", "record"))
    tagged = F.to_json(F.struct(*include)) if include else None
    return rows.withColumn("tags", tagged) if include else rows


def record_count(records: Column) -> Column:
    return F.coalesce(F.size(records), F.lit(0))


def providers(pages: DataFrame) -> DataFrame:
    return pages.select(normalize_name(F.col("provider_name")).alias("provider")).distinct()


def metadata_rows(pages: DataFrame, hits: Column, per_page: Column) -> DataFrame:
    """One row per page: tags, hits, page size and pages left; failed pages have tags only."""
    good = F.col("status") == "processed"
    left = pages_remaining(F.col("page"), hits, per_page)
    return pages.select(*TAGS, F.when(good, hits).alias("total_query_hits"), F.when(good, per_page).alias("records_per_page"), F.when(good, left).alias("pages_remaining"))


def until_halt(pages: DataFrame, halt: Column, by: Iterable[str] = ("provider_name", "query")) -> DataFrame:
    """Pages up to and including the first that stops the search of its provider and query.

    The first stop of a search is a minimum that combines before the shuffle; the join back is left to the run's sizes
    (broadcast, or sorted with hot searches split), so no search is gathered into one task.
    """
    by = list(by)
    stops = pages.where(halt).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("page").alias("_stop"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    joined = pages.join(stops, same, "left").where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
    return joined.select(*pages.columns)


def halt_rule(count: Column, per_page: Column, remaining: Column, failed: Column) -> Column:
    """Nothing left, a short page while the total is unknown, or an error (but not of page 0)."""
    return F.coalesce(remaining == 0, F.lit(False)) | (remaining.isNull() & F.coalesce(count < per_page, F.lit(False))) | (failed & (F.col("page") > 0))


def with_ranges(frame: DataFrame, by: str, order: str, parts: int, salts: int) -> DataFrame:
    """Adds ``_range`` and ``_salt``: consecutive ranges of each group's rows in the order of a number.

    Quantiles of ``order`` (a sketch of bounded size, combined before the shuffle) are the bounds; a value that fills
    whole ranges, and rows without a value, are dealt to ``salts`` parts.
    """
    quantiles = F.percentile_approx(F.col(order).cast("double"), [k / parts for k in range(1, parts)], 10 * parts).alias("_q")
    repeated = F.array_distinct(F.filter("_q", lambda x, i: (i > 0) & (x == F.get("_q", i - 1))))
    bounds = frame.groupBy(F.col(by).alias("_by")).agg(quantiles).select("_by", F.array_sort(F.array_distinct("_q")).alias("_b"), repeated.alias("_hot"))
    value = F.col(order).cast("double")
    rows = frame.join(bounds, F.col(by).eqNullSafe(F.col("_by")), "left")
    below = F.size(F.filter(F.coalesce("_b", F.expr("cast(array() as array<double>)")), lambda b: b < value))
    hot = F.coalesce(F.array_contains("_hot", value), F.lit(False)) | value.isNull()
    salt = F.when(hot, 1 + F.pmod(F.xxhash64(*frame.columns), F.lit(salts))).otherwise(0)
    return rows.select(*frame.columns, F.when(value.isNull(), -1).otherwise(below).alias("_range"), salt.alias("_salt"))


def ranked(frame: DataFrame, by: str, order: str, name: str, parts: int = 64, salts: int = 16) -> DataFrame:
    """Adds ``name``, the row number within each ``by`` in the order of a number, without gathering a group into one task.

    Rows are numbered within their range, and ranges get the sums of the counts before them. Rows that
    are equal in ``order`` may come in any order; those without a value come first.
    """
    rows = with_ranges(frame, by, order, parts, salts)
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range", "_salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(by, "_range", "_salt").agg(F.count("*").alias("_n")).select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by, "_range", "_salt").orderBy(order)))
    joined = numbered.join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")) & (F.col("_salt") == F.col("_s")))
    return joined.select(*frame.columns, (F.col("_before") + F.col("_rank")).cast("int").alias(name))


def round_robin(pages: DataFrame, provider: str = "provider_name", order: str = "page") -> DataFrame:
    """Adds ``turn``: page 1 of each provider, then page 2 of each, and so on; sort by (turn, provider)."""
    return ranked(pages, provider, order, "turn")


def grouped(pages: DataFrame) -> DataFrame:
    """Provider by provider, pages in order."""
    return pages.orderBy("provider_name", "query", "page")
