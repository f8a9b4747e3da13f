"""Scalar functions: casts, page arithmetic, URLs, hashes, times and predicates, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes worth another attempt, and label suffixes that end a URL's basename.
RETRYABLE = (429, 500, 503, 504)
URL_SUFFIXES = ("com", "org", "net", "ac.uk", "io", "gov", "edu")


def coerce_int(text: Column) -> Column:
    """Whole numbers in text; anything else is null."""
    return F.trim(text).try_cast("bigint")


def try_int(text: Column) -> Column:
    """Whole numbers in their plain form, other text unchanged."""
    return F.coalesce(coerce_int(text).cast("string"), text)


def coerce_str(value: Column) -> Column:
    return F.decode(value, "UTF-8")


def quote_numeric(text: Column) -> Column:
    return F.when(coerce_int(text).isNotNull(), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)


def as_list(value: Column) -> Column:
    return F.coalesce(value, F.expr("cast(array() as array<string>)"))


def unlist(values: Column) -> Column:
    """The element of a list of one, null for an empty one; longer lists as JSON text."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).when(F.size(values) > 1, F.to_json(values))


def collapse(values: Column, delimiter: str | None = "; ") -> Column:
    """One element as it is, several joined (nulls print as None), none is null."""
    if delimiter is None:
        return unlist(values)
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).when(F.size(values) > 1, F.array_join(values, delimiter, "None"))


def join_elements(values: Column, delimiter: str) -> Column:
    """All elements joined; the empty list gives empty text."""
    return F.array_join(values, delimiter, "None")


def first_key(mapping: Column, *keys: str, any_case: bool = False) -> Column:
    """The value of the first key that is present, also if it is null."""
    if any_case:
        mapping, keys = F.transform_keys(mapping, lambda k, _: F.lower(k)), tuple(k.lower() for k in keys)
    found = None
    for k in keys:
        present = F.map_contains_key(mapping, k)
        value = F.element_at(mapping, k)
        found = F.when(present, value) if found is None else found.when(present, value)
    return found


def page_list(pages: Column) -> Column:
    """Sorted distinct page numbers."""
    return F.array_sort(F.array_distinct(F.transform(pages, lambda p: p.try_cast("int"))))


def start_index(page: Column, per_page: Column, *, zero_indexed: bool = False, auto_calculate: bool = True) -> Column:
    """The record offset (or page number) of a page; null for pages or sizes below 1."""
    start = 0 if zero_indexed else 1
    adjusted = page - 1 if zero_indexed else page
    value = (F.lit(start) + (adjusted - start) * per_page) if auto_calculate else adjusted
    return F.when((page >= 1) & (per_page >= 1), value)


def pages_remaining(page: Column, hits: Column, per_page: Column) -> Column:
    known = page.isNotNull() & hits.isNotNull() & per_page.isNotNull() & (per_page > 0)
    return F.when(known, F.greatest(F.lit(0).cast("long"), F.ceil(hits / per_page) - page))


def normalize_name(text: Column) -> Column:
    return F.trim(F.replace(F.lower(text), F.lit("_"), F.lit("")))


def normalize_url(url: Column, *, keep_parameters: bool = True) -> Column:
    """https, no leading www., no trailing slashes; optionally without query and fragment."""
    plain = F.regexp_replace(url, r"^(?:https?://)?(?:www\.)?", "https://")
    if not keep_parameters:
        plain = strip_parameters(plain)
    return F.regexp_replace(plain, "/+$", "")


def strip_parameters(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#;].*$", "")


def url_basename(url: Column) -> Column:
    """The registrable label of the host, before a well-known suffix."""
    suffix = "|".join(s.replace(".", r"\.") for s in URL_SUFFIXES)
    return F.nullif(F.regexp_extract(url, rf"^https?://(?:[^/?#]*?\.)?([^./?#]+)\.(?:{suffix})(?:[/?#:]|$)", 1), F.lit(""))


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def valid_email(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9._%+-]+(@|%40)[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lit(False))


def detect_format(content_type: Column) -> Column:
    lower = F.lower(content_type)
    return F.when(lower.contains("xml"), "xml").when(lower.contains("json"), "json").when(lower.contains("yaml") | lower.contains("yml"), "yaml").otherwise("unknown")


def status_ok(code: Column, *, strict: bool = False) -> Column:
    return F.coalesce(code.between(200, 299) if strict else code.between(200, 399), F.lit(False))


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def response_hash(url: Column, headers: Column, content: Column) -> Column:
    """Over the URL, the validators among the headers in order of name, and the content's hash."""
    kept = F.filter(F.map_entries(F.transform_keys(headers, lambda k, _: F.lower(k))), lambda e: e["key"].isin("etag", "last-modified"))
    listed = F.transform(F.array_sort(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha2(F.concat(F.coalesce(url, F.lit("")), F.array_join(listed, ""), content_hash(content)), 256)


def url_cache_key(url: Column, status: Column) -> Column:
    return F.sha2(F.concat(F.regexp_replace(url, r"^[A-Za-z]+://", ""), F.lit("_"), status.cast("string")), 256)


def search_cache_key(provider: Column, query: Column, page: Column, per_page: Column, parameters: Column | None = None) -> Column:
    """Lower-case key; a hash of further parameters keeps different searches apart."""
    parts = [provider, query, page.cast("string"), per_page.cast("string")]
    if parameters is not None:
        parts.append(F.substring(F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parameters)))), 256), 1, 16))
    return F.lower(F.concat_ws("_", *parts))


def namespaced(key: Column, namespace: str) -> Column:
    return F.when(key.startswith(f"{namespace}:"), key).otherwise(F.concat(F.lit(f"{namespace}:"), key))


def iso_timestamp(ts: Column) -> Column:
    """UTC, milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Whole seconds, or the time until an ISO or HTTP date, never below 0; null for other text."""
    http = F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", "")
    at = F.coalesce(parse_iso(value), F.try_to_timestamp(http, F.lit("dd MMM yyyy HH:mm:ss")))
    seconds = F.coalesce(coerce_int(value), at.cast("long") - now.cast("long"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0).cast("long"), seconds))


def truncated(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(max(length - 3, 0))), F.lit("..."))).otherwise(text)


def encode_bytes(content: Column, prefix: str = "<hashbytes>") -> Column:
    return F.concat(F.lit(prefix), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))  # in one line


def decode_bytes(text: Column, prefix: str = "<hashbytes>") -> Column:
    """The bytes of prefixed base64; null if it is none."""
    body = F.substring(text, len(prefix) + 1, 1 << 30)
    return F.when(text.startswith(prefix) & (F.length(body) % 4 == 0), F.try_to_binary(body, F.lit("base64")))


def is_base64(text: Column) -> Column:
    ok = (F.length(text) % 4 == 0) & (F.length(text) > 0) & text.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")
    return F.coalesce(ok, F.lit(False))


def non_readable(content: Column) -> Column:
    """More than one byte, and over a fifth of them outside printable ASCII."""
    hexed = F.hex(content)
    count = F.length(hexed) / 2
    plain = F.length(F.regexp_replace(F.regexp_replace(hexed, "([0-9A-F]{2})", "$1,"), "(?:[2-6][0-9A-F]|7[0-9A-E]),", "")) / 3
    return (count > 1) & (plain / count > 0.2)
