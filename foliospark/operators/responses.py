"""Responses as rows: to and from JSON text, equality, metadata on demand, and rebuilding from a cache."""

from __future__ import annotations

from collections.abc import Mapping
from http import HTTPStatus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.codec import deserialise, serialise
from foliospark.functions.scalars import coerce_int, decode_bytes, encode_bytes, valid_url
from foliospark.operators.cache import alive, hits

RESPONSE = "status_code int, reason string, url string, headers map<string,string>, content string, created_at string"
#: Columns that say when a response was made, not what it is.
TIMES = ("created_at",)


def to_json(status_code: Column, reason: Column, url: Column, headers: Column, content: Column, created_at: Column) -> Column:
    """A response as JSON text; the bytes of the content as marked base64."""
    return serialise(status_code=status_code, reason=reason, url=url, headers=headers, content=encode_bytes(content), created_at=created_at)


def from_json(text: Column, defaults: Mapping[str, Column] | None = None) -> Column:
    """The response back; fields that the text lacks come from ``defaults``."""
    read, given = deserialise(text, RESPONSE), dict(defaults or {})
    names = [f.strip().split(" ")[0] for f in RESPONSE.replace("<string,string>", "").split(",")]
    content = decode_bytes(read["content"])
    fields = [(content if n == "content" else read[n], n) for n in names]
    return F.struct(*((F.coalesce(c, given[n]) if n in given else c).alias(n) for c, n in fields))


def same_response(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """Whether all fields but the times are equal, nulls alike."""
    equal = F.lit(True)
    for name in [n for n in a if n not in TIMES]:
        equal &= a[name].eqNullSafe(b[name])
    return equal


def metadata_state(stored: Column, fresh: Column, update: bool | None = None) -> Column:
    """Processed metadata: fresh if none is stored (None), always fresh (True), or only what is stored (False)."""
    return F.coalesce(stored, fresh) if update is None else fresh if update else stored


def rebuilt_from_cache(wanted: DataFrame, cache: DataFrame, stages: tuple[str, ...] = ("parsed", "extracted", "processed", "metadata"), serialised: str = "serialised", now: Column | None = None) -> DataFrame:
    """Wanted keys with the stages that the cache holds alive; the response from its serialised form where the page has none."""
    found = hits(wanted, alive(cache, now) if "expire_at" in cache.columns else cache)
    read = from_json(F.col(serialised))
    return found.select(*wanted.columns, *(c for c in stages if c in cache.columns), read.alias("response"))


# --- what a response says of itself ---


def code_of(status_code: Column) -> Column:
    """The status code as a number, also from text; null if it is none."""
    return coerce_int(status_code.cast("string")).cast("int")


def reason_of(status_code: Column, reason: Column) -> Column:
    """The given reason unless it is empty, else the standard phrase of the code."""
    phrases = F.create_map(*(F.lit(x) for s in HTTPStatus for x in (int(s), s.phrase)))
    return F.coalesce(F.nullif(reason, F.lit("")), F.try_element_at(phrases, code_of(status_code)))


def text_of(content: Column) -> Column:
    """The content, bytes or text, as text; null where the bytes are not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def url_of(url: Column) -> Column:
    """The URL if it is a valid one of http or https."""
    return F.when(valid_url(url), url)


def accessors(responses: DataFrame, status_code: str = "status_code", reason: str = "reason", headers: str = "headers", content: str = "content", url: str = "url", status: str | None = None) -> DataFrame:
    """Replaces the parts of a response by what its accessors give and adds ``status`` and ``text``; other columns stay.

    ``status`` is the reason, else the status that the response has itself (the column of that name), else the phrase of its code.
    """
    own = F.col(status) if status else F.lit(None).cast("string")
    phrase = reason_of(F.col(status_code), F.col(reason))
    read = {status_code: code_of(F.col(status_code)), reason: phrase, headers: F.col(headers), content: F.col(content).cast("binary"), url: url_of(F.col(url))}
    kept = [read.get(c, F.col(c)).alias(c) for c in responses.columns if c not in ("status", "text") or c in read]
    return responses.select(*kept, F.coalesce(phrase, own).alias("status"), text_of(F.col(content)).alias("text"))


def is_success(status: Column) -> Column:
    """Truth of a result: processed is true whatever it holds; errors, missing responses and null are false."""
    return F.coalesce(status == "processed", F.lit(False))


def length_of(status: Column, records: Column) -> Column:
    """Number of processed records; 0 for anything but a processed response."""
    return F.when(is_success(status), F.coalesce(F.size(records), F.lit(0))).otherwise(0)


def search_data(pages: DataFrame, records: str = "records", status: str = "status") -> DataFrame:
    """Only the records of processed pages; pages that failed or hold none give no row."""
    return pages.where(is_success(F.col(status))).select(F.explode(records).alias("record"))


def lone_record(text: Column) -> Column:
    """JSON text: a list of one object is that object, anything else stays as it is."""
    only = F.try_variant_get(F.try_parse_json(text), "$[0]", "variant")
    is_object = F.coalesce(F.schema_of_variant(only).startswith("OBJECT"), F.lit(False))
    return F.when((F.json_array_length(text) == 1) & is_object, F.get_json_object(text, "$[0]")).otherwise(text)
