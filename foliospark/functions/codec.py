"""JSON, binary and encrypted forms of values, small conversions, and fingerprints of configurations."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.jsonpath import loaded

# Fixed value: what marks text that stands for bytes.
PREFIX = "<hashbytes>"
_dumped = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def serialise(**columns: Column) -> Column:
    """JSON text of the columns; binary ones as marked base64 (see ``encode_bytes``)."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())), {"ignoreNullFields": "false"})


def deserialise(text: Column, schema: str) -> Column:
    """The struct back; null for what is no JSON."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def _decoded(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _decoded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_decoded(v) for v in value]
    if isinstance(value, str) and value.startswith(PREFIX):
        body = value[len(PREFIX) :]
        if not body.isdigit():
            try:
                return base64.b64decode(body, validate=True).decode("utf-8")
            except (binascii.Error, UnicodeDecodeError):
                return value
    return value


def _encoded(value: Any, keys: frozenset[str]) -> Any:
    if isinstance(value, dict):
        return {k: PREFIX + base64.b64encode(v.encode()).decode() if k in keys and isinstance(v, str) else _encoded(v, keys) for k, v in value.items()}
    return [_encoded(v, keys) for v in value] if isinstance(value, list) else value


def encode_tree(record: Column, *keys: str) -> Column:
    """JSON text with the text under ``keys``, at any depth, as marked base64."""
    wanted = frozenset(keys)

    @F.arrow_udf("string")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _dumped(_encoded(loaded(t), wanted)) for t in texts.to_pylist()], pa.string())

    return encode(record)


def decode_tree(record: Column) -> Column:
    """JSON text with every marked base64 of UTF-8, at any depth, in plain; what doesn't decode stays."""

    @F.arrow_udf("string")
    def decode(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _dumped(_decoded(loaded(t))) for t in texts.to_pylist()], pa.string())

    return decode(record)


def encrypted(text: Column, key: Column) -> Column:
    """Authenticated encryption (AES-GCM) with a key of 16, 24 or 32 bytes, as base64."""
    return F.base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT")))


def decrypted(text: Column, key: Column) -> Column:
    """The text back; null if the key or the text is wrong."""
    return F.try_aes_decrypt(F.unbase64(text), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def try_dict(values: Column) -> Column:
    """A list as a map of its positions."""
    return F.when(F.size(values) > 0, F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: i.cast("string")), values)).otherwise(F.map_from_arrays(F.expr("cast(array() as array<string>)"), F.slice(values, 1, 0)))


def is_nested(value: Column) -> Column:
    """Whether JSON text is an object or a list."""
    return F.coalesce(F.ltrim(value).rlike(r"\A[\[{]") & F.try_parse_json(value).isNotNull(), F.lit(False))


def get_values(record: Column) -> Column:
    """The values of an object, in the order of its keys."""
    return F.map_values(F.from_json(record, "map<string,string>"))


def try_pop(values: Column, value: Column, default: Column | None = None) -> tuple[Column, Column]:
    """The list without a value, and the value if it was there, else the default."""
    return F.array_remove(values, value), F.when(F.array_contains(values, value), value).otherwise(default if default is not None else F.lit(None))


def fingerprint_text(text: str) -> str:
    """A description without what changes from run to run: addresses, numbers and white space."""
    return re.sub(r"\s+", " ", re.sub(r"\b\d+(?:\.\d+)?\b", "*", re.sub(r"0x[0-9A-Fa-f]+", "*", text))).strip()


def schema_fingerprint(version: str, *parts: object) -> str:
    """A hash of the version and of the parser, extractor and processor that made a cached result."""
    described = [getattr(p, "__qualname__", None) or repr(p) for p in parts]
    return hashlib.sha256("\n".join([version, *map(fingerprint_text, described)]).encode()).hexdigest()
