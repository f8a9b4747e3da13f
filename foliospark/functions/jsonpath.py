"""Reading values out of JSON text by path, with lists fanned out.

Records are JSON text, which keeps key order and absent keys. A value is an array of
strings: text as it is, other scalars as Python prints them, objects as JSON text. One Arrow
pass parses each record once, however many paths are read; built-in functions would parse
it again for each step of each path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Path = str | Sequence[str | int]


def split_key(path: Path) -> list[str | int]:
    """Dotted text, or a list of keys (text) and list positions (int)."""
    if isinstance(path, str):
        return path.split(".")
    if isinstance(path, (list, tuple)):
        return list(path)
    raise TypeError(f"not a path: {path!r}")


def loaded(text: str | None) -> Any:
    """The parsed text; None if it is none."""
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def as_text(value: Any) -> str | None:
    """A scalar as Python prints it, a container as JSON; None stays None."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, (dict, list)) else str(value)


def _fan_out(values: list) -> Iterator[Any]:
    """Elements of lists in place of the lists, without None."""
    for v in values:
        if isinstance(v, list):
            yield from (x for x in v if x is not None)
        elif v is not None:
            yield v


def values_in(record: Any, path: Sequence[str | int]) -> list:
    """All values at a path; every list on the way, and at its end, is fanned out."""
    values = [record]
    for key in path:
        if isinstance(key, int):
            values = [v[key] for v in values if isinstance(v, list) and 0 <= key < len(v)]
        else:
            values = [v[key] for v in _fan_out(values) if isinstance(v, dict) and key in v]
    return list(_fan_out(values))


def flat_or_nested(record: Any, path: Path, steps: Sequence[str | int]) -> list:
    """The value of a flat dotted key if the record has it, else those at the path."""
    if isinstance(path, str) and len(steps) > 1 and isinstance(record, dict) and record.get(path) is not None:
        return list(_fan_out([record[path]]))
    return values_in(record, steps)


def nested_lists(rows: list[list[list]]) -> pa.Array:
    """array<array<string>> from the values of each slot of each record."""
    outer = np.cumsum([0, *(len(r) for r in rows)], dtype=np.int32)
    inner = np.cumsum([0, *(len(s) for r in rows for s in r)], dtype=np.int32)
    flat = pa.array([as_text(v) for r in rows for s in r for v in s], pa.string())
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), flat))


def values_at(record: Column, paths: Sequence[Path], *, flat: bool = True) -> Column:
    """One array of values for each path, from one parse; ``flat`` tries a whole dotted key first."""
    read = flat_or_nested if flat else (lambda value, _, steps: values_in(value, steps))
    split = [(p, split_key(p)) for p in paths]

    @F.arrow_udf("array<array<string>>")
    def values(texts: pa.Array) -> pa.Array:
        return nested_lists([[read(value, p, steps) for p, steps in split] for value in map(loaded, texts.to_pylist())])

    return values(record)


#: How many empty texts give way to a default: none (only absence does), a lone one, any number.
NO_TEXT, ONE_TEXT, ANY_TEXT = 0, 1, 2


def fields_by(kind: Column, record: Column, fields: Mapping[str, Sequence[tuple[Sequence[Path], Sequence[str], int]]]) -> Column:
    """One array of values for each output field: those at the first path of the record's kind that has any.

    ``fields`` has for each kind, in the order of the output, the paths of a field, its defaults (the first counts; none is allowed), and which
    empty texts give way to the default. Records of other kinds have no fields. All
    choices fall here, so a plan holds one expression a field, whatever the number of kinds.
    """
    plans = {k: [([(p, split_key(p)) for p in paths], list(defaults)[:1], blank) for paths, defaults, blank in own] for k, own in fields.items()}

    def chosen(value: Any, paths: list, default: list[str], blank: int) -> list:
        found = next((v for v in (flat_or_nested(value, p, steps) for p, steps in paths) if v), [])
        empty = not found or blank >= ONE_TEXT and found == [""] or blank == ANY_TEXT and all(v == "" for v in found)
        return default if empty and default else found

    @F.arrow_udf("array<array<string>>")
    def values(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        return nested_lists([[chosen(value, *field) for field in plans.get(k, ())] for k, value in zip(kinds.to_pylist(), map(loaded, texts.to_pylist()), strict=True)])

    return values(kind, record)


def path_values(record: Column, path: Path) -> Column:
    """All values at a path; every list on the way, and at its end, is fanned out."""
    return F.get(values_at(record, [path], flat=False), F.lit(0))


def extract_key(record: Column, path: str) -> Column:
    """The value of a flat dotted key if the record has it, else that at the path (a list of one dictionary on the way is entered)."""
    return F.get(values_at(record, [path]), F.lit(0))


def top_keys(record: Column, pattern: str | None = None) -> Column:
    """Top-level keys in order; with a pattern, those that it matches whole."""
    keys = F.coalesce(F.json_object_keys(record), F.expr("cast(array() as array<string>)"))
    return keys if pattern is None else F.filter(keys, lambda k: k.rlike(rf"\A(?:{pattern})\z"))
