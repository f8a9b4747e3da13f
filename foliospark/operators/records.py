"""Operators over JSON records: filters, projections, extraction and full flattening.

A record is JSON text. Operators that need the structure of unknown JSON parse it once per
row in Arrow batches; all else is built-in functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import paths as P
from foliospark.functions.jsonpath import as_text as _text
from foliospark.functions.jsonpath import loaded as _loaded
from foliospark.functions.jsonpath import split_key, values_at
from foliospark.functions.scalars import collapse
from foliospark.operators.trie import above_others

# Keys that hold metadata, and parts of keys that mark a record.
METADATA_KEYS = ("metadata", "facets", "IdList")
RECORD_KEYS = ("title", "doi", "abstract")


def has_key(value: Any, test: Callable[[str], bool]) -> bool:
    """Whether a key at any depth, through lists, passes the test."""
    if isinstance(value, dict):
        return any(test(k) or has_key(v, test) for k, v in value.items())
    return isinstance(value, list) and any(has_key(v, test) for v in value)


def _test(keys: Iterable[str], regex: bool) -> Callable[[str], bool]:
    """Exact membership, or a regular expression for a whole key; empty keys match nothing."""
    wanted = [k for k in keys if k]
    if not regex:
        return set(wanted).__contains__
    patterns = [re.compile(k) for k in wanted]
    return lambda key: any(p.fullmatch(key) for p in patterns)


def key_exists(record: Column, keys: Iterable[str], *, regex: bool = False) -> Column:
    """Whether one of ``keys`` is a key of the record at any depth."""
    wanted = [k for k in keys if k]
    test = _test(wanted, regex)

    def holds(text: str | None) -> bool:
        if text is None or not regex and "\\" not in text and not any(f'"{k}"' in text for k in wanted):
            return False  # without escapes, a key that is there is there as it is written
        return has_key(_loaded(text), test)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(map(holds, texts.to_pylist()), pa.bool_())

    return found(record)


def filter_records(frame: DataFrame, record: str = "record", keep_keys: Iterable[str] | None = None, ignore_keys: Iterable[str] | None = None, *, regex: bool = True) -> DataFrame:
    """Rows with a key of ``keep_keys`` and none of ``ignore_keys``; no keys, no constraint."""
    if keep_keys:
        frame = frame.where(key_exists(F.col(record), keep_keys, regex=regex))
    if ignore_keys:
        frame = frame.where(~key_exists(F.col(record), ignore_keys, regex=regex))
    return frame


def select_paths(frame: DataFrame, keys: Mapping[str, str] | Iterable[str], record: str = "record", keep: Iterable[str] = (), delimiter: str | None = "; ") -> DataFrame:
    """Projection by path with rename: names -> paths, or paths that name themselves."""
    named = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys if k}
    keep = list(keep)
    read = frame.select(*keep, values_at(F.col(record), list(named.values())).alias("_v"))
    return read.select(*keep, *(collapse(F.get("_v", F.lit(i)), delimiter).alias(n) for i, n in enumerate(named)))


# --- extraction of records and metadata from a page ---


def explode_records(pages: DataFrame, path: str, content: str = "content", keep: Iterable[str] = ()) -> DataFrame:
    """The list at ``path`` as rows (record_idx, record); anything but a list gives no row."""
    target = F.get_json_object(F.col(content), "$" + "".join(f"['{k}']" for k in split_key(path)))
    items = F.when(target.startswith("["), F.from_json(target, "array<string>"))
    return pages.select(*keep, F.posexplode(items).alias("record_idx", "record"))


def page_metadata(pages: DataFrame, keys: Mapping[str, str], content: str = "content", keep: Iterable[str] = ()) -> DataFrame:
    """Metadata values at explicit paths, one column each; whole numbers in plain form."""
    from foliospark.functions.scalars import try_int

    keep = list(keep)
    return select_paths(pages, keys, content, keep).select(*keep, *(try_int(F.col(n)).alias(n) for n in keys))


def _is_record(value: Any, marks: tuple[str, ...]) -> bool:
    return isinstance(value, dict) and any(m in str(k) for k in value for m in marks)


def identify(page: Any, metadata_keys: tuple[str, ...] = METADATA_KEYS, record_keys: tuple[str, ...] = RECORD_KEYS) -> tuple[list, dict]:
    """Records and metadata of a parsed page, found by their shape."""
    records: list = []
    metadata: dict = {}

    def visit(value: Any, key: str) -> None:
        if key in metadata_keys:
            metadata[key] = value
        elif isinstance(value, dict):
            for k, v in value.items():
                visit(v, k)
        elif isinstance(value, list):
            if not value or not all(isinstance(v, dict) for v in value):
                return
            if len(value) > 1 or _is_record(value[0], record_keys):
                records.extend(value)
            else:
                for k, v in value[0].items():
                    visit(v, k)
        else:
            metadata[key] = value

    if isinstance(page, list):
        page = page[0] if len(page) == 1 and isinstance(page[0], dict) else {str(i): v for i, v in enumerate(page)}
    for k, v in page.items() if isinstance(page, dict) else ():
        visit(v, k)
    return records, metadata


def extract_dynamic(pages: DataFrame, content: str = "content", keep: Iterable[str] = ()) -> DataFrame:
    """Adds records array<string> and metadata map<string,string> (values as JSON text or plain scalars)."""

    @F.pandas_udf("records array<string>, metadata map<string,string>")
    def extract(texts: pd.Series) -> pd.DataFrame:
        found = [identify(_loaded(t)) for t in texts]
        return pd.DataFrame({"records": [[json.dumps(r, ensure_ascii=False) for r in rs] for rs, _ in found], "metadata": [{k: _text(v) for k, v in m.items()} for _, m in found]})

    return pages.select(*keep, extract(F.col(content)).alias("_x")).select(*keep, "_x.records", "_x.metadata")


# --- flattening ---


def leaves(value: Any, path: tuple = ()) -> Iterator[tuple[tuple, Any]]:
    """(path, value) of each leaf: a scalar or an empty container; list positions are ints."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    if not items or not value:
        yield path, value
        return
    for key, inner in items:
        yield from leaves(inner, (*path, key))


_NODE = "array<struct<path:array<string>,is_index:array<boolean>,ord:int,value:string,value_type:string>>"
_PLAIN = "array<struct<path:array<string>,ord:int,value:string>>"


def numbered(frame: DataFrame, name: str = "row") -> DataFrame:
    """Adds a number for each row, for operators that must tell records apart whose other columns may be equal."""
    return frame.withColumn(name, F.monotonically_increasing_id())


class _Shape:
    """The distinct paths of a batch as nested dictionaries; at a type stands the number of a leaf of that type, at None the path.

    Records of a table share their paths, so a path is made once for a batch and a leaf is its number.
    """

    def __init__(self) -> None:
        self.root: dict = {None: ()}
        self.kinds: list[tuple[tuple, type]] = []

    def walk(self, value: Any, node: dict, numbers: list[int], values: list | None) -> None:
        """Appends the number and the value of each leaf, as ``leaves`` has them; no values where there is no list for them."""
        if not value or not isinstance(value, (dict, list)):
            self.leaf(value, node, numbers, values)
            return
        for key, inner in value.items() if isinstance(value, dict) else enumerate(value):
            below = node.get(key)
            if below is None:
                below = node[key] = {None: (*node[None], key)}
            if inner and isinstance(inner, (dict, list)):
                self.walk(inner, below, numbers, values)
            else:
                self.leaf(inner, below, numbers, values)

    def leaf(self, value: Any, node: dict, numbers: list[int], values: list | None) -> None:
        kind = type(value)
        number = node.get(kind)
        if number is None:
            number = node[kind] = len(self.kinds)
            self.kinds.append((node[None], kind))
        numbers.append(number)
        if values is not None:
            values.append(value if kind is str else _text(value))


def _starts(ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of lists, and the place of each element in its list."""
    offsets = np.array([0, *ends], np.int32)
    return offsets, np.arange(offsets[-1], dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets))


def leaf_list(record: Column, max_depth: int | None = None) -> Column:
    """All leaves of a record in one array, in place: path, is_index, ord, value, value_type."""

    @F.arrow_udf(_NODE)
    def split(texts: pa.Array) -> pa.Array:
        shape, numbers, values, ends = _Shape(), [], [], []
        for value in map(_loaded, texts.to_pylist()):
            if value is not None:
                shape.walk(value, shape.root, numbers, values)
            ends.append(len(numbers))
        offsets, place = _starts(ends)
        at, texts_of = np.array(numbers, np.int64), pa.array(values, pa.string())
        if max_depth is not None:
            kept = np.array([len(p) <= max_depth for p, _ in shape.kinds], bool)[at]
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int32)
            at, place, texts_of = at[kept], place[kept], texts_of.filter(pa.array(kept))
        path = pa.array([[str(p) for p in path] for path, _ in shape.kinds], pa.list_(pa.string()))
        index = pa.array([[isinstance(p, int) for p in path] for path, _ in shape.kinds], pa.list_(pa.bool_()))
        kind = pa.array([k.__name__ for _, k in shape.kinds], pa.string())
        columns = [path.take(pa.array(at)), index.take(pa.array(at)), pa.array(place), texts_of, kind.take(pa.array(at))]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["path", "is_index", "ord", "value", "value_type"]))

    return split(record)


def nodes(frame: DataFrame, record: str = "record", keep: Iterable[str] = (), max_depth: int | None = None) -> DataFrame:
    """One row for each leaf of each record: path, is_index, ord, value, value_type."""
    return frame.select(*keep, F.explode(leaf_list(F.col(record), max_depth)).alias("n")).select(*keep, "n.*")


def short_name(path: tuple[str, ...], taken: set[str]) -> str:
    """The shortest suffix of a path that is not taken; a number behind the whole path if all are."""
    for n in range(1, len(path) + 1):
        name = ".".join(path[-n:])
        if name not in taken:
            return name
    base, k = ".".join(path), 1
    while f"{base}.{k}" in taken:
        k += 1
    return f"{base}.{k}"


def flat_fields(value: Any, delimiter: str = "; ", ignored: frozenset[str] = frozenset(), *, full_path: bool = True) -> dict[str, str | None]:
    """All leaves of one record: name -> values joined in order; null values are skipped, none is null."""
    found: dict[tuple[str, ...], list] = {}

    def walk(value: Any, path: tuple[str, ...]) -> None:
        if value and isinstance(value, dict):
            for k, v in value.items():
                if k not in ignored:
                    walk(v, (*path, k))
        elif value and isinstance(value, list):
            for v in value:
                walk(v, path)
        elif path:
            found.setdefault(path, []).append(value)

    walk(value, ())
    for path in [p for p in found if "value" in p]:  # the literal key says nothing, unless it is all there is
        if bare := tuple(p for p in path if p != "value"):
            found = _moved(found, path, bare)
    out: dict[str, str | None] = {}
    for path, values in found.items():
        name = ".".join(path) if full_path else short_name(path, set(out))
        out[name] = delimiter.join(_text(v) for v in values if v is not None) or None
    return out


def _moved(found: dict[tuple[str, ...], list], path: tuple[str, ...], to: tuple[str, ...]) -> dict[tuple[str, ...], list]:
    """The same entries in their order, with those of a path under another one."""
    moved: dict[tuple[str, ...], list] = {}
    for p, values in found.items():
        moved.setdefault(to if p == path else p, []).extend(values)
    return moved


def _maps(rows: Iterable[dict[str, str | None] | None]) -> pa.Array:
    return pa.array([None if r is None else list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))


def flatten_records(
    frame: DataFrame, record: str = "record", keep: Iterable[str] = (), delimiter: str = "; ", ignore_parts: Iterable[str] = (), *,
    keep_keys: Iterable[str] | None = None, ignore_keys: Iterable[str] | None = None, regex: bool = True, full_path: bool = True,
) -> DataFrame:
    """Each record's leaves as a map: index-free dotted path -> values joined in order; null values are skipped.

    One row for each record, in place, whatever ``keep`` holds; a null or broken record has a null map,
    an empty one an empty map. ``keep_keys`` and ``ignore_keys`` choose records by their keys;
    ignored keys, like ``ignore_parts``, also prune leaves below a part of that name. Without
    ``full_path`` a name is the shortest suffix that the record has not used yet.
    """
    kept, dropped = list(keep_keys or ()), list(ignore_keys or ())
    chosen = filter_records(frame, record, kept or None, dropped or None, regex=regex)
    ignored = frozenset([*ignore_parts, *dropped])

    @F.arrow_udf("map<string,string>")
    def flat(texts: pa.Array) -> pa.Array:
        values = map(_loaded, texts.to_pylist())
        return _maps(None if v is None else {} if v == {} else flat_fields(v, delimiter, ignored, full_path=full_path) for v in values)

    return chosen.select(*keep, flat(F.col(record)).alias("fields"))


def distinct_leaves(nodes_frame: DataFrame, keep: Iterable[str]) -> DataFrame:
    """One row for each (path without positions, value) of a record, with the first place of it."""
    keep = list(keep)
    plain = P.drop_parts(F.col("path"), F.col("is_index"), ())
    return nodes_frame.groupBy(*keep, plain.alias("path"), "value").agg(F.min("ord").alias("ord"))


def distinct_leaf_list(record: Column) -> Column:
    """What ``distinct_leaves`` gives for one record, in place and without a shuffle: path, ord, value."""

    @F.arrow_udf(_PLAIN)
    def split(texts: pa.Array) -> pa.Array:
        shape, plain = _Shape(), {}
        of_leaf, at, place, values, ends = [], [], [], [], []
        for value in map(_loaded, texts.to_pylist()):
            numbers, found = [], []
            if value is not None:
                shape.walk(value, shape.root, numbers, found)
            for path, _ in shape.kinds[len(of_leaf) :]:
                of_leaf.append(plain.setdefault(tuple(p for p in path if not isinstance(p, int)), len(plain)))
            first: dict[tuple, int] = {}
            for i, own in enumerate(zip(map(of_leaf.__getitem__, numbers), found, strict=True)):
                first.setdefault(own, i)
            at += [n for n, _ in first]
            values += [v for _, v in first]
            place += first.values()
            ends.append(len(at))
        path = pa.array(map(list, plain), pa.list_(pa.string())).take(pa.array(at, pa.int64()))
        columns = [path, pa.array(place, pa.int32()), pa.array(values, pa.string())]
        return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays(columns, ["path", "ord", "value"]))

    return split(record)


def is_nested_json(record: Column) -> Column:
    """Whether a value of the record is an object, or a list that holds a list, an object or text."""

    def nested(value: Any) -> bool:
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        return any(isinstance(v, dict) or isinstance(v, list) and any(isinstance(x, (dict, list, str)) for x in v) for v in inner)

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        return pa.array([nested(_loaded(t)) for t in texts.to_pylist()], pa.bool_())

    return test(record)


def to_wide(frame: DataFrame, names: Iterable[str], fields: str = "fields", keep: Iterable[str] = ()) -> DataFrame:
    """Chosen entries of a ragged map as columns; absent ones are null."""
    return frame.select(*keep, *(F.element_at(F.col(fields), n).alias(n.replace(".", "_")) for n in names))


def discover_keys(frame: DataFrame, record: str = "record") -> DataFrame:
    """key -> distinct index-free paths over all records, in the order in which they are first seen, with whether each is terminal.

    Each Arrow batch sends a key and path once, so what is shuffled follows the schema and not the data.
    """

    def walk(value: Any, path: tuple[str, ...]) -> Iterator[tuple[str, str, bool]]:
        if isinstance(value, dict):
            for k, v in value.items():
                inner = (*path, k)
                yield k, ".".join(inner), _terminal(v)
                yield from walk(v, inner)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v, path)

    def discover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list] = {}
            for row, text in zip(batch.column("row").to_pylist(), batch.column("record").to_pylist(), strict=True):
                for at, (key, path, terminal) in enumerate(walk(_loaded(text), ())):
                    own = seen.setdefault((key, path), [row, at, True])
                    own[2] &= terminal
            rows = [(k, p, t, r, a) for (k, p), (r, a, t) in seen.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "path", "terminal", "row", "at"])

    read = frame.select(F.monotonically_increasing_id().alias("row"), F.col(record).alias("record"))
    found = read.mapInArrow(discover, "key string, path string, terminal boolean, row long, at int")
    paths = found.groupBy("key", "path").agg(F.min(F.struct("row", "at")).alias("first"), F.bool_and("terminal").alias("terminal"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "path")))
    return paths.groupBy("key").agg(F.transform(ordered, lambda p: p["path"]).alias("paths"), F.bool_or("terminal").alias("terminal"))


def _terminal(value: Any) -> bool:
    return not isinstance(value, dict) and (not isinstance(value, list) or all(_terminal(v) for v in value))


def filter_keys(keys: DataFrame, *, prefix: str | None = None, min_length: int | None = None, substring: str | None = None, pattern: str | None = None, match: str = "any", include: bool = True) -> DataFrame:
    """Discovered keys by criteria combined by any or all; without criteria any keeps none and all keeps every key."""
    tests = []
    if prefix is not None:
        tests.append(F.col("key").startswith(prefix))
    if min_length is not None:
        tests.append(F.exists("paths", lambda p: F.size(F.split(p, r"\.")) >= min_length))
    if substring is not None:
        tests.append(F.exists("paths", lambda p: p.contains(substring)))
    if pattern is not None:
        tests.append(F.exists("paths", lambda p: F.exists(F.split(p, r"\."), lambda c: c.rlike(rf"\A(?:{pattern})\z"))))
    passed = F.lit(match == "all")
    for t in tests:
        passed = (passed & t) if match == "all" else (passed | t)
    return keys.where(passed if include else ~passed)


# --- path rows: names shared by the whole batch ---


def simplified_names(groups: Iterable[list[str]], max_parts: int = 1) -> dict[tuple[str, ...], str]:
    """Shortest informative suffix of each path group that is still free, in the order given."""
    taken: dict[str, tuple[str, ...]] = {}
    names: dict[tuple[str, ...], str] = {}
    for group in map(tuple, groups):
        parts = [p for p in group if not p.isdigit() and p not in P.UNINFORMATIVE] or list(group)
        for n in range(min(max_parts, len(parts)), len(parts) + 1):
            name = ".".join(parts[-n:])
            if name not in taken:
                break
        else:
            base, k = ".".join(parts), 1
            while (name := f"{base}._{k}") in taken:
                k += 1
        taken[name], names[group] = group, name
    return names


#: Distinct path groups up to which the names go to the workers with the code; beyond, records are joined with them.
MAX_GROUPS = 100_000


def _is_position(part: str | int) -> bool:
    return isinstance(part, int) or part.isascii() and part.isdigit()


def _group(path: tuple) -> tuple[str, ...]:
    """A path without a last list position, other positions made alike."""
    cut = path[:-1] if _is_position(path[-1]) else path
    return tuple("i" if _is_position(p) else p for p in cut)


def _sort_key(path: tuple) -> str:
    """Natural order: depth as text, then the parts with digits padded to 8."""
    return ".".join([str(len(path)), *(str(p).rjust(8, "0") if _is_position(p) else p for p in path)])


def _leaf_reader(find: Mapping[str, re.Pattern], texts: bool = True) -> tuple[list[tuple[tuple, type]], Callable[[str | None], tuple[Any, list[int], list]]]:
    """The leaf kinds (path, type) seen so far, and text -> value, numbers of its leaves in these, their texts if wanted; no leaves where the patterns fail.

    For the records of one Arrow batch: a path is searched by the patterns once for a batch, not once for each leaf.
    """
    shape = _Shape()
    found: dict[str, list[bool]] = {k: [] for k in find}

    def read(text: str | None) -> tuple[Any, list[int], list]:
        value, numbers, values = _loaded(text), [], []
        if not value or not isinstance(value, (dict, list)):
            return value, numbers, values  # no leaf but the record itself
        shape.walk(value, shape.root, numbers, values if texts else None)
        for k, flags in found.items():
            flags += (find[k].search(".".join(map(str, path))) is not None for path, _ in shape.kinds[len(flags) :])
        if "keep" in found and not any(map(found["keep"].__getitem__, numbers)) or "ignore" in found and any(map(found["ignore"].__getitem__, numbers)):
            return value, [], []
        return value, numbers, values

    return shape.kinds, read


def _groups(frame: DataFrame, record: str, find: Mapping[str, re.Pattern]) -> DataFrame:
    """The distinct path groups of all records that pass with the first path of each; each Arrow batch sends a group once."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, read = _leaf_reader(find, texts=False)
            used: set[int] = set()
            for text in batch.column(0).to_pylist():
                used.update(read(text)[1])
            first: dict[tuple[str, ...], str] = {}
            for path in {kinds[n][0] for n in used}:
                g, k = _group(path), _sort_key(path)
                if g not in first or k < first[g]:
                    first[g] = k
            yield pa.RecordBatch.from_arrays([pa.array(map(list, first), pa.list_(pa.string())), pa.array(first.values(), pa.string())], names=["grp", "k"])

    found = frame.select(F.col(record).cast("string").alias("record")).mapInArrow(search, "grp array<string>, k string")
    return found.groupBy("grp").agg(F.min("k").alias("k"))


def _joined(values: list, delimiter: str) -> str | None:
    return None if len(values) == 1 and values[0] is None else delimiter.join("None" if v is None else _text(v) for v in values)


def path_rows(frame: DataFrame, record: str = "record", keep: Iterable[str] = (), delimiter: str = "; ", keep_pattern: str | None = None, ignore_pattern: str | None = None, *, regex: bool = True) -> DataFrame:
    """Records as maps of short names -> values as text; names are chosen over the whole batch.

    One row for each record, in place, whatever ``keep`` holds; a null or broken record has a null map.
    A record stays if one of its paths has the keep pattern and none the ignore pattern (searched in the dotted
    path, or as plain text without ``regex``). The names follow the schema, not the data: one task makes them.
    """
    find = {k: re.compile(p if regex else re.escape(p)) for k, p in (("keep", keep_pattern), ("ignore", ignore_pattern)) if p is not None}

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [g for batch in batches for g in batch.column("grp").to_pylist()]
        made = simplified_names(groups)
        yield pa.RecordBatch.from_arrays([pa.array([list(g) for g in made], pa.list_(pa.string())), pa.array(list(made.values()), pa.string())], names=["grp", "name"])

    # the names come from one reading of all records, which applies the patterns itself
    named = _groups(frame, record, find).orderBy("k", F.array_join("grp", ".")).coalesce(1).mapInArrow(name, "grp array<string>, name string")
    if find:

        @F.arrow_udf("boolean")
        def kept(texts: pa.Array) -> pa.Array:
            _, read = _leaf_reader(find, texts=False)
            return pa.array([bool(numbers) or "keep" not in find and value in (None, {}, []) for value, numbers, _ in map(read, texts.to_pylist())], pa.bool_())

        frame = frame.where(kept(F.col(record)))
    some = named.limit(MAX_GROUPS + 1).collect()
    if len(some) > MAX_GROUPS:
        return _joined_rows(frame, record, list(keep), delimiter, named, find)
    names = {tuple(r["grp"]): r["name"] for r in some}

    @F.arrow_udf("map<string,string>")
    def rows(texts: pa.Array) -> pa.Array:
        kinds, read = _leaf_reader(find)
        out, of_leaf = [], []
        for value, numbers, values in map(read, texts.to_pylist()):
            of_leaf += (names.get(_group(path)) for path, _ in kinds[len(of_leaf) :])
            cells: dict[str, list] = {}
            for n, v in zip(numbers, values, strict=True):
                cells.setdefault(of_leaf[n], []).append(v)
            out.append(None if value is None else {n: _joined(v, delimiter) for n, v in cells.items()})
        return _maps(out)

    return frame.select(*keep, rows(F.col(record)).alias("fields"))


def _joined_rows(frame: DataFrame, record: str, keep: list[str], delimiter: str, named: DataFrame, find: Mapping[str, re.Pattern]) -> DataFrame:
    """The same where the names are too many to send: leaves meet their names in a join and return to their record by a row number."""

    @F.arrow_udf("array<struct<grp:array<string>,ord:int,value:string>>")
    def cells(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("grp", pa.list_(pa.string())), ("ord", pa.int32()), ("value", pa.string())]))
        kinds, read = _leaf_reader(find)
        out = []
        for value, numbers, values in map(read, texts.to_pylist()):
            out.append(None if value is None else [{"grp": list(_group(kinds[n][0])), "ord": i, "value": v} for i, (n, v) in enumerate(zip(numbers, values, strict=True))])
        return pa.array(out, kind)

    numbered = frame.select(*keep, F.monotonically_increasing_id().alias("_row"), cells(F.col(record)).alias("_cells"))
    flat = numbered.select("_row", F.explode("_cells").alias("c")).select("_row", "c.*").join(named, "grp")
    listed = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("value", F.lit("None")).alias("value"), F.col("value").isNull().alias("null"))))
    by_name = flat.groupBy("_row", "name").agg(listed.alias("v"))
    value = F.when((F.size("v") == 1) & F.col("v")[0]["null"], F.lit(None)).otherwise(F.array_join(F.transform("v", lambda x: x["value"]), delimiter))
    fields = by_name.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("name", value.alias("value")))).alias("fields"))
    none = F.when(F.col("_cells").isNotNull(), F.expr("cast(map() as map<string,string>)"))
    return numbered.join(fields, "_row", "left").select(*keep, F.coalesce("fields", none).alias("fields"))


def combine_counts(nodes_frame: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Pairs a ``count`` leaf with its one ``value`` sibling: value -> count under the value's path.

    Rows that take part are replaced by one row whose path is the value's path, the value and
    ``count``; numeric values are quoted. ``keep`` must tell records apart (see ``numbered``).
    """
    from foliospark.functions.scalars import quote_numeric

    keep = list(keep)
    rows = nodes_frame.withColumn("_leaf", F.element_at("path", -1)).withColumn("_up", P.parent(F.col("path")))
    counts = rows.where((F.col("_leaf") == "count") & F.array_join("path", ".").rlike(r"values?.*count$"))
    values = rows.where(F.col("_leaf").isin("value", "values"))
    single = values.groupBy(*keep, "_up").agg(F.count("*").alias("_n"), F.min("value").alias("_value"), F.min(F.struct("ord", "path")).alias("_at")).where("_n = 1")
    pairs = counts.join(single, [*keep, "_up"])
    made = pairs.select(
        *keep,
        F.concat(F.col("_at.path"), F.array(quote_numeric(F.col("_value"))), F.array(F.lit("count"))).alias("path"),
        F.concat(F.transform(F.col("_at.path"), lambda p: P.is_index(p)), F.array(F.lit(False), F.lit(False))).alias("is_index"),
        F.col("_at.ord").alias("ord"),
        "value",
        "value_type",
    )
    used = pairs.select(*keep, "_up").distinct()
    rest = rows.join(used.withColumn("_used", F.lit(True)), [*keep, "_up"], "left").where(F.col("_used").isNull() | ~F.col("_leaf").isin("value", "values", "count"))
    return rest.select(*made.columns).unionByName(made)


def deepest_only(nodes_frame: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Without rows whose path is a proper prefix of another of the same record; ``keep`` must tell records apart (see ``numbered``).

    The rows of a record meet once; where they are still in one array, ``deepest`` needs no shuffle.
    """
    keep = list(keep)
    rest = [c for c in nodes_frame.columns if c not in keep]
    gathered = nodes_frame.groupBy(*keep).agg(F.collect_list(F.struct(*rest)).alias("_rows"))  # the nodes of one record
    above = above_others(F.transform("_rows", lambda r: r["path"]))
    rows = gathered.select(*keep, F.explode(F.arrays_zip(F.col("_rows").alias("row"), above.alias("above"))).alias("_n"))
    return rows.where(~F.col("_n.above") | (F.size("_n.row.path") == 0)).select(*keep, "_n.row.*").select(*nodes_frame.columns)


def deepest(paths: Column) -> Column:
    """Of the paths of one record, those that are no proper prefix of another one, in place; the empty path is no part of others here, as in ``paths.ancestors``."""
    marked = F.filter(F.arrays_zip(paths.alias("path"), above_others(paths).alias("above")), lambda x: ~x["above"] | (F.size(x["path"]) == 0))
    return F.transform(marked, lambda x: x["path"])
