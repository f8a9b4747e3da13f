"""A prefix trie over paths: which leaves have leaves below them.

Each task inserts its paths into a trie and sends every node of it once, with the number of leaves that
end there and of those below; equal nodes of different tasks add up. What is shuffled are distinct
nodes of tasks, not leaves. A task's trie is sent and begun anew at ``NODES`` nodes, so its memory is bounded; nodes
that are sent twice only add up. Within one record no shuffle is needed at all (``leaves_above``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = 200_000
_SCHEMA = pa.schema([("path", pa.list_(pa.string())), ("n_here", pa.int64()), ("n_below", pa.int64())])


class Trie:
    """Nodes as nested dictionaries; at None stands the number of paths that end at a node."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def insert(self, path: list[str], times: int = 1) -> None:
        node = self.root
        for part in path:
            if part not in node:
                node[part] = {}
                self.size += 1
            node = node[part]
        node[None] = node.get(None, 0) + times

    def rows(self) -> Iterator[tuple[list[str], int, int]]:
        """Every node with the paths that end there and those that end below, the deepest first."""
        stack: list[tuple[list[str], dict]] = [([], self.root)]
        order = []
        while stack:
            path, node = stack.pop()
            order.append((path, node))
            stack += [([*path, part], child) for part, child in node.items() if part is not None]
        total: dict[int, int] = {}
        for path, node in reversed(order):
            below = sum(total[id(child)] for part, child in node.items() if part is not None)
            total[id(node)] = below + node.get(None, 0)
            if path:
                yield path, node.get(None, 0), below


def prefix_numbers(paths: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a batch of paths: their lengths, the number of each path, and for each depth (places of the paths that deep, numbers of their prefixes).

    Equal prefixes have equal numbers; the empty path has 0. Nothing is made for each path in Python.
    """
    lengths = pc.fill_null(pc.list_value_length(paths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = paths.flatten().dictionary_encode(null_encoding="encode")
    codes = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts, numbers, depths, known = np.cumsum(lengths) - lengths, np.zeros(len(paths), np.int64), [], 1
    for depth in range(int(lengths.max(initial=0))):
        deep = np.flatnonzero(lengths > depth)
        found, own = np.unique(numbers[deep] * len(parts.dictionary) + codes[starts[deep] + depth], return_inverse=True)
        numbers[deep] = known + own
        known += len(found)
        depths.append((deep, numbers[deep]))
    return lengths, numbers, depths


def above_others(paths: Column) -> Column:
    """Of the paths of one record, which are a proper prefix of another one: a boolean for each, in place."""

    @F.arrow_udf("array<boolean>")
    def above(records: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(records), 0).to_numpy(zero_copy_only=False)
        record = np.repeat(np.arange(len(records)), sizes)
        lengths, numbers, depths = prefix_numbers(records.flatten())
        span = int(numbers.max(initial=0)) + 1  # of a record's own numbers
        longer = [(deep[lengths[deep] > d + 1], own[lengths[deep] > d + 1]) for d, (deep, own) in enumerate(depths)]
        prefixes = np.concatenate([np.empty(0, np.int64), *(record[deep] * span + own for deep, own in longer)])
        flags = np.isin(record * span + numbers, prefixes) | (lengths == 0) & np.isin(record, record[lengths > 0])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flags, pa.bool_()))

    return above(paths)


_NUMBERED = re.compile(r"([a-zA-Z_.\-]*)([0-9]+)")


def _number_code(digits: str) -> str:
    bare = digits.lstrip("0") or "0"
    return "9" * (len(bare) // 9) + str(len(bare) % 9) + bare


def order_text(path: list[str | None]) -> str:
    """What ``paths.order_key`` gives for a path."""
    parts = [p for p in path if p is not None]
    coded = [f"'{m[1]}''{_number_code(m[2])}'" if (m := _NUMBERED.fullmatch(p)) else p for p in parts]
    return ".".join([_number_code(str(0 if path in ([], [""]) else len(path))), ".".join(coded)])


def natural_order(paths: Column) -> Column:
    """The paths of one record in their natural order (see ``paths.order_key``), in place; a key is made once for each distinct path of a batch."""

    @F.arrow_udf("array<array<string>>")
    def ordered(records: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(records), 0).to_numpy(zero_copy_only=False)
        flat = records.flatten()
        _, first, at = np.unique(prefix_numbers(flat)[1], return_index=True, return_inverse=True)
        keys = [order_text(p or []).encode() for p in flat.take(pa.array(first)).to_pylist()]
        rank = np.empty(len(keys), np.int64)
        rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
        order = np.lexsort((rank[at], np.repeat(np.arange(len(records)), sizes)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat.take(pa.array(order)))

    return ordered(paths)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        lengths, numbers, _ = prefix_numbers(batch.column(0))
        _, first, times = np.unique(numbers, return_index=True, return_counts=True)
        for path, n in zip(batch.column(0).take(pa.array(first)).to_pylist(), times.tolist(), strict=True):
            if path and None not in path:
                trie.insert(path, n)
            if trie.size >= NODES:
                yield _sent(trie)
                trie = Trie()
    if trie.size:
        yield _sent(trie)


def _sent(trie: Trie) -> pa.RecordBatch:
    columns = list(zip(*trie.rows(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def trie_nodes(frame: DataFrame, path: str = "path") -> DataFrame:
    """frame(path array<string>) -> (path, n_here, n_below) of every node of the trie of all paths; null paths and parts are left out."""
    made = frame.select(F.col(path).cast("array<string>")).mapInArrow(_nodes, "path array<string>, n_here long, n_below long")
    return made.groupBy("path").agg(F.sum("n_here").alias("n_here"), F.sum("n_below").alias("n_below"))


def insert_conflicts(frame: DataFrame, path: str = "path") -> DataFrame:
    """The paths that can't be inserted once the others are: leaves with leaves below them, and how many."""
    return trie_nodes(frame, path).where((F.col("n_here") > 0) & (F.col("n_below") > 0))


def leaves_above(paths: Column) -> Column:
    """Of the paths of one record, those that are a proper prefix of another one, each once and in order."""
    marked = F.filter(F.arrays_zip(paths.alias("path"), above_others(paths).alias("above")), lambda x: x["above"])
    return F.array_sort(F.array_distinct(F.transform(marked, lambda x: x["path"])))
