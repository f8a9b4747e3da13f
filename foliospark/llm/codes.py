"""Vector code compression: product codes trained by heap Lloyd rounds.

A vector is cut into ``PARTS`` parts, and each part position has its own codebook. For every part
a task knows an upper bound ``u`` of the distance to its entry and a lower bound ``l`` to any other
entry. When codebooks move, ``u`` grows by the drift of the own entry at most and ``l`` shrinks by
the largest drift of another one. So the slack ``l - u`` of all parts of one entry shrinks by the
same amount, and a heap for each entry, keyed by the slack plus what the entry had drifted when
the part was pushed, tells by its top alone whether any part needs a look. Each round pops the
parts whose key the entry's cumulative drift has reached and compares just those with all entries,
exactly; all others keep their entry without being touched. Bounds are held with a margin for rounding, and a slack
of zero counts as violated, so ties are always decided by an exact comparison, for the lower index.

The heaps of a task are local to blocks of ``BLOCK`` vectors. A round reads the written state (integers,
codes and keys of a vector side by side), builds the heaps, and writes the next state; next to it each task
writes what its changes add to and take from the sums of entries, so that later rounds add up changes
only. These rows go through a ``groupBy`` to the driver, one for each entry (``PARTS * ENTRIES`` at
most). A lost executor repeats its tasks from the last state. The table before is deleted once the next is written.

Defined cases: vectors that are null or have null, NaN or infinite components are left out; all
others must have the length of the one of the smallest id (rows of another length, or of one that can't be cut
evenly, are left out); fewer vectors than ``ENTRIES`` make smaller codebooks; equal entries leave
the higher index unused, and unused entries stay; rows of equal ids are rows of their own, ordered by their vectors where
the start needs an order, null ids last; an empty table gives no rows and the hash of no entries; extra columns are ignored.
Distances are exact for any size of numbers; one beyond a long is an error.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch, lists
from foliospark.llm.vectors import column_sums, finite, matrix, safe, scaled

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024
#: Vectors whose heaps are held at a time, and parts compared with all entries at a time.
BLOCK, CHUNK = 16_384, 4096
#: Relative margin of bounds, far above the rounding of square roots and sums of drifts.
MARGIN = 1e-9

STATE = "vec_id long, label int, vector array<long>, codes array<int>, keys array<double>, error long, part int, entry int, n long, sums array<long>"


def rescan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the nearest entry (lowest index on ties), and the distances to it and to the next one."""
    best, near, second = np.empty(len(points), np.int64), np.empty(len(points)), np.full(len(points), np.inf)
    exact = safe(points, entries, 1 << 53)  # then float64 holds every square and sum as an integer
    e = entries.astype(np.float64 if exact else object)
    for at in range(0, len(points), CHUNK):
        p = points[at : at + CHUNK].astype(e.dtype)
        squares = (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]
        rows, part = np.arange(len(p)), slice(at, at + len(p))
        best[part] = first = squares.argmin(axis=1)
        near[part] = np.sqrt(squares[rows, first].astype(np.float64))
        if len(e) > 1:
            squares[rows, first] = squares.max() + 1
            second[part] = np.sqrt(squares.min(axis=1).astype(np.float64))
    return best, near, second


def violated(codes: np.ndarray, keys: np.ndarray, drifted: np.ndarray) -> np.ndarray:
    """Pops the points whose key the drift of their entry has reached, from one heap for each entry."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in drifted]
    for row, (code, key) in enumerate(zip(codes.tolist(), keys.tolist(), strict=True)):
        heaps[code].append((key, row))
    popped = []
    for heap, limit in zip(heaps, drifted.tolist(), strict=True):
        heapq.heapify(heap)
        while heap and heap[0][0] <= limit:
            popped.append(heapq.heappop(heap)[1])
    return np.sort(np.array(popped, np.int64))


class Changes:
    """What a task's new codes add to and take from the sums of the entries (one row an entry, whatever the task reads)."""

    def __init__(self) -> None:
        self.table: dict[tuple[int, int], tuple[int, list[int]]] = {}

    def add(self, part: int, codes: np.ndarray, points: np.ndarray, sign: int) -> None:
        if not len(codes):
            return
        order = np.argsort(codes, kind="stable")
        found, heads = np.unique(codes[order], return_index=True)
        for code, rows in zip(found.tolist(), np.split(order, heads[1:]), strict=True):
            n, sums = self.table.get((part, code), (0, [0] * points.shape[1]))
            more = column_sums(points[rows])
            self.table[part, code] = (n + sign * len(rows), [a + sign * b for a, b in zip(sums, more, strict=True)])

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(part, entry, n, sums) for (part, entry), (n, sums) in self.table.items()]
        columns = dict(zip(("part", "entry", "n", "sums"), zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in schema], schema=schema)


_SCHEMA = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int32()), ("vector", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32())), ("keys", pa.list_(pa.float64())), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]
)


def _round(books: np.ndarray, drifted: np.ndarray, first: bool, last: bool):
    """One assignment; ``books`` is (part, entry, position), ``drifted`` (part, entry) since the start."""
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = Changes()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(at, BLOCK), changes)
        if changes.table:
            yield changes.batch(_SCHEMA)

    def block(rows: pa.RecordBatch, changes: Changes) -> pa.RecordBatch:
        vectors = matrix(rows.column("vector"))
        size = len(vectors)
        codes = np.zeros((size, parts), np.int64) if first else matrix(rows.column("codes")).astype(np.int64)
        keys = np.zeros((size, parts)) if first else matrix(rows.column("keys")).copy()
        error = [0] * size
        for p in range(parts):
            points = vectors[:, p * width : (p + 1) * width]
            due = np.arange(size) if first else violated(codes[:, p], keys[:, p], drifted[p])
            best, near, second = rescan(points[due], books[p])
            moved = due if first else due[best != codes[due, p]]
            if not first and not last:
                changes.add(p, codes[moved, p], points[moved], -1)
            codes[due, p] = best
            keys[due, p] = second * (1 - MARGIN) - near * (1 + MARGIN) + drifted[p][best]
            if last:
                gap = points.astype(object) - books[p][codes[:, p]] if not safe(points, books[p], 1 << 63) else points - books[p][codes[:, p]]
                error = [a + b for a, b in zip(error, (gap * gap).sum(axis=1).tolist(), strict=True)]
            else:
                changes.add(p, codes[moved, p], points[moved], 1)
        columns = {"vec_id": rows.column("vec_id"), "label": rows.column("label"), "codes": lists(list(codes), pa.int32())}
        if last:
            columns["error"] = pa.array(error, pa.int64())
        else:
            columns |= {"vector": rows.column("vector"), "keys": lists(list(keys), pa.float64())}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCHEMA], schema=_SCHEMA)

    return assign


def moved_books(books: np.ndarray, counts: np.ndarray, sums: np.ndarray, drifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks of the means, and the cumulative drift of each entry with the largest of another one."""
    moved = books.astype(object)
    used = counts > 0
    moved[used] = sums[used] // counts[used][:, None]
    gap = moved - books.astype(object)
    drift = np.sqrt((gap * gap).sum(axis=2).astype(np.float64)) * (1 + MARGIN)
    others = np.zeros_like(drift)
    if drift.shape[1] > 1:
        top = np.sort(drift, axis=1)
        others = np.where(drift == top[:, -1:], np.where((drift == top[:, -1:]).sum(axis=1, keepdims=True) > 1, top[:, -1:], top[:, -2:-1]), top[:, -1:])
    return moved.astype(np.int64), (drifted + drift + others) * (1 + MARGIN)


def compress_vectors(embeddings: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, label) -> rows(vec_id, label, codes, error) and the codebooks (part, entry, position)."""
    spark = embeddings.sparkSession
    kept = embeddings.where(finite("embedding") & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), scaled("embedding", factor).alias("vector"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    one = rows.orderBy(*order).select("vector").first()
    if one is None:
        return spark.createDataFrame([], "vec_id long, label int, codes array<int>, error long"), np.empty((parts, 0, 0), np.int64)
    dim = len(one[0])
    rows = rows.where(F.size("vector") == dim)
    firsts = np.array([r[0] for r in rows.orderBy(*order).select("vector").limit(entries).collect()], np.int64)
    books = firsts.reshape(len(firsts), parts, dim // parts).swapaxes(0, 1)
    counts, sums, drifted = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object), np.zeros(books.shape[:2])
    added = [F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim // parts))]
    scratch, state = Scratch(spark, "codes"), rows
    for r in range(rounds + 1):
        after = scratch.keep(state.mapInArrow(_round(books, drifted, r == 0, r == rounds), STATE), f"round{r}")
        if r:
            scratch.drop(state_table)
        state_table, state = after, after.where(F.col("part").isNull())
        if r < rounds:
            for c in after.where(F.col("part").isNotNull()).groupBy("part", "entry").agg(*added).collect():
                counts[c["part"], c["entry"]] += c["n"]
                sums[c["part"], c["entry"]] += np.array(c[3:], object)
            books, drifted = moved_books(books, counts, sums, drifted)
    return state.select("vec_id", "label", "codes", "error"), books


def with_digests(found: DataFrame, books: np.ndarray) -> DataFrame:
    """The code as hexadecimal text, errors by label and the hash of the codebooks.

    Labels are added up before they are shuffled; that table is small or large as the labels are many, so the join is left
    to the run's own sizes: broadcast if it is small, else sorted with hot labels split.
    """
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    labels = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = found.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> str:
    """The same in DuckDB SQL: every round compares every part with every entry."""
    bad = "x IS NULL OR NOT isfinite(x)"
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: {bad})) = 0)",
        f"parts AS (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) AS t(p))",
        f"c0 AS (SELECT p, k, v AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    # integers below 2^53, so sums of doubles are exact
    distance = "CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT)"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, p, any_value(label) AS label, any_value(v) AS v, min({{'d': {distance}, 'k': k}}) AS best FROM parts JOIN c{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, k, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT p, best.k AS k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL))")
            steps.append(f"m{r} AS (SELECT p, k, list(x ORDER BY i) AS c FROM s{r} GROUP BY p, k)")
            steps.append(f"c{r + 1} AS (SELECT p, k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, k))")
    steps.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded CROSS JOIN digest"
