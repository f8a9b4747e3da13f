"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of each sliding window of ``window - k + 1``
k-grams (every position that ties for it). Any shared span of ``window`` words or more
then has a fingerprint in common at the same place, so joining the fingerprints and
extending each hit word by word finds every such span. Items shorter than ``window``
words have no winnowing window; their whole word sequence is looked up at every place.

Documents stay where they are: the fingerprints of the benchmark are the broadcast side
of the join, in blocks of ``block_bytes`` of item text at most, so neither the driver nor a
worker ever holds more than one block. A larger benchmark takes several passes, whose
spans are united per document.

Defined cases: null texts have no words; an item without words has no window; items of
equal words are all reported; an item without an id marks words but is not listed; extra
columns are ignored; a document row is one row out, also when its id repeats or is null.
Words are compared by their 64-bit XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WordHashes, inside, lists, rolling, runs, slices, sliding_min, texts_of

WINDOW, KGRAM = 10, 5
BLOCK_BYTES = 8 << 20

#: Word characters are 0-9, a-z (A-Z lowered) and all bytes beyond ASCII.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SCHEMA = "doc_id long, text_key long, n_words long, span_starts array<long>, span_ends array<long>, item_ids array<long>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def winnowed(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept; items lie one after the other in ``symbols``."""
    width = window - k + 1
    grams = rolling(symbols, k)
    low = sliding_min(grams, width)
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    valid = inside(starts, lengths, window, len(symbols))[: len(low)]
    kept = np.zeros(len(grams), bool)
    for shift in range(width):
        kept[shift : shift + len(low)] |= valid & (grams[shift : shift + len(low)] == low)
    at = np.flatnonzero(kept)
    return at, grams[at]


class Index:
    """Fingerprints of one block of benchmark items; equal word sequences are stored once."""

    def __init__(self, items: list[tuple[int | None, bytes]], k: int, window: int) -> None:
        known: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        arrays, cache = [], WordHashes()
        for item_id, text in items:
            words = cache.array(words_of(text))
            if not len(words):
                continue
            at = known.setdefault(words.tobytes(), len(arrays))
            if at == len(arrays):
                arrays.append(words)
                self.ids.append([])
            if item_id is not None:
                self.ids[at].append(item_id)
        self.k, self.window = k, window
        lengths = np.array([len(x) for x in arrays], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.words = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        at, hashes = winnowed(self.words, self.starts, lengths, k, window)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        for size in np.unique(lengths[lengths < window]).tolist():
            which = np.flatnonzero(lengths == size)
            keys = np.array([rolling(arrays[i], size)[0] for i in which], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.short.append((size, keys[order], which[order]))

    def hits(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Marks of the words hit, and the items of each document (by position) with hits."""
        marked, found = np.zeros(len(words), bool), {}
        at, hashes = winnowed(words, starts, lengths, self.k, self.window)
        if len(self.hashes) and len(at):
            low = np.searchsorted(self.hashes, hashes)
            same = self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes
            at, low = at[same], low[same]
            high = np.searchsorted(self.hashes, hashes[same], side="right")
            docs = np.searchsorted(starts, at, side="right") - 1
            reached: dict[tuple[int, int], int] = {}
            for p, a, b, d in zip(at.tolist(), low.tolist(), high.tolist(), docs.tolist(), strict=True):
                for q in self.at[a:b].tolist():
                    if reached.get((p - q, d), -1) >= p:
                        continue
                    item = int(np.searchsorted(self.starts, q, side="right")) - 1
                    left, right = self.extended(words, p, q, starts[d], starts[d] + lengths[d], item)
                    reached[(p - q, d)] = right - 1
                    if right - left >= self.window:
                        marked[left:right] = True
                        found.setdefault(d, set()).add(item)
        for size, keys, which in self.short:
            grams = rolling(words, size)
            low = np.searchsorted(keys, grams)
            same = np.flatnonzero((keys[np.minimum(low, len(keys) - 1)] == grams) & inside(starts, lengths, size, len(words))[: len(grams)])
            docs = np.searchsorted(starts, same, side="right") - 1
            for p, i, d in zip(same.tolist(), which[low[same]].tolist(), docs.tolist(), strict=True):
                if (words[p : p + size] == self.words[self.starts[i] : self.ends[i]]).all():
                    marked[p : p + size] = True
                    found.setdefault(d, set()).add(i)
        return marked, found

    def extended(self, words: np.ndarray, p: int, q: int, first: int, last: int, item: int) -> tuple[int, int]:
        """The longest common span around the words at p and q."""
        back = min(p - first, q - self.starts[item])
        unlike = np.flatnonzero(words[p - back : p] != self.words[q - back : q])
        left = p - back + (int(unlike[-1]) + 1 if len(unlike) else 0)
        ahead = min(last - p, self.ends[item] - q)
        unlike = np.flatnonzero(words[p : p + ahead] != self.words[q : q + ahead])
        return left, p + (int(unlike[0]) if len(unlike) else ahead)


def _scan(index) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, block = WordHashes(), index.value
        for batch in slices(batches):
            arrays = [cache.array(words_of(t)) for t in texts_of(batch)]
            lengths = np.array([len(x) for x in arrays], np.int64)
            starts = np.cumsum(lengths) - lengths
            full = np.flatnonzero(lengths)
            marked, found = block.hits(np.concatenate(arrays), starts[full], lengths[full])
            found = {int(full[d]): items for d, items in found.items()}
            spans = [runs(marked[s : s + n]) if d in found else (np.empty(0, np.int64),) * 2 for d, (s, n) in enumerate(zip(starts, lengths, strict=True))]
            ids = [np.array(sorted({x for i in found.get(d, ()) for x in block.ids[i]}), np.int64) for d in range(len(arrays))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(lengths, pa.int64()), lists([x[0] for x in spans], pa.int64()), lists([x[1] for x in spans], pa.int64()), lists(ids, pa.int64())],
                names=["doc_id", "text_key", "n_words", "span_starts", "span_ends", "item_ids"],
            )

    return scan


def _keep_clean(index) -> callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, block = WordHashes(), index.value
        for batch in slices(batches):
            arrays = [cache.array(words_of(t)) for t in texts_of(batch)]
            lengths = np.array([len(x) for x in arrays], np.int64)
            full = np.flatnonzero(lengths)
            marked, _ = block.hits(np.concatenate(arrays), (np.cumsum(lengths) - lengths)[full], lengths[full])
            hit = np.zeros(len(arrays), bool)
            hit[np.unique(np.repeat(np.arange(len(arrays)), lengths)[marked])] = True
            yield batch.filter(pa.array(~hit))

    return keep


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks, read through the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text")).toLocalIterator():
        text = (row[1] or "").encode("utf-8", "surrogatepass")
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    yield block


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = KGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents(doc_id, text) against benchmark(item_id, text): word spans hit and the items found, per document."""
    spark = documents.sparkSession
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    passes = [narrow.mapInArrow(_scan(spark.sparkContext.broadcast(Index(block, k, window))), SCHEMA) for block in _blocks(benchmark, block_bytes)]
    if len(passes) == 1:
        return passes[0]
    return _united(documents, passes, window, k)


def _united(documents: DataFrame, passes: list[DataFrame], window: int, k: int) -> DataFrame:
    """One row per document from the rows of several passes; only rows with hits are gathered."""
    every = passes[0].unionByName(passes[1])
    for more in passes[2:]:
        every = every.unionByName(more)
    spans = F.arrays_zip("span_starts", "span_ends")
    merged = every.groupBy("doc_id", "text_key", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.count("*").alias("copies"),
    )
    # maximal runs: a span joins the one before when it starts no later than that one's end
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["span_ends"] >= x["span_starts"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["span_starts"].alias("span_starts"), F.greatest(F.element_at(acc, -1)["span_ends"], x["span_ends"]).alias("span_ends")))),
    ).otherwise(F.concat(acc, F.array(x)))
    empty = F.expr("cast(array() as array<struct<span_starts:bigint,span_ends:bigint>>)")
    joined = merged.withColumn("spans", F.aggregate("spans", empty, step))
    rows = F.explode(F.array_repeat(F.lit(1), (F.col("copies") / len(passes)).cast("int")))
    return joined.select("doc_id", "text_key", "n_words", F.col("spans.span_starts").alias("span_starts"), F.col("spans.span_ends").alias("span_ends"), "item_ids", rows.alias("row")).drop("row")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = KGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents``, all columns, in which no benchmark window occurs; one pass for each block, in one scan."""
    spark, clean = documents.sparkSession, documents
    for block in _blocks(benchmark, block_bytes):
        clean = clean.mapInArrow(_keep_clean(spark.sparkContext.broadcast(Index(block, k, window))), documents.schema)
    return clean
