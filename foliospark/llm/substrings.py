"""Removal of repeated word windows by super-k-mer partitioning.

Consecutive windows of 50 words that share a minimiser are one super-k-mer. Equal
super-k-mers are one content, whose first document is found by an aggregation that combines
before the shuffle; in every later document all its windows are repeats. Only contents whose
minimiser has other contents too need a comparison window by window: each travels once, as
one packed string, to the bucket of its minimiser, where sorting the windows finds the
first document of each exactly. A bucket of more than ``HOT`` contents is split: each of its
windows travels as a packed string of its own, and a salted aggregation over the strings
finds the first document of each, as exactly, without a task that gathers them.

Defined cases: null texts have no words; documents of fewer words than a window keep all;
a document without an id counts as later than all others; rows of equal ids are not
repeats of each other, but both are repeats of smaller ids; windows repeated inside one
document only are kept; extra columns are ignored. Contents are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch, WordHashes, runs, slices, texts_of
from foliospark.llm.superkmers import super_kmers

WINDOW, GRAM = 50, 8
#: A minimiser with more contents is hot: its windows are dealt one by one, with ``SALTS`` salts.
HOT, SALTS = 1000, 16
NO_ID = (1 << 63) - 1
#: A content: its minimiser and a hash of its symbols, 128 bits together.
KEYS = ["mini", "c1"]


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, and what identifies a row in the steps between: ord (the id; the largest if null) and tkey, a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"),
        F.xxhash64(text).alias("tkey"),
    )


def _symbols(cache: WordHashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    arrays = [cache.array(t.split()) for t in texts]
    return np.concatenate(arrays), np.array([len(a) for a in arrays], np.int64)


def _occurrences(window: int, gram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            symbols, lengths = _symbols(cache, texts_of(batch))
            k = super_kmers(symbols, lengths, window, gram)
            own = pa.array(k.doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in (k.minimiser, k.content)]
                + [batch.column("ord").take(own), batch.column("tkey").take(own), pa.array(k.start.astype(np.int32)), pa.array(k.count.astype(np.int32))],
                names=[*KEYS, "ord", "tkey", "start", "count"],
            )

    return emit


def _pack(window: int):
    """Documents with what is asked of them -> packed strings of the cold contents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for text, order, asked in zip(texts_of(batch), batch.column("ord").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                words = text.split()
                rows += [(a["mini"], a["c1"], order, b" ".join(words[a["start"] : a["start"] + a["count"] + window - 1])) for a in asked]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=[*KEYS, "ord", "packed"])

    return pack


def _unpack_hot(window: int):
    """Documents with what is asked of them -> one row, with its words, for each window of the hot contents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, order, asked in zip(texts_of(batch), batch.column("ord").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                words = text.split()
                for a in asked:
                    n = a["count"]
                    packed = [b" ".join(words[i : i + window]) for i in range(a["start"], a["start"] + n)]
                    ids = [np.full(n, a[k]) for k in KEYS]
                    yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *(pa.array(x) for x in (*ids, np.full(n, order), np.arange(n, dtype=np.int32)))], names=["packed", *KEYS, "ord", "at"])

    return emit


def _late_windows(each: DataFrame, scratch: Scratch) -> DataFrame:
    """Of rows (packed, mini, c1, ord, at) those whose window a smaller document has: minima by salted window first, so that no task gathers a common one."""
    salted = scratch.keep(each.withColumn("salt", F.pmod(F.col("c1"), F.lit(SALTS))), "hot")
    some = scratch.keep(salted.groupBy("packed", "salt").agg(F.min("ord").alias("low")), "low")
    owner = some.groupBy("packed").agg(F.min("low").alias("owner"))
    late = salted.join(some.select("packed", "salt").join(owner, "packed"), ["packed", "salt"])
    return late.where(F.col("ord") > F.col("owner")).groupBy(*KEYS).agg(F.sort_array(F.collect_set("at")).alias("windows"))


def first_owners(bucket: list[tuple[int, bytes]], window: int) -> list[list[int]]:
    """Of contents (document, packed words) the windows that a smaller document has too, by sorting them."""
    windows: list[tuple[bytes, int, int, int]] = []
    for k, (order, packed) in enumerate(bucket):
        words = packed.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        firsts = [0, *ends]
        windows += [(packed[firsts[i] : ends[i + window - 1] - 1], order, k, i) for i in range(len(words) - window + 1)]
    windows.sort()
    repeated: list[list[int]] = [[] for _ in bucket]
    last, owner = None, 0
    for text, order, k, i in windows:
        if text != last:
            last, owner = text, order
        elif order > owner:
            repeated[k].append(i)
    return repeated


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of equal ``mini`` from batches sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["mini"] != row["mini"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _compare(window: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.list_(pa.int32()))], names=[*KEYS, "windows"])

        for bucket in buckets(batches):
            for row, windows in zip(bucket, first_owners([(r["ord"], r["packed"]) for r in bucket], window), strict=True):
                if windows:
                    out.append((row["mini"], row["c1"], sorted(windows)))
            if len(out) >= 5000:
                yield flushed()
                out.clear()
        if out:
            yield flushed()

    return compare


def repeated_windows(rows: DataFrame, occurrences: DataFrame, scratch: Scratch, window: int, hot: int = HOT) -> DataFrame:
    """Per row (ord, tkey) the super-k-mers with repeats: array of struct(start, count, windows; null: all).

    Each step that others read, and each that shuffles much, is a table of its own, so that
    shuffle files of one step go before the next one writes.
    """
    spot = F.struct("ord", "tkey", "start", "count")
    contents = scratch.keep(occurrences.groupBy(*KEYS).agg(F.min(spot).alias("first"), F.max("ord").alias("last_ord")), "contents")
    rivals = contents.groupBy("mini").agg(F.count("*").alias("rivals")).where(F.col("rivals") > 1)
    contested = contents.join(rivals, "mini").select(*KEYS, "first.*", (F.col("rivals") > hot).alias("hot"))
    ask = F.collect_list(F.struct(*KEYS, "start", "count", "hot"))
    asked = scratch.keep(contested.groupBy("ord", "tkey").agg(ask.alias("asked"), F.max("hot").alias("hot")), "asked")
    wanted = rows.select("ord", "tkey", "text").join(asked, ["ord", "tkey"])
    of = lambda is_hot: wanted.select("ord", "text", F.filter("asked", lambda a: a["hot"] == F.lit(is_hot)).alias("asked"))
    packed = of(False).mapInArrow(_pack(window), "mini long, c1 long, ord long, packed binary")
    found = packed.repartition("mini").sortWithinPartitions("mini").mapInArrow(_compare(window), "mini long, c1 long, windows array<int>")
    if not asked.where("hot").isEmpty():
        found = scratch.keep(found, "cold")
        each = of(True).where(F.size("asked") > 0).mapInArrow(_unpack_hot(window), "packed binary, mini long, c1 long, ord long, at int")
        found = found.unionByName(_late_windows(each, scratch))
    found = scratch.keep(found, "found")
    # contents that a later document has too, or of which the first document has repeats
    several = contents.where(F.col("last_ord") > F.col("first.ord")).select(*KEYS, F.col("first.ord").alias("first_ord"))
    known = several.join(found, KEYS, "full")
    marks = occurrences.join(known, KEYS)
    whole = F.col("ord") > F.col("first_ord")
    spans = F.struct("start", "count", F.when(F.coalesce(whole, F.lit(False)), F.lit(None)).otherwise(F.col("windows")).alias("windows"))
    marks = marks.where(F.coalesce(whole, F.lit(False)) | F.col("windows").isNotNull())
    marks = scratch.keep(marks.groupBy("ord", "tkey").agg(F.collect_list(spans).alias("marks")), "marks")
    scratch.drop(contents, asked, found, occurrences)
    return marks


def covered(marks: list[dict], length: int, window: int) -> np.ndarray:
    """Marks of the symbols that repeated windows cover."""
    edge = np.zeros(length + 1, np.int32)
    for m in marks:
        if m["windows"] is None:
            edge[m["start"]] += 1
            edge[m["start"] + m["count"] + window - 1] -= 1
        else:
            at = m["start"] + np.array(m["windows"])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _strip(window: int):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text, marks in zip(texts_of(batch), batch.column("marks").to_pylist(), strict=True):
                words = text.split()
                if marks:
                    gone = covered(marks, len(words), window)
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    spans = list(zip(*(x.tolist() for x in runs(gone)), strict=True))
                else:
                    kept, spans = b" ".join(words), []
                out.append((len(words), sum(b - a for a, b in spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*out, strict=True))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary(), kind), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), arrays[0], arrays[1], arrays[2], arrays[3].cast(pa.string()), arrays[4]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return strip


def drop_repeated_windows(documents: DataFrame, *, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """documents(doc_id, text) -> word counts, removed word spans, and the kept words with their SHA-256."""
    scratch = Scratch(documents.sparkSession, "windows")
    rows = keyed(documents)
    found = scratch.keep(rows.select("ord", "tkey", "text").mapInArrow(_occurrences(window, gram), "mini long, c1 long, ord long, tkey long, start int, count int"), "occurrences")
    marks = repeated_windows(rows, found, scratch, window, hot)
    return rows.join(marks, ["ord", "tkey"], "left").select("doc_id", "text", "marks").mapInArrow(_strip(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,end:int>>")
