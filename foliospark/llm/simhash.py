"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint bit is set when more than half of a document's shingle hashes have it. The 64
bits are cut into ``max_bits // 2 + 1`` segments, so that of two fingerprints within
``max_bits`` at least one segment differs by one bit or none. Each segment is indexed under
all variants with one bit deleted (64 signatures per distinct fingerprint); equal
signatures meet in one sorted run and are verified on all 64 bits.

Equal fingerprints are one node, whatever the number of copies. A run emits no more than a
spanning forest of its links: short runs their links, long runs a breadth-first forest, and
runs of over ``LONGEST`` go to a second round under signatures of the other segments, so
that no task gathers them. Components come from star contractions of those edges.

Defined cases: a null or empty text has no shingle and the fingerprint 0, linked like any
other; fewer words than a shingle make one shingle; equal ids are rows like any other; a
null id takes the component's smallest id, null only where no member has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch, mixed, slices, texts_of
from foliospark.llm.components import component_labels

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Longest run that emits its links directly, and longest that one task searches.
SHORT, LONGEST = 32, 32_768


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``size`` lower-cased words joined by one space."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    firsts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(firsts, ends[size - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text, as uint64."""
    out = np.zeros(len(texts), np.uint64)
    hashes = [shingle_hashes(t) for t in texts]
    full = [i for i, h in enumerate(hashes) if h]
    if not full:
        return out
    counts = np.array([len(hashes[i]) for i in full])
    flat = np.fromiter((h for i in full for h in hashes[i]), np.uint64, int(counts.sum()))
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fingerprints(texts_of(batch)).view(np.int64))], names=[*names, "fp"])


def segments(count: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of the 64 bits."""
    cuts = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _variants(count: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(at, 4096).to_numpy().view(np.uint64)
                keys = []
                for first, width in segments(count):
                    part = (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    keys += [(part & np.uint64(~(1 << i) & 0xFFFFFFFF)) | np.uint64((first + i) << 32) for i in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp.view(np.int64), 64))], names=["key", "fp"])

    return emit


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, fp) in pieces that hold whole runs of equal keys, from batches sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1][0][-1] != key[0]):
            held.append((key[:cut], fp[:cut]))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append((key[cut:], fp[cut:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: each found one and its root."""
    left, found, roots = fp, [], []
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= max_bits
            if near.any():
                new, left = left[near], left[~near]
                frontier.extend(new)
                found.append(new)
                roots.append(np.full(len(new), root))
    none = np.empty(0, np.uint64)
    return (np.concatenate(found), np.concatenate(roots)) if found else (none, none)


def _links(count: int, max_bits: int, refine: bool):
    """Sorted (key, fp) -> edges (kind 0: a, b) and, from runs that are too long, finer rows (kind 1: key, fp)."""
    of_bit = np.repeat(np.arange(count), [w for _, w in segments(count)])
    masks = np.array([((1 << w) - 1) << f for f, w in segments(count)], np.uint64)
    firsts = np.array([f for f, _ in segments(count)])

    def edges(a: np.ndarray, b: np.ndarray, kind: int = 0) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    def finer(key: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = int(of_bit[key >> 32])
        other = [(f + at, w) for s, (f, width) in enumerate(segments(count)) if s != own for at, w in ((0, width),)]
        bits = [f + i for f, w in other for i in range(w)]
        parts = np.array_split(np.array(bits, np.uint64), count)  # of these too, one differs by one bit or none
        for part in parts:
            mask = np.bitwise_or.reduce(np.uint64(1) << part)
            for bit in part:
                tag = np.uint64(key) * np.uint64(0x9FB21C651E98DF25) + bit
                yield edges(mixed(mixed(fp & mask & ~(np.uint64(1) << bit)) + tag), fp, 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, signed in sorted_runs(batches):
            fp = signed.view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            if refine:  # in the first round a pair of equal segments counts at one bit only
                bit = key >> 32
                segment_mask, first = masks[of_bit[bit]], firsts[of_bit[bit]] == bit
            short = np.repeat(np.where(sizes <= SHORT, sizes, 0), sizes)
            a, b = [], []
            for d in range(1, int(short.max(initial=0))):
                at = np.flatnonzero((key[d:] == key[:-d]) & (short[d:] > d))
                if not len(at):
                    break
                apart = fp[at] ^ fp[at + d]
                near = np.bitwise_count(apart) <= max_bits
                if refine:
                    near &= first[at] | ((apart & segment_mask[at]) != 0)
                a.append(fp[at[near]])
                b.append(fp[at[near] + d])
            if a:
                yield edges(np.concatenate(a), np.concatenate(b))
            for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
                if refine and n > LONGEST:
                    yield from finer(int(key[s]), fp[s : s + n])
                else:
                    yield edges(*forest(fp[s : s + n], max_bits))

    return link


def near_links(distinct: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all links."""
    count = max_bits // 2 + 1
    keys = distinct.select("fp").mapInArrow(_variants(count), "key long, fp long")
    met = keys.repartition("key").sortWithinPartitions("key")
    first = scratch.keep(met.mapInArrow(_links(count, max_bits, True), "kind int, a long, b long"), "links")
    rest = first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp")).repartition("key").sortWithinPartitions("key")
    second = rest.mapInArrow(_links(count, max_bits, False), "kind int, a long, b long")
    return first.where("kind = 0").unionByName(second).select("a", "b")


def _components(narrow: DataFrame, max_bits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of ``narrow`` with fingerprints for texts, and of each fingerprint the smallest id and the component's root."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text"]
    marked = scratch.keep(narrow.mapInArrow(_fingerprint, ", ".join([*fields, "fp long"])), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = component_labels(near_links(distinct, scratch, max_bits), scratch)
    return marked, distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("root"))


def near_duplicates(documents: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, fp and component_id (smallest doc_id reachable over links)."""
    scratch = Scratch(documents.sparkSession, "simhash")
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked, rooted = _components(narrow, max_bits, scratch)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owner = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(owner, "fp", "left").select("doc_id", "fp", "component_id")


def body_hash(documents: DataFrame) -> Column:
    """A hash of the text that tells rows of equal or null ids apart."""
    return F.coalesce(F.md5(documents["text"].cast("string")), F.lit(""))


def one_of_each(documents: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """All columns of ``documents``, one row of each root of rows(doc_id, body, root): the smallest id, null only where there is no other."""
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("least"))
    first = scratch.keep(least.select(F.col("least.doc_id").alias("_id"), F.col("least.body").alias("_body")), "first")
    key = documents["doc_id"].cast("long").eqNullSafe(first["_id"]) & (body_hash(documents) == first["_body"])
    kept = documents.join(first, key, "left_semi")
    copies = rows.groupBy("doc_id", "body").count().where("count > 1")
    if copies.join(first, copies["doc_id"].eqNullSafe(first["_id"]) & (copies["body"] == first["_body"]), "left_semi").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def drop_near_duplicates(documents: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """All columns of ``documents``, one row of each component: that of its smallest id."""
    scratch = Scratch(documents.sparkSession, "simhash")
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), body_hash(documents).alias("body"), F.col("text").cast("string").alias("text"))
    marked, rooted = _components(narrow, max_bits, scratch)
    kept = one_of_each(documents, marked.join(rooted.select("fp", "root"), "fp"), scratch)
    scratch.drop_but("first")
    return kept
