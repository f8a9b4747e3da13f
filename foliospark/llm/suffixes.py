"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

Documents are dealt by a hash into shards of about ``SHARD_BYTES``. Every 50-byte window has
a minimiser (its smallest hash of ``gram`` bytes), so equal windows lie in super-k-mers of one
minimiser wherever they are, and an index may be cut by minimiser without losing a repeat.

1. *Filter.* Each shard sends its distinct minimisers to buckets, which answer whether
   another document has them too. Strings whose minimiser no other document has cannot hold
   a repeat and are not indexed. This is all the filter decides.
2. *Shard transforms.* Each shard sorts the suffixes of its strings once, by prefix doubling,
   and so has its transform, which it cuts by minimiser bucket. Strings of which every window
   occurs in a smaller document of the same shard are settled by that order and left out.
3. *Merge.* A bucket gets the transforms of all shards, bytes and string ends, no strings. The
   interleave of the shards starts unsorted; each round sorts it stably by the next bytes of
   the transforms (as many as fit a machine word), which puts it in the order of that many
   bytes more; a place where the bytes or the blocks before them differ starts a new block,
   that is, bounds the common prefix. Blocks of one document only are left behind. No suffix is
   sorted again. After ``window`` bytes the blocks are the repeated intervals: all places whose
   next 50 bytes are equal, and those that are not of the smallest document are removed.

A minimiser with more than ``hot`` occurrences doesn't go to one bucket: its strings are cut into
single windows, each to the bucket of its own hash, and indexed by the same merge. A bucket
then holds a window at most once for each shard.

Defined cases: null texts are empty; documents shorter than the window keep all; rows
without an id count as later than all others; rows of equal ids are not repeats of each other;
strings are judged on the input; texts of any length are read in pieces that overlap; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch, inside, mixed, rolling, sliding_min, texts_of

WINDOW, GRAM = 50, 16
#: A byte that UTF-8 never has ends each indexed string.
END = 0xFF
NO_ID = (1 << 63) - 1
#: Bytes of text in a shard, and bytes of strings that go into transforms together (below 2 ** 22).
SHARD_BYTES, SORT_BYTES = 3 << 20, 2 << 20
#: Bytes of text for each bucket of minimisers, and for each bucket of strings.
ASK_BYTES, MERGE_BYTES = 16 << 20, 2 << 20
#: A shard sends its transforms in ``PARTS`` rows, each of one or more buckets; one more set for every ``PARTS_BYTES`` of text.
PARTS, PARTS_BYTES = 1024, 64 << 30
#: Bytes of text that are hashed at a time, so that hashes stay in a core's cache; bytes of a batch of results.
PIECE, BATCH_BYTES = 1 << 17, 1 << 20
HOT = 20_000

_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_NONE = np.empty(0, np.int64)


# --- super-k-mers ---


def _piece_runs(data: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(piece, start, count, key) of the super-k-mers of pieces that lie one after the other."""
    starts = np.cumsum(lengths) - lengths
    low = sliding_min(rolling(_SYMBOLS[data], gram), window - gram + 1)
    if not len(low):
        return _NONE, _NONE, _NONE, np.empty(0, np.uint64)
    held = inside(starts, lengths, window, len(data))[: len(low)]
    change = np.ones(len(low) + 1, bool)
    change[1:-1] = (low[1:] != low[:-1]) | (held[1:] != held[:-1])
    edges = np.flatnonzero(change)
    first, count = edges[:-1], np.diff(edges)
    own = held[first]
    first, count = first[own], count[own]
    longest = window - gram + 1
    if len(count) and count.max() > longest:  # a repetitive text's runs are cut, or strings would have any length
        pieces = -(-count // longest)
        which = np.repeat(np.arange(len(count)), pieces)
        step = longest * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        first, count = first[which] + step, np.minimum(count[which] - step, longest)
    piece = np.searchsorted(starts, first, side="right") - 1  # empty pieces share a start with the next one; the last counts
    return piece, first - starts[piece], count, mixed(low[first])  # the smallest of many hashes is small: mixed again


def super_kmers(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, count, key) of runs of windows with one minimiser; texts are read in pieces that overlap by window - 1."""
    found, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        piece, start, count, key = _piece_runs(data, np.array([len(p) for _, _, p in held], np.int64), window, gram)
        own, base = np.array([t for t, _, _ in held], np.int64), np.array([b for _, b, _ in held], np.int64)
        found.append((own[piece], base[piece] + start, count, key))
        held, size = [], 0

    for t, text in enumerate(texts):
        for base in range(0, max(1, len(text) - window + 1), PIECE):
            piece = text[base : base + PIECE + window - 1]
            held.append((t, base, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
    if held:
        flush()
    if not found:
        return _NONE, _NONE, _NONE, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _distinct(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order (which is by bucket, whatever their number), with occurrences, whether several rows have them, and each key's place."""
    unique, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    least, most = np.full(len(unique), len(row) and row.max()), np.zeros(len(unique), np.int64)
    np.minimum.at(least, inverse, row)
    np.maximum.at(most, inverse, row)
    return unique, counts, least != most, inverse


# --- shards ---


def _runs_of(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Rows of equal ``name`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        own = batch.column(name).to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[-1].column(name)[0].as_py() != own[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _texts(table: pa.Table) -> list[bytes]:
    return [x for batch in table.to_batches() for x in texts_of(batch)]


def _numbers(table: pa.Table) -> np.ndarray:
    """Each row's number in its shard: rows are sorted by (ord, tkey), equal ones share a number."""
    order, tkey = table.column("ord").to_numpy(), table.column("tkey").to_numpy()
    return np.cumsum(np.concatenate(([False], (order[1:] != order[:-1]) | (tkey[1:] != tkey[:-1])))) if len(order) else _NONE


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """data[cuts[i]:cuts[i + 1]] as the rows of a binary column."""
    values = np.ascontiguousarray(data).view(np.uint8)
    ends = (np.asarray(cuts) * data.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())


_ASKS = "bucket int, shard long, keys binary, counts binary"


def _ask(window: int, gram: int, buckets: int):
    """Rows sorted by shard -> for each bucket the shard's distinct minimisers and their occurrences (top bit: in several rows)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, "shard"):
            text, _, _, key = super_kmers(_texts(table), window, gram)
            unique, counts, several, _ = _distinct(key, _numbers(table)[text])
            bucket = _bucket(unique, buckets)
            firsts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else _NONE
            cuts = np.append(firsts, len(bucket))
            low = np.ascontiguousarray(unique.view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()
            held = (np.minimum(counts, 0x7FFF) | (several.astype(np.int64) << 15)).astype("<u2")
            shard = np.full(len(firsts), table.column("shard")[0].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[firsts].astype(np.int32)), pa.array(shard), _binary(low, cuts), _binary(held, cuts)], names=["bucket", "shard", "keys", "counts"])

    return ask


def _flat(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as one array, and each row's number of elements."""
    rows = table.column(name).to_pylist()
    data = np.frombuffer(b"".join(rows), kind)
    return data, np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


def _answer(hot: int):
    """Asks sorted by bucket -> for each shard a byte for each minimiser: 0 own, 1 shared, 2 shared and hot."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, "bucket"):
            raw, sizes = _flat(table, "keys", "V6")
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw.view(np.uint8).reshape(-1, 6)
            held, _ = _flat(table, "counts", "<u2")
            _, inverse, shards = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
            total, several = np.zeros(len(shards), np.int64), shards > 1
            np.add.at(total, inverse, held.astype(np.int64) & 0x7FFF)
            several[inverse[held >> 15 == 1]] = True
            status = (several.astype(np.uint8) + (several & (total > hot)))[inverse].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([table.column("shard").combine_chunks(), table.column("bucket").combine_chunks(), _binary(status, np.concatenate(([0], np.cumsum(sizes))))], names=["shard", "bucket", "status"])

    return answer


# --- transforms ---


def sorted_suffixes(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts all suffixes of strings by (suffix up to its END, string), by prefix doubling.

    String i is data[ends[i - 1]:ends[i]] and ends with END. Returns the positions in order, and
    the places (from 1) whose first ``window`` bytes equal those of the place before.
    """
    n = len(data)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    left = np.repeat(ends.astype(np.int32), np.diff(ends, prepend=0)) - np.arange(n, dtype=np.int32)  # bytes up to and with END
    length = min(window, (64 - int(bits)) // 8)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)  # the next eight bytes of each position
    key >>= np.uint64(64 - 8 * length)
    short = np.flatnonzero(left < length)
    key[short] &= ~((np.uint64(1) << (8 * (length - left[short])).astype(np.uint64)) - np.uint64(1))
    key <<= bits
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int32)
    key >>= bits
    fresh = np.empty(n + 1, bool)
    fresh[0] = fresh[n] = True
    np.not_equal(key[1:], key[:-1], out=fresh[1:n])
    heads = np.flatnonzero(fresh)
    rank = np.empty(n, np.int32)  # the place of the first one that is equal so far
    rank[order] = np.repeat(heads[:-1].astype(np.int32), np.diff(heads))
    place = np.arange(n, dtype=np.int32)
    alike, known, reached = place[:0], rank, length
    while True:
        open_ = ~(fresh[:-1] & fresh[1:])
        if length <= window:  # equal in this many bytes; looked at more closely at the end
            known, reached, alike = (rank.copy() if 2 * length > window else rank), length, place[open_ & ~fresh[:-1]]
        place = place[open_]
        own = order[place]
        more = left[own] > length  # others are equal up to their ENDs, and stay in the order of their strings
        place, own = place[more], own[more]
        if not len(place):
            break
        key = rank[own].astype(np.uint64)
        key <<= bits
        key |= rank[own + length].astype(np.uint64)
        if 3 * int(bits) <= 64:
            key <<= bits
            key |= own.astype(np.uint64)
            key.sort()
            own = (key & low).astype(np.int32)
            key >>= bits
        else:
            by = np.lexsort((own, key))
            own, key = own[by], key[by]
        order[place] = own
        fresh = np.empty(len(place) + 1, bool)
        fresh[0] = fresh[-1] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:-1])
        heads = np.flatnonzero(fresh)
        rank[own] = np.repeat(place[heads[:-1]], np.diff(heads))
        length *= 2
    # equal prefixes of `window` bytes: equal ones of `reached` bytes at the place and at window - reached behind it
    a, b = order[alike], order[alike - 1]
    whole = (left[a] > window) & (left[b] > window)
    alike, a, b = alike[whole], a[whole], b[whole]
    same = (known[a] == known[b]) & (known[a + (window - reached)] == known[b + (window - reached)])
    return order, np.sort(alike[same])


def _late(blocks: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places that are not of the smallest owner of their block (blocks: where one starts)."""
    if not len(blocks):
        return np.empty(0, bool)
    firsts = np.flatnonzero(blocks)
    least = np.minimum.reduceat(owner, firsts)
    return owner > np.repeat(least, np.diff(np.append(firsts, len(blocks))))


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings data[start:start + length], END after each, one after the other; their ends."""
    ends = np.cumsum(length + 1)
    at = np.arange(ends[-1]) - np.repeat(ends - length - 1 - start, length + 1)
    out = data[np.minimum(at, len(data) - 1)]
    out[ends - 1] = END
    return out, ends


_TRANSFORMS = "part int, shard long, transform binary, pieces binary, row binary, start binary, tail binary, ord binary, done binary"
_MARKS = "shard long, row int, first int, count int"


def _marked(string: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, count) of the runs of windows among (string, offset)."""
    if not len(string):
        return _NONE, _NONE, _NONE
    key = np.sort((string.astype(np.int64) << 32) | offset)
    firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1] + 1)))
    return key[firsts] >> 32, key[firsts] & 0xFFFFFFFF, np.diff(np.append(firsts, len(key)))


class Strings:
    """Strings of one shard: bucket, number of the row, where the row's text lies in the data, start there, windows, owner, whether the minimiser is hot."""

    def __init__(self, bucket: np.ndarray, row: np.ndarray, base: np.ndarray, start: np.ndarray, count: np.ndarray, owner: np.ndarray, hot: np.ndarray) -> None:
        self.bucket, self.row, self.base, self.start, self.count, self.owner, self.hot = self.all = bucket, row, base, start, count, owner, hot

    def pick(self, which: np.ndarray | slice) -> Strings:
        return Strings(*(x[which] for x in self.all))

    def parts(self, window: int) -> Iterator[Strings]:
        """Some consecutive strings at a time, of about ``SORT_BYTES``."""
        ends, a = np.cumsum(self.count + window), 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SORT_BYTES, side="right")))
            yield self.pick(slice(a, b))
            a = b

    def breaks(self) -> np.ndarray:
        """Whether a string starts a stretch: it isn't of the row before, or its windows don't follow."""
        at = self.base + self.start
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + self.count[:-1]) | (self.base[1:] != self.base[:-1]) | (self.row[1:] != self.row[:-1])
        return fresh


def shard_transform(data: np.ndarray, own: Strings, shard: int, window: int, buckets: int, each: int) -> tuple[pa.RecordBatch, Strings]:
    """The transforms of some strings cut by bucket, with what their order settles; and the windows of hot strings that it doesn't.

    Strings that follow one another in a row overlap, so their stretch is sorted once. The
    suffixes of a string are put in the order of the stretch's suffixes, which is an order that
    prepending a byte keeps, as a transform needs.
    """
    fresh = own.breaks()
    firsts = np.flatnonzero(fresh)
    stretch = np.cumsum(fresh) - 1
    length = np.add.reduceat(own.count, firsts) + window - 1
    text, ends = _gather(data, (own.base + own.start)[firsts], length)
    at = (ends - length - 1)[stretch] + own.start - own.start[firsts][stretch]  # where each string starts in the sorted text
    order, alike = sorted_suffixes(text, ends, window)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    # windows that a smaller row of this part has too
    held = np.unique(np.concatenate((alike - 1, alike)))
    where = order[held]
    string = np.searchsorted(at, where, side="right") - 1
    late = _late(~np.isin(held, alike, assume_unique=True), own.owner[string])
    where, string = where[late], string[late]
    gone = np.bincount(string, minlength=len(at)) == own.count
    told = (gone | own.hot)[string]
    s, first, count = _marked(string[told], (where - at[string])[told])
    done = np.column_stack((own.row[s], own.start[s] + first, count)).astype("<i4")
    # rows of the strings that are left, in the order of (bucket, suffix, string)
    by = np.flatnonzero(~gone & ~own.hot)
    by = by[np.argsort(own.bucket[by], kind="stable")]
    bucket, size = own.bucket[by], own.count[by] + window
    numbers, of = np.unique(bucket, return_inverse=True)
    stops = np.cumsum(size)
    place = np.arange(stops[-1] if len(by) else 0) + np.repeat(at[by] - (stops - size), size)
    before = np.empty_like(text)
    before[1:] = text[:-1]
    before = before[place]
    before[stops - size] = END
    key = np.repeat(of.astype(np.uint64) << np.uint64(44), size)
    key |= rank[place].astype(np.uint64) << np.uint64(22)
    key |= np.arange(len(place), dtype=np.uint64)
    key.sort()
    key &= np.uint64((1 << 22) - 1)
    shuffled = key.astype(np.int32)
    turn = np.empty(len(shuffled), np.int32)
    turn[shuffled] = np.arange(len(shuffled), dtype=np.int32)
    heads = np.concatenate(([0], stops))[np.searchsorted(of, np.arange(len(numbers)))]
    tail = turn[stops - 1] - heads[of]  # the row of each string's end, in its piece
    parts = np.unique(np.concatenate((numbers, own.bucket[s])) // each)
    cut = lambda part: np.searchsorted(part, np.append(parts, parts[-1] + 1) if len(parts) else [0])
    limits, rows = cut(numbers // each), cut(bucket // each)
    pieces = np.column_stack((numbers % each, np.diff(np.append(heads, len(place))), np.bincount(of, minlength=len(numbers)))).astype("<i4")
    bytes_ = np.append(heads, len(place))[limits]
    settled = np.argsort(own.bucket[s] // each, kind="stable")
    columns = [
        pa.array(parts.astype(np.int32)),
        pa.array(np.full(len(parts), shard, np.int64)),
        _binary(before[shuffled], bytes_),
        _binary(pieces.ravel(), 3 * limits),
        *(_binary(x.astype(kind), rows) for x, kind in ((own.row[by], "<i4"), (own.start[by], "<i4"), (tail, "<i4"), (own.owner[by], "<i8"))),
        _binary(done[settled].ravel(), 3 * cut((own.bucket[s] // each)[settled])),
    ]
    cut_up = np.flatnonzero(own.hot & ~gone)
    s = np.repeat(cut_up, own.count[cut_up])
    step = np.arange(len(s)) - np.repeat(np.cumsum(own.count[cut_up]) - own.count[cut_up], own.count[cut_up])
    rest = ~np.isin(at[s] + step, where)
    s, step = s[rest], step[rest]
    hashes = rolling(_SYMBOLS[text], window, 0xD6E8FEB86659FD93)[at[s] + step] if len(s) else np.empty(0, np.uint64)
    single = Strings(_bucket(hashes, buckets), own.row[s], own.base[s], own.start[s] + step, np.ones(len(s), np.int64), own.owner[s], np.zeros(len(s), bool))
    return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "transform", "pieces", "row", "start", "tail", "ord", "done"]), single


def _transforms(window: int, gram: int, buckets: int, each: int):
    """Answers, then rows, of each shard -> its transforms."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, "shard"):
            shard, answers = table.column("shard")[0].as_py(), pa.compute.is_valid(table.column("status"))
            told, rows = table.filter(answers), table.filter(pa.compute.invert(answers))
            if not told.num_rows:
                continue
            texts, number, owner = _texts(rows), _numbers(rows), rows.column("ord").to_numpy()
            text, start, count, key = super_kmers(texts, window, gram)
            _, _, _, place = _distinct(key, number[text])
            by = np.argsort(told.column("bucket").to_numpy(), kind="stable")
            statuses = told.column("status").to_pylist()
            status = np.frombuffer(b"".join(statuses[i] for i in by.tolist()), np.uint8)[place]
            chosen = np.flatnonzero(status)
            if not len(chosen):
                continue
            text = text[chosen]
            data = np.frombuffer(b"".join(texts), np.uint8)
            base = np.cumsum([0, *(len(t) for t in texts[:-1])])
            mine = Strings(_bucket(key[chosen], buckets), number[text], base[text], start[chosen], count[chosen], owner[text], status[chosen] == 2)
            for part in mine.parts(window):
                batch, single = shard_transform(data, part, shard, window, buckets, each)
                yield batch
                for k in range(0, len(single.row), SORT_BYTES // (2 * window)):  # each window alone, so that no two share a bucket unless they are equal
                    yield shard_transform(data, single.pick(slice(k, k + SORT_BYTES // (2 * window))), shard, window, buckets, each)[0]

    return emit


# --- the merge ---


def merge_transforms(transform: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tails: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges shard transforms that lie one after the other; (string, offset) of each window that a smaller owner has too.

    A shard has ``sizes`` rows, one for each suffix of its ``counts`` strings, in order, and the row
    of each string's end among them (``tails``). A row holds the byte before its suffix, or END.
    """
    n = len(transform)
    if not n:
        return _NONE, _NONE
    # within a shard, the rows that a byte precedes, by that byte, are the rows that start with a byte, in order
    rows = np.flatnonzero(transform != END)
    segment = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = (segment[rows] << np.uint64(40)) | (transform[rows].astype(np.uint64) << np.uint64(32)) | rows.astype(np.uint64)
    key.sort()
    tail = np.repeat(np.cumsum(sizes) - sizes, counts) + tails
    inner = np.ones(n, bool)
    inner[tail] = False
    longer = np.zeros(n, np.int32)  # the row of the suffix one byte longer
    longer[(key & np.uint64(0xFFFFFFFF)).astype(np.int32)] = np.flatnonzero(inner)
    # every string backwards from its end, all at once
    string, back, length = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(len(owner), np.int32)
    row, own, steps = tail, np.arange(len(owner), dtype=np.int32), 0
    while len(row):
        string[row], back[row] = own, steps
        more = transform[row] != END
        length[own[~more]] = steps
        row, own = longer[row[more]], own[more]
        steps += 1
    # the strings backwards, one after the other, so that the bytes before a row lie behind one another
    base = np.cumsum(length + 1) - length - 1
    spot = base.astype(np.int32)[string] + back
    text = np.zeros(n + 8, np.uint8)
    text[spot] = transform
    ahead = np.ndarray((n,), "<u8", text, strides=(1,)).copy()  # the next eight bytes of each place
    # the interleave: places that have a whole window of their string before them
    now = spot[length[string] - back >= window]
    home = np.repeat(np.arange(len(owner), dtype=np.int32), length + 1)  # the string of each place
    rank = np.unique(owner, return_inverse=True)[1].astype(np.int32)
    block, starts, read, rounds = np.zeros(len(now), np.int32), np.zeros(len(now), bool), 0, 0
    while read < window and len(now):
        bits = np.uint64(len(now).bit_length())
        width = min(window - read, (64 - int(bits)) // 8)
        symbol = ahead[now]
        symbol &= np.uint64((1 << 8 * width) - 1)
        symbol <<= bits
        symbol |= np.arange(len(now), dtype=np.uint64)  # the place is part of the key: a stable sort
        symbol.sort()
        by = (symbol & np.uint64((1 << int(bits)) - 1)).astype(np.int32)
        symbol >>= bits
        now, block = now[by], block[by]
        now += np.int32(width)
        starts = np.empty(len(now), bool)
        starts[0] = True
        np.not_equal(symbol[1:], symbol[:-1], out=starts[1:])
        starts[1:] |= block[1:] != block[:-1]
        read, rounds = read + width, rounds + 1
        if rounds == 3:  # blocks of one owner hold no repeat, nor will what they refine to
            firsts = np.flatnonzero(starts)
            held = rank[home[now]]
            several = np.minimum.reduceat(held, firsts) != np.maximum.reduceat(held, firsts)
            stay = np.repeat(several, np.diff(np.append(firsts, len(now))))
            now, starts = now[stay], starts[stay]
        block = np.cumsum(starts, dtype=np.int32)
    late = now[_late(starts, rank[home[now]])] if len(now) else now
    found = home[late].astype(np.int64)
    return found, length[found] - (late - base[found])


def _spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start:start + size] of each piece, one after the other."""
    stops = np.cumsum(sizes)
    return values[np.arange(stops[-1]) + np.repeat(starts - stops + sizes, sizes)]


def _merge(window: int):
    """Transforms sorted by part -> the repeated windows of each row of each shard; a part's buckets are merged some at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, "part"):
            shard = table.column("shard").to_numpy()
            (transform, _), (row, strings), (start, _), (tail, _), (owner, _), (done, told), (pieces, held) = (
                _flat(table, *x) for x in (("transform", "u1"), ("row", "<i4"), ("start", "<i4"), ("tail", "<i4"), ("ord", "<i8"), ("done", "<i4"), ("pieces", "<i4"))
            )
            done = done.reshape(-1, 3)
            yield _found(np.repeat(shard, told // 3), *done.T)
            home = np.repeat(shard, strings)
            bucket, sizes, counts = pieces.reshape(-1, 3).T.astype(np.int64)
            at, first = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
            by = np.argsort(bucket, kind="stable")
            total, ends, a = np.cumsum(sizes[by]), np.flatnonzero(np.diff(bucket[by], append=-1)) + 1, 0
            while a < len(by):
                full = int(np.searchsorted(total, (total[a - 1] if a else 0) + MERGE_BYTES, side="right"))
                b = int(ends[max(np.searchsorted(ends, full, side="right") - 1, np.searchsorted(ends, a, side="right"))])  # whole buckets, one at least
                p = by[a:b]
                of = _spread(np.arange(len(row)), first[p], counts[p])
                s, o, c = _marked(*merge_transforms(_spread(transform, at[p], sizes[p]), sizes[p], counts[p], tail[of], owner[of], window))
                s = of[s]
                yield _found(home[s], row[s], start[s] + o, c)
                a = b

    return merge


def _found(shard: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard), *(pa.array(x.astype(np.int32)) for x in (row, first, count))], names=["shard", "row", "first", "count"])


def _covered(start: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs (start, end) of what some spans cover; what touches is one run. Costs memory by the spans, not by the text."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate((start + length)[by])
    heads = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return list(zip(start[heads].tolist(), reach[np.append(heads[1:], len(start)) - 1].tolist(), strict=True))


def _strip(window: int):
    """Marks, then rows, of each shard -> its rows with what is kept of them."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, "shard"):
            marks = pa.compute.is_valid(table.column("first"))
            told, rows = table.filter(marks), table.filter(pa.compute.invert(marks))
            row, first, count = (told.column(c).to_numpy() for c in ("row", "first", "count"))
            by = np.argsort(row, kind="stable")
            row, first, count = row[by], first[by], count[by]
            out, size = [], 0
            ids, number = rows.column("doc_id").to_pylist(), _numbers(rows)
            for text, doc_id, a, b in zip(_texts(rows), ids, np.searchsorted(row, number).tolist(), np.searchsorted(row, number, side="right").tolist(), strict=True):
                kept, spans = text, []
                if a < b:
                    spans = _covered(first[a:b].astype(np.int64), count[a:b] + np.int64(window - 1))
                    edges = [0, *(x for span in spans for x in span), len(text)]
                    kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in spans]))
                size += len(kept)
                if size > BATCH_BYTES or len(out) >= 2000:
                    yield _batch(out, kinds)
                    out, size = [], 0
            if out:
                yield _batch(out, kinds)

    return strip


def _batch(out: list[tuple], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *kinds), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def _grouped(frame: DataFrame, run: Callable, schema: str, key: str, *order: str) -> DataFrame:
    return frame.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def drop_repeated_bytes(documents: DataFrame, *, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """documents(doc_id, text) -> byte counts, removed byte spans, and the bytes kept with their SHA-256."""
    scratch = Scratch(documents.sparkSession, "bytes")
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards, asks, parts = size // SHARD_BYTES + 1, size // ASK_BYTES + 1, PARTS * (size // PARTS_BYTES + 1)
    each = size // (parts * MERGE_BYTES) + 1  # buckets in a part
    rows = documents.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(NO_ID)).alias("ord"), F.xxhash64(text).alias("tkey"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("ord", "tkey"), F.lit(shards)))
    told = _grouped(rows.select("shard", "ord", "tkey", "text"), _ask(window, gram, asks), _ASKS, "shard", "ord", "tkey")
    answers = scratch.keep(_grouped(told, _answer(hot), "shard long, bucket int, status binary", "bucket"), "answers")
    asked = answers.unionByName(rows.select("shard", "ord", "tkey", "text"), allowMissingColumns=True)
    made = _grouped(asked, _transforms(window, gram, parts * each, each), _TRANSFORMS, "shard", "ord", "tkey")
    marks = scratch.keep(_grouped(made, _merge(window), _MARKS, "part"), "marks")
    scratch.drop(answers)
    every = marks.unionByName(rows, allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>"
    return _grouped(every, _strip(window), schema, "shard", "ord", "tkey")
