"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition tokenises its documents and packs the pieces best-fit decreasing. Full
pieces and bins that are nearly full are final at once. Underfull bins are carried as
items into a tree of merges (``FAN_IN`` groups at a time), where best-fit runs again,
until one group is left. Each group carries its roomiest ``CARRY`` bins and emits the others
as they are, and that costs no sequence. Two bins of one best-fit pass never fit together
(the first item of the later one would have gone into the earlier one, and fills only grow),
so at most one bin of a pass is half full or less. To join two bins one must be, so a
merge of ``FAN_IN`` groups can save no more bins than it has of those, one for each pass
below it; and a bin that fits into any bin of a group fits into a roomier one. With as many
roomy bins carried as there are small ones, every join that all bins would allow is there.
What a merge holds is bounded by ``FAN_IN * CARRY`` items, what a pass holds by ``PASS`` pieces.

Defined cases: null texts are empty (one end token); a document of more than ``capacity``
tokens is cut into pieces of ``capacity``; rows with equal or null ids are packed like any
other; the end token counts as the document's last id.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch, slices, texts_of

CAPACITY = 4096
FAN_IN = 8
CARRY = 2048
#: Pieces that one best-fit pass packs; a partition of more takes several passes.
PASS = 200_000
END_ID = 1
#: Words whose ids a worker keeps before it starts anew (some 200 bytes each).
WORDS = 800_000

#: Marks that the tokenizer always parts from a letter or digit before them.
_MARKS = b".,;:!?*#$%&"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class WordIds(dict):
    """word (bytes without ASCII white space, A-Z lowered) -> its ids as little-endian uint32 bytes.

    The tokenizer lowers its input and drops white space, and no token crosses it, so a text's ids
    are those of its words. Words not met before are encoded together, one space between them.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.ends: dict[str, bool] = {}

    def ends_well(self, last: str) -> bool:
        """Whether a word's last character is a letter or number to the tokenizer, which composes, decomposes and lowers it first."""
        found = self.ends.get(last)
        if found is None:
            found = self.ends[last] = unicodedata.category(self.tokenizer.normalizer.normalize_str(last)[-1])[0] in "LN"
        return found

    def learn(self, words: set[bytes]) -> None:
        """Adds words; what follows a last letter or digit is split off, as the tokenizer does."""
        new, parted = set(), []
        for w in words:
            head = w.rstrip(_MARKS)
            # the last byte of a character beyond ASCII is no letter among bytes
            if len(head) < len(w) and head and (head[-1:].isalnum() or self.ends_well(head.decode("utf-8", "replace")[-1])):
                parted.append((w, head, w[len(head) :]))
                new.add(head)
            else:
                new.add(w)
        new.update({tail for _, _, tail in parted})
        fresh = list(filterfalse(self.__contains__, new))
        for at in range(0, len(fresh), 2000):
            part = fresh[at : at + 2000]
            texts = [w.decode("utf-8", "replace") for w in part]
            ends = np.cumsum([len(t) + 1 for t in texts])
            encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4").tobytes()
            first = np.fromiter(map(itemgetter(0), encoded.offsets), np.int64, len(encoded))
            cuts = [0, *(4 * np.searchsorted(first, ends)).tolist()]
            self.update((w, ids[a:b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))
        for w, head, tail in parted:
            self[w] = self[head] + self[tail]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if len(self) > WORDS:
            self.clear()
        split = [t.lower().split() for t in texts]
        unknown: set[bytes] = set()
        for words in split:
            unknown.update(filterfalse(self.__contains__, words))
        self.learn(unknown)
        get = self.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=1)
def _words(path: str) -> WordIds:
    """What this worker has learnt; a later task in the same process goes on with it."""
    return WordIds(path)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and its place there; each bin's fill."""
    bin_of, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, at = capacity, len(fills)
            fills.append(0)
        bin_of[i], place[i] = at, fills[at]
        fills[at] += size
        if room > size:
            rooms[room - size].append(at)
            open_rooms |= 1 << (room - size)
    return bin_of, place, np.array(fills, np.int64)


def _local(path: str, capacity: int):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def packed(rows: list[tuple], first: int) -> tuple[pa.Table, int]:
        columns = list(zip(*rows, strict=True))
        bin_of, place, fills = best_fit(np.array(columns[3], np.int64), capacity)
        arrays = [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(first + bin_of), pa.array(place), pa.array(fills[bin_of])]
        return pa.Table.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill"]), len(fills)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = _words(path), np.array([END_ID], "<u4").tobytes()
        rows: list[tuple] = []
        first = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), cache.ids(texts_of(batch)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= PASS:
                table, bins = packed(rows, first)
                yield from table.to_batches(max_chunksize=20_000)
                rows, first = [], first + bins
        if rows:
            yield from packed(rows, first)[0].to_batches(max_chunksize=20_000)

    return pack


def _merge(capacity: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], kind="stable")
        bin_of, place, fills = best_fit(group["fill"].to_numpy(), capacity)
        ids = group["bin"].to_numpy()
        head = np.full(len(fills), -1, np.int64)
        head[bin_of[place == 0]] = ids[place == 0]  # a merged bin takes the id of its first part
        return pd.DataFrame({"bin": ids, "into": head[bin_of], "shift": place, "into_fill": fills[bin_of], "node": group["node"].to_numpy()})

    return merge


def pack_documents(documents: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, carry: int = CARRY) -> DataFrame:
    """documents(doc_id, text) -> one row per piece with its sequence and its offset there."""
    scratch = Scratch(documents.sparkSession, "packing")
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(narrow.mapInArrow(_local(tokenizer_path, capacity), PIECES), "pieces")
    bins = pieces.where(F.col("place") == 0).select("bin", "fill", F.shiftright("bin", 32).alias("node"))
    moved = pieces.select("*", F.col("bin").alias("sequence_id"), F.col("place").alias("offset")).drop("bin", "place", "fill")
    nodes = (bins.agg(F.max("node")).first()[0] or 0) + 1
    items = bins.where(F.col("fill") < capacity)
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        items = _roomiest(items, carry).withColumn("node", F.floor(F.col("node") / FAN_IN))
        joined = scratch.keep(items.groupBy("node").applyInPandas(_merge(capacity), "bin long, into long, shift long, into_fill long, node long"), "merge")
        changed = joined.where(F.col("bin") != F.col("into")).select(F.col("bin").alias("sequence_id"), "into", "shift")
        moved = (
            moved.join(changed, "sequence_id", "left")
            .withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
            .withColumn("sequence_id", F.coalesce("into", "sequence_id"))
            .drop("into", "shift")
        )
        items = joined.where(F.col("bin") == F.col("into")).select("bin", F.col("into_fill").alias("fill"), "node")
    return moved.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _roomiest(items: DataFrame, carry: int) -> DataFrame:
    """The ``carry`` emptiest bins of each node (a top-k per node, which Spark limits before the shuffle)."""
    from pyspark.sql import Window

    order = Window.partitionBy("node").orderBy("fill", "bin")
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= carry).drop("rank")
