"""One-permutation MinHash fingerprints, in DataFrame functions only.

Every shingle of ``SHINGLE`` words is hashed once; the high bits of the hash choose one of
``BINS`` bins and each bin keeps its smallest hash. An empty bin borrows from a non-empty
one by optimal densification: it probes the bins in its own pseudo-random order, the same
for all documents, until it meets one that has a hash. Stored are the ``BITS`` low-order
bits of each bin, one hexadecimal digit; two unrelated bins agree by chance once in
``2 ** BITS``, and likeness corrects for that.

A sentinel per bin is sorted in with the hashes, so that the first element of each bin's
run is its minimum and the array has one element for each bin, in order.

Defined cases: a null text is empty; a text without words has only empty bins and one fixed
fingerprint; fewer words than a shingle make one shingle; extra columns are ignored; ids may
be any long, rows without an id come last, rows of equal ids follow one another by a hash of
their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, SHINGLE = 256, 4, 5
#: Bits of a hash below its bin number (hashes are cut to 63 bits).
LOW = 55
EMPTY = (1 << LOW) - 1
#: First places of a bin's order that are probed, and full bins below which ranks are compared instead.
PROBES, FEW = 24, 16
_PRIME = (1 << 31) - 1
#: Rows in a range of neighbouring ids, and the most ranges, whose first keys the driver holds (33 bytes each).
BUCKET_ROWS, MAX_BOUNDS = 2048, 100_000


def _rank(i, j):
    """A pseudo-random number below 2**31 by which bin ``i`` orders the bins ``j`` (integers or columns)."""
    x = i * BINS + j + 1
    return (x * x % _PRIME) * 48271 % _PRIME


def _probes() -> Column:
    """For each bin the first bins in its order, one after the other."""
    first = [sorted(range(BINS), key=lambda j, i=i: (_rank(i, j), j))[:PROBES] for i in range(BINS)]
    return F.expr(f"array({','.join(str(j) for own in first for j in own)})")


def _shingles(hashed: Column) -> Column:
    count = F.greatest(F.size(hashed) - (SHINGLE - 1), F.least(F.size(hashed), F.lit(1)))
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(SHINGLE))))


def minima(hashes: Column) -> Column:
    """The smallest hash of each bin, in bin order; the bin's sentinel where it is empty."""
    sentinels = F.expr(f"array({','.join(f'{(b << LOW) | EMPTY}L' for b in range(BINS))})")
    ordered = F.sort_array(F.concat(hashes, sentinels))
    before = F.slice(F.concat(F.array(F.lit(-1).cast("long")), ordered), 1, F.size(ordered))
    first = lambda x, y: F.when(F.shiftright(x, LOW) != F.shiftright(y, LOW), x)
    return F.filter(F.zip_with(ordered, before, first), lambda x: x.isNotNull())


def densified(bins: Column, full: Column, probes: Column) -> Column:
    """Each bin's own hash, or for an empty one a hash of the borrowed value and the bin.

    ``bins`` has nulls for empty bins, ``full`` the numbers of the others, ``probes`` each bin's first choices. A bin borrows
    from the first non-empty one in its order: the least rank where few are full, else by
    probing (both find the same one).
    """
    def borrow(i: Column) -> Column:
        nearest = (F.array_min(F.transform(full, lambda j: _rank(i.cast("long"), j) * BINS + j)) % BINS).cast("int")
        tried = [F.get(probes, i * PROBES + t) for t in range(PROBES)]
        probed = F.coalesce(*(F.when(F.get(bins, j).isNotNull(), j) for j in tried), nearest)
        return F.get(bins, F.when(F.size(full) < FEW, nearest).otherwise(probed))

    # hashed with the bin, or one value would fill many bins alike
    return F.transform(bins, lambda x, i: F.coalesce(x, F.xxhash64(borrow(i), i)))


def with_fingerprint(frame: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column; each step is a projection of its own, computed once."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    step = frame.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn("_s", F.transform(_shingles(F.col("_w")), lambda s: s.bitwiseAND(F.lit((1 << 63) - 1)))).drop("_w")
    step = step.withColumn("_m", minima(F.col("_s"))).drop("_s")
    step = step.withColumn("_b", F.transform("_m", lambda x: F.nullif(x.bitwiseAND(F.lit(EMPTY)), F.lit(EMPTY)))).drop("_m")
    step = step.withColumn("_f", F.filter(F.transform("_b", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()))
    step = step.withColumn("_p", _probes())  # one node of the plan, whatever refers to it
    step = step.withColumn("_d", densified(F.col("_b"), F.col("_f"), F.col("_p"))).drop("_b", "_f", "_p")
    digits = F.transform("_d", lambda x: F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))))
    return step.withColumn(name, F.lower(F.array_join(digits, ""))).drop("_d")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, chance agreement taken out."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def _order_key(key: str) -> Column:
    """Text whose order is that of descending ids, nulls last, then of a hash of the text; any id has one."""
    upside_down = F.bitwise_not(F.col(key).bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.concat(F.when(F.col(key).isNull(), "1").otherwise("0"), F.coalesce(digits(upside_down), F.lit("")), digits(F.xxhash64("text")))


def with_next(frame: DataFrame, carried: list[str], prepare: Callable[[DataFrame], DataFrame], key: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``next``: a struct of ``carried`` of the row that follows in descending order of ``key``.

    After the last row comes the first. A first pass over the order keys alone deals them into
    ranges of about ``bucket_rows`` rows, whatever the ids look like (rows of equal or no id are
    told apart by a hash of their text), and tells the first key of each. Rows then go to their
    range once; the first row of each is also sent to the range before it, so that a range
    knows what follows its last row. ``prepare`` adds columns after the exchange, so that they
    don't travel. Beyond ``bucket_rows * MAX_BOUNDS`` rows the ranges grow; a task sorts its range with spilling.
    """
    rows = frame.withColumn("_key", _order_key(key))
    wanted = max(1, min(MAX_BOUNDS, -(-frame.count() // bucket_rows)))
    dealt = rows.select("_key").repartitionByRange(wanted, "_key").withColumn("_range", F.spark_partition_id())
    heads = sorted(r["head"] for r in dealt.groupBy("_range").agg(F.min("_key").alias("head")).select("head").collect())
    bounds = F.split(F.lit(",".join(heads)), ",")
    steps = [1 << k for k in reversed(range(max(0, len(heads) - 1).bit_length()))]
    # a binary search for the last range that starts at or before the key
    further = lambda at, step: F.when((at + step < len(heads)) & (F.get(bounds, at + step) <= F.col("_key")), at + step).otherwise(at)
    rows = rows.withColumn("_bucket", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further) if steps else F.lit(0))
    before = F.when(F.col("_bucket") == 0, F.lit(max(0, len(heads) - 1))).otherwise(F.col("_bucket") - 1)
    guests = rows.where(F.col("_key") == F.get(bounds, F.col("_bucket"))).withColumn("_bucket", before).dropDuplicates(["_bucket"])
    every = rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    within = Window.partitionBy("_bucket").orderBy("_guest", "_key")
    return prepare(every.repartition("_bucket")).withColumn("next", F.lead(F.struct(*carried)).over(within)).where(~F.col("_guest")).drop("_bucket", "_key", "_guest")


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last third of the code points replaced by as many of the next
    document's first ones (all, if it has fewer).
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(narrow, ["text", "fingerprint"], lambda rows: with_fingerprint(rows, "text", "fingerprint"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third)).alias("edited"),
        "fingerprint",
        F.col("next.fingerprint").alias("next_fingerprint"),
    )
    return with_fingerprint(edited, "edited", "edited_fingerprint").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
