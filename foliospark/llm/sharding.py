"""Shards by fixed virtual slots, in DataFrame functions only.

A record's id is hashed into one of ``SLOTS`` virtual slots for good; the number of shards never
enters that hash. Bytes are added up per slot, and a small map says which shard holds which slot.
The map is stored as versions: version 1 deals slots in turn, and each later version holds only
the slots that an edit moved. An edit goes through the slots from the heaviest to the lightest;
a slot stays with its shard while that keeps it within an equal share of all bytes, and goes to the
emptiest shard otherwise. So the bytes of shards come out near equal, and another number of
shards moves little more than it must.

A slot that holds more than a ``HEAVY``-th of a shard's share is mapped in parts: the records in
it are told apart by their address in the scratch table (file and row), so one id that holds a third
of all rows, or rows without an id, spread like others. A single record is never cut, so a text longer than a
share makes its shard as heavy as itself. The map has ``SLOTS + HEAVY * shards`` rows at
most, whatever the data; that bound is what allows it to be broadcast and dealt in one fold.

A record's place in its shard counts from 0 without gaps: rows are ranked within blocks of
``BLOCK_ROWS`` neighbouring rows of a scratch file, and blocks get prefix sums of their counts, so no
task ever ranks a shard. The window over blocks sees one narrow row for each ``BLOCK_ROWS`` records.

Defined cases: a null text has no bytes (size 16, CRC of nothing); rows with equal or null ids are
rows like any other; an empty table gives no rows, and its map deals slots in turn; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch

SLOTS, SHARDS = 4096, 40
#: Bytes that a record counts besides its text.
OVERHEAD = 16
#: A slot of more than one part in so many of a shard's share is dealt in parts.
HEAVY = 16
#: Neighbouring rows of a scratch file that are ranked together.
BLOCK_ROWS = 32_768

EDITS = "virtual_slot int, part int, parts int, shard int"


def virtual_slot(*key: str, slots: int = SLOTS) -> Column:
    """The slot of a record: depends on its key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


class SlotMap:
    """Versions of a slot-to-shard map in a folder that all executors share.

    A version is written once and never changed; writing one that exists fails, so of two edits
    of the same version only one wins.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots dealt to the shards in turn."""
        first = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.lit(0).alias("part"), F.lit(1).alias("parts"), (F.col("id") % shards).cast("int").alias("shard"))
        return cls(spark, path)._write(first, 1)

    def _write(self, edits: DataFrame, version: int) -> SlotMap:
        edits.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self

    def edits(self) -> DataFrame:
        """All versions: the slots that each one (re)placed."""
        return self.spark.read.schema(f"{EDITS}, version int").parquet(self.path)

    def version(self) -> int:
        return self.edits().agg(F.max("version")).first()[0]

    def at(self, version: int | None = None) -> DataFrame:
        """The whole map as of a version (the latest by default): each slot as last placed."""
        edits = self.edits() if version is None else self.edits().where(F.col("version") <= version)
        latest = F.max("version").over(Window.partitionBy("virtual_slot"))
        return edits.withColumn("latest", latest).where(F.col("version") == F.col("latest")).drop("latest")

    def rebalance(self, rows: DataFrame, shards: int) -> SlotMap:
        """Adds the version that spreads the bytes of rows(virtual_slot, address, size) over ``shards``; none if nothing moves."""
        version, current = self.version(), self.at()
        placed = dealt(part_loads(rows, current.select("virtual_slot").distinct(), shards), current, shards).persist()
        before = current.select("virtual_slot", "part", "parts", F.col("shard").alias("was"))
        moved = placed.join(before, ["virtual_slot", "part", "parts"], "left").where(~F.col("shard").eqNullSafe(F.col("was")))
        # a slot is placed anew as a whole, or its parts would come from several versions
        edits = placed.join(moved.select("virtual_slot").distinct(), "virtual_slot", "left_semi")
        try:
            return self if edits.isEmpty() else self._write(edits, version + 1)
        finally:
            placed.unpersist()


def part_loads(rows: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """Bytes of every part of every slot (slots without rows too): (virtual_slot, part, parts, bytes)."""
    loads = slots.join(rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")), "virtual_slot", "left")
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards  # over one row a slot
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("bytes", F.lit(0)) * HEAVY / share)).cast("int")
    slots = loads.select("virtual_slot", F.coalesce(parts, F.lit(1)).alias("parts"))
    split = _with_part(rows, slots).groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"))
    every = slots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return every.join(split, ["virtual_slot", "part"], "left").select("virtual_slot", "part", "parts", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def _with_part(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Tells rows which part of their slot they are in; ``slots`` has one row a slot."""
    return rows.join(F.broadcast(slots), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("address"), F.col("parts")).cast("int"))


def dealt(loads: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """Places the parts of slots: one fold over the sorted list of them, of bounded length."""
    homes = current.select("virtual_slot", "part", "parts", F.col("shard").alias("home"))
    entry = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "part", "parts", "bytes", F.when(F.col("home") < shards, F.col("home")).alias("home"))
    listed = loads.join(homes, ["virtual_slot", "part", "parts"], "left").agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.ceil(F.sum("bytes") / shards).alias("share"))
    empty = F.expr(f"transform(sequence(0, {shards - 1}), s -> named_struct('bytes', 0L, 'shard', s))")
    start = F.struct(empty.alias("loads"), F.expr("cast(array() as array<int>)").alias("placed"))

    def place(state: Column, e: Column) -> Column:
        own = F.get(state["loads"], e["home"])
        stays = e["home"].isNotNull() & ((own["bytes"] + e["bytes"] <= F.col("share")) | (e["bytes"] == 0))
        to = F.when(stays, e["home"]).otherwise(F.array_min(state["loads"])["shard"])
        return F.struct(F.transform(state["loads"], lambda x: F.when(x["shard"] == to, F.struct((x["bytes"] + e["bytes"]).alias("bytes"), x["shard"].alias("shard"))).otherwise(x)).alias("loads"), F.concat(state["placed"], F.array(to)).alias("placed"))

    folded = listed.select("entries", F.aggregate("entries", start, place, lambda s: s["placed"]).alias("placed"))
    pair = F.explode(F.arrays_zip("entries", "placed"))
    return folded.select(pair.alias("x")).select("x.entries.virtual_slot", "x.entries.part", "x.entries.parts", F.col("x.placed").alias("shard"))


def placed_in_shards(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, the place in the shard, to rows(shard, address(file, row)): gapless from 0."""
    block = ["shard", "_file", "_block"]
    rows = rows.withColumn("_file", F.col("address.file")).withColumn("_block", F.floor(F.col("address.row") / BLOCK_ROWS))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*block).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("address.row")) - 1
    return rows.withColumn("_rank", rank).join(starts, block).withColumn("slot", F.col("_before") + F.col("_rank")).drop("_file", "_block", "_before", "_rank")


def shard_documents(documents: DataFrame, shards: int = SHARDS, *, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, size, text_crc32, shard, slot, virtual_slot, map_version.

    ``map_path`` is the folder of a map to keep: it is created or, if it has versions, edited.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    kept = scratch.keep(sized.withColumn("virtual_slot", virtual_slot("doc_id", slots=slots)), "sizes")
    rows = kept.withColumn("address", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))
    if map_path is not None and _exists(spark, map_path):
        slot_map = SlotMap(spark, map_path)
    else:
        slot_map = SlotMap.create(spark, map_path or f"{scratch.root}/map", shards, slots)
    found = slot_map.rebalance(rows, shards).at()
    whole = _with_part(rows, found.select("virtual_slot", "parts").distinct())
    sharded = whole.join(F.broadcast(found.select("virtual_slot", "part", "shard")), ["virtual_slot", "part"])
    return placed_in_shards(sharded).select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", F.lit(slot_map.version()).alias("map_version"))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
