"""Pages as a stream: landed files are parsed, normalised and upserted as they come."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.cache import CacheTable
from foliospark.operators.fieldmap import FieldMap
from foliospark.plans.workflow import search_plan
from foliospark.sources.pages import SCHEMA


def read_landed(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON lines of pages as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def distinct_pages(pages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each page once, as long as copies come within ``lateness``; state is dropped behind the watermark."""
    timed = pages.withColumn("event_time", F.to_timestamp("created_at")).withWatermark("event_time", lateness)
    return timed.dropDuplicatesWithinWatermark(["cache_key"]).drop("event_time")


def counts_by_window(pages: DataFrame, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Pages and failures of each provider per window of time."""
    timed = pages.withColumn("event_time", F.to_timestamp("created_at")).withWatermark("event_time", lateness)
    failed = F.count(F.when(F.col("status") != "processed", 1))
    return timed.groupBy(F.window("event_time", width), "provider_name").agg(F.count("*").alias("n_pages"), failed.alias("n_failed"))


def normalise_stream(pages: DataFrame, maps: Mapping[str, FieldMap], record_paths: Mapping[str, str], sink: str, checkpoint: str) -> StreamingQuery:
    """Appends normalised records to a Parquet folder, exactly once by the sink's log."""
    return search_plan(pages, maps, record_paths).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_stream(pages: DataFrame, store: CacheTable, checkpoint: str) -> StreamingQuery:
    """Upserts each batch of pages into a cache table; writing a batch twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.update(batch.select(F.col("cache_key").alias("key"), F.to_json(F.struct(*batch.columns)).alias("cache")))

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
