"""Keyed cache tables on Parquet: upsert by compaction, expiry, namespaces and validity.

A store is a folder with a table (key, cache, updated_at, expire_at). Each change writes a new
version beside the old one and renames it last, so readers see a whole version, a failed
write leaves the old one, and those that still read the old one can.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.scalars import namespaced

SCHEMA = "key string, cache string, updated_at timestamp, expire_at timestamp"


def latest(entries: DataFrame, key: str = "key", order: Iterable[str] = ("updated_at",)) -> DataFrame:
    """The last entry of each key by ``order``; combines before the shuffle."""
    order = list(order)
    rest = [c for c in entries.columns if c not in (*order, key)]
    newest = entries.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_n"))
    return newest.select(key, "_n.*").select(*entries.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """New entries replace old ones of their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def alive(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Without what has expired; no expiry means for ever."""
    return entries.where(F.col("expire_at").isNull() | (F.col("expire_at") > (now if now is not None else F.current_timestamp())))


def misses(wanted: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(entries.select(key), key, "left_anti")


def hits(wanted: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(entries, key)


def cached_scan(wanted: DataFrame, entries: DataFrame, fetch, key: str = "key", now: Column | None = None) -> DataFrame:
    """Wanted keys with their entries: alive ones from the cache, the others from ``fetch`` (missing keys -> entries), with ``from_cache``."""
    held = alive(entries, now) if "expire_at" in entries.columns else entries
    found = hits(wanted, held, key).withColumn("from_cache", F.lit(True))
    fresh = fetch(misses(wanted, held, key)).withColumn("from_cache", F.lit(False))
    return found.unionByName(fresh, allowMissingColumns=True)


def is_valid(stored_key: Column, key: Column, processed: Column, stored_hash: Column, content_hash: Column, stored_schema: Column | None = None, schema: Column | None = None) -> Column:
    """Same key, processed records present, same content hash, and the same schema if one was stored."""
    ok = (stored_key == key) & processed.isNotNull() & (stored_hash == content_hash)
    if stored_schema is not None:
        ok &= stored_schema.isNull() | (stored_schema == schema)
    return F.coalesce(ok, F.lit(False))


class CacheTable:
    """A key-value store: retrieve, update, delete, expiry; ``namespace`` prefixes its keys."""

    def __init__(self, spark: SparkSession, path: str, namespace: str | None = None, ttl: int | None = None) -> None:
        self.spark, self.path, self.namespace, self.ttl = spark, path.rstrip("/"), namespace, ttl

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[str]:
        """Whole versions, the oldest first: their names sort by time, and a version is renamed to its name once it is whole."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        return sorted(str(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().startswith("v-"))

    def _current(self) -> str | None:
        return (self._versions() or [None])[-1]

    def _key(self, key: Column) -> Column:
        return namespaced(key, self.namespace) if self.namespace else key

    def entries(self) -> DataFrame:
        version = self._current()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], SCHEMA)

    def retrieve_all(self) -> DataFrame:
        mine = alive(self.entries())
        return mine.where(F.col("key").startswith(f"{self.namespace}:")) if self.namespace else mine

    def retrieve(self, *keys: str) -> DataFrame:
        return self.retrieve_all().where(F.col("key").isin([self._named(k) for k in keys]))

    def _named(self, key: str) -> str:
        if not key:
            raise ValueError("a key must not be empty")
        return key if not self.namespace or key.startswith(f"{self.namespace}:") else f"{self.namespace}:{key}"

    def keys(self) -> DataFrame:
        return self.retrieve_all().select("key")

    def verify(self, key: str) -> bool:
        return not self.retrieve(key).isEmpty()

    def update(self, new: DataFrame) -> None:
        """``new``: key, cache; the last row of a key by cache text wins if it repeats."""
        expire = F.current_timestamp() + F.make_dt_interval(secs=F.lit(self.ttl)) if self.ttl else F.lit(None).cast("timestamp")
        rows = new.select(self._key(F.col("key")).alias("key"), "cache", F.current_timestamp().alias("updated_at"), expire.alias("expire_at"))
        self._replace(upsert(self.entries(), latest(rows, order=("updated_at", "cache"))))

    def delete(self, *keys: str) -> None:
        self._replace(self.entries().where(~F.col("key").isin([self._named(k) for k in keys])))

    def delete_all(self) -> None:
        """Of this namespace only, if it has one."""
        rest = self.entries().where(~F.col("key").startswith(f"{self.namespace}:")) if self.namespace else self.entries().limit(0)
        self._replace(rest)

    def _replace(self, frame: DataFrame) -> None:
        """Writes beside the table and renames, which switches readers at once; the last version before stays for those that read it."""
        old = self._versions()
        number = int(old[-1].split("-")[1]) + 1 if old else 1
        draft, version = f"{self.path}/draft-{uuid.uuid4().hex}", f"{self.path}/v-{number:012d}"
        frame.write.parquet(draft)
        fs, p = self._fs(draft)
        if not fs.rename(p, self._fs(version)[1]):
            fs.delete(p, True)
            raise RuntimeError(f"another writer has made {version}")
        for name in old[:-1]:
            fs.delete(self._fs(f"{self.path}/{name}")[1], True)


class NullTable(CacheTable):
    """Stores nothing."""

    def __init__(self, spark: SparkSession) -> None:
        super().__init__(spark, "")

    def __bool__(self) -> bool:
        return False

    def entries(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA)

    def _replace(self, frame: DataFrame) -> None:
        return None


class ViewTable(CacheTable):
    """Kept in memory as a cached frame of this session; expiry is ignored."""

    def __init__(self, spark: SparkSession, namespace: str | None = None) -> None:
        super().__init__(spark, "", namespace)
        self.frame = spark.createDataFrame([], SCHEMA)

    def entries(self) -> DataFrame:
        return self.frame

    def _replace(self, frame: DataFrame) -> None:
        old, self.frame = self.frame, frame.cache()
        self.frame.count()  # from the old one, which is then free
        old.unpersist()


class JdbcTable(CacheTable):
    """In a SQL database through JDBC; the new version goes to a staging table before it replaces the old."""

    def __init__(self, spark: SparkSession, url: str, table: str = "cache", namespace: str | None = None, ttl: int | None = None, properties: dict | None = None) -> None:
        super().__init__(spark, "", namespace, ttl)
        self.url, self.table, self.properties = url, table, properties or {}

    def entries(self) -> DataFrame:
        return self.spark.read.jdbc(self.url, self.table, properties=self.properties)

    def _replace(self, frame: DataFrame) -> None:
        frame.write.jdbc(self.url, f"{self.table}_new", mode="overwrite", properties=self.properties)
        staged = self.spark.read.jdbc(self.url, f"{self.table}_new", properties=self.properties)
        staged.write.option("truncate", "true").jdbc(self.url, self.table, mode="overwrite", properties=self.properties)


def open_store(kind: str, spark: SparkSession, **options) -> CacheTable:
    """memory, null, sql (upserts by key over DB-API), jdbc or parquet; the services redis and mongodb need a connector of their own."""
    from foliospark.sources.sqlstore import SqlTable  # it builds on this module

    makers = {"inmemory": ViewTable, "memory": ViewTable, "null": NullTable, "parquet": CacheTable, "jdbc": JdbcTable, "sql": SqlTable, "sqlite": SqlTable, "sqlalchemy": SqlTable}
    if kind not in makers:
        raise ValueError(f"no such store: {kind}")
    return makers[kind](spark, **options)
