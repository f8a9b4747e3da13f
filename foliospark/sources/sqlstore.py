"""A cache table in a SQL database with upserts of single keys, as a data source with a reader and a writer.

Tasks put their rows into a staging table, each under a number of its own, and commit that. Once
all tasks have ended, one transaction replaces the keys that came and nothing else, taking the rows of
the attempts that Spark counts; a failed job drops the staging table and leaves the store as it was, and repeated attempts
of a task change nothing. The database is named by the import path of a function that opens a DB-API connection for a URL
(``sqlite_connect`` here), so each executor opens its own. The reader splits the table by ranges of keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from foliospark.operators.cache import SCHEMA, CacheTable, latest
from foliospark.sources.pages import named

COLUMNS = ("key", "cache", "updated_at", "expire_at")
BATCH = 1000


def sqlite_connect(url: str):
    import sqlite3

    return sqlite3.connect(url, timeout=60)


class _Database:
    """What reader and writer share: statements with ``?`` placeholders over one table; times are seconds since 1970."""

    def __init__(self, options: dict) -> None:
        self.url, self.table, self.connect = options["url"], options.get("table", "cache"), named(options.get("connect", "foliospark.sources.sqlstore:sqlite_connect"))
        if not self.table.isidentifier():
            raise ValueError(f"not a table name: {self.table!r}")

    def run(self, *statements: tuple[str, tuple] | str) -> list[tuple]:
        """All statements in one transaction; the rows of the last one."""
        connection = self.connect(self.url)
        try:
            cursor = connection.cursor()
            for s in statements:
                cursor.execute(*((s,) if isinstance(s, str) else s))
            rows = cursor.fetchall() if cursor.description else []
            connection.commit()
            return rows
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def create(self, table: str, extra: str = "") -> str:
        return f"CREATE TABLE IF NOT EXISTS {table} (key TEXT NOT NULL, cache TEXT, updated_at DOUBLE PRECISION, expire_at DOUBLE PRECISION{extra})"

    def ready(self) -> None:
        self.run(self.create(self.table), f"CREATE UNIQUE INDEX IF NOT EXISTS {self.table}_key ON {self.table} (key)")


@dataclass
class _Range(InputPartition):
    low: str | None
    high: str | None
    keys: list[str] | None = None

    def __init__(self, low: str | None, high: str | None, keys: list[str] | None = None) -> None:
        super().__init__((low, high))
        self.low, self.high, self.keys = low, high, keys


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.parts = dict(options), int(options.get("partitions", "8"))
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists of keys become statements on the index."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = values if self.keys is None else self.keys & values
            else:
                yield f

    def partitions(self) -> list[_Range]:
        database = _Database(self.options)
        database.ready()
        if self.keys is not None:
            keys = sorted(k for k in self.keys if k is not None)
            return [_Range(None, None, keys[a : a + BATCH]) for a in range(0, len(keys), BATCH)] or [_Range(None, None, [])]
        (n,) = database.run(f"SELECT count(*) FROM {database.table}")[0]
        step = max(1, -(-n // self.parts))
        cuts = [database.run((f"SELECT key FROM {database.table} ORDER BY key LIMIT 1 OFFSET ?", (at,)))[0][0] for at in range(step, n, step)]
        return [_Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        from datetime import UTC, datetime

        database = _Database(self.options)
        wanted, values = [], []
        if partition.keys is not None:
            wanted, values = [f"key IN ({', '.join('?' * len(partition.keys))})"], partition.keys
        for sign, bound in ((">=", partition.low), ("<", partition.high)):
            if bound is not None:
                wanted.append(f"key {sign} ?")
                values = [*values, bound]
        connection = database.connect(database.url)
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {', '.join(COLUMNS)} FROM {database.table}" + (f" WHERE {' AND '.join(wanted)}" if wanted else ""), tuple(values))
            at = lambda t: None if t is None else datetime.fromtimestamp(t, UTC)
            while rows := cursor.fetchmany(BATCH):
                yield from ((key, cache, at(updated), at(expire)) for key, cache, updated, expire in rows)
        finally:
            connection.close()


@dataclass
class _Staged(WriterCommitMessage):
    attempt: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        database = _Database(self.options)
        self.stage = f"{database.table}_stage_{uuid.uuid4().hex}"
        database.ready()
        database.run(database.create(self.stage, ", attempt TEXT"))

    def write(self, rows: Iterator[Row]) -> _Staged:
        database, attempt = _Database(self.options), uuid.uuid4().hex
        seconds = lambda t: None if t is None else t.timestamp()
        connection = database.connect(database.url)
        try:
            cursor, batch = connection.cursor(), []

            def send() -> None:
                cursor.executemany(f"INSERT INTO {self.stage} VALUES (?, ?, ?, ?, ?)", batch)
                connection.commit()  # a lock on the database is held for a batch only
                batch.clear()

            for r in rows:
                batch.append((r["key"], r["cache"], seconds(r["updated_at"]), seconds(r["expire_at"]), attempt))
                if len(batch) >= BATCH:
                    send()
            if batch:
                send()
        finally:
            connection.close()
        return _Staged(attempt)

    def commit(self, messages: list[_Staged | None]) -> None:
        database = _Database(self.options)
        counted = f"{self.stage}_counted"
        gone = f"DELETE FROM {self.stage} WHERE attempt NOT IN (SELECT attempt FROM {counted})"
        put = [(f"INSERT INTO {counted} VALUES (?)", (m.attempt,)) for m in messages if m]
        old = f"DELETE FROM {database.table} WHERE key IN (SELECT key FROM {self.stage})"
        new = [] if self.options.get("action") == "delete" else [f"INSERT INTO {database.table} SELECT {', '.join(COLUMNS)} FROM {self.stage}"]
        database.run(f"CREATE TABLE {counted} (attempt TEXT)", *put, gone, old, *new, f"DROP TABLE {counted}", f"DROP TABLE {self.stage}")

    def abort(self, messages: list[_Staged | None]) -> None:
        database = _Database(self.options)
        database.run(f"DROP TABLE IF EXISTS {self.stage}")


class SqlSource(DataSource):
    """``format("folio_sql")`` with options ``url``, ``table``, ``connect`` and, for reads, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "folio_sql"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("this source upserts; use mode append")
        return _Writer(self.options)


class SqlTable(CacheTable):
    """A cache store in a SQL database; an update or delete touches its own keys only."""

    def __init__(self, spark: SparkSession, url: str, table: str = "cache", namespace: str | None = None, ttl: int | None = None, connect: str = "foliospark.sources.sqlstore:sqlite_connect") -> None:
        super().__init__(spark, "", namespace, ttl)
        self.options = {"url": url, "table": table, "connect": connect}
        spark.dataSource.register(SqlSource)

    def entries(self) -> DataFrame:
        return self.spark.read.format("folio_sql").options(**self.options).load()

    def _write(self, rows: DataFrame, action: str) -> None:
        rows.write.format("folio_sql").options(**self.options, action=action).mode("append").save()

    def update(self, new: DataFrame) -> None:
        expire = F.current_timestamp() + F.make_dt_interval(secs=F.lit(self.ttl)) if self.ttl else F.lit(None).cast("timestamp")
        rows = new.select(self._key(F.col("key")).alias("key"), "cache", F.current_timestamp().alias("updated_at"), expire.alias("expire_at"))
        self._write(latest(rows, order=("updated_at", "cache")), "upsert")

    def delete(self, *keys: str) -> None:
        self._write(self.spark.createDataFrame([(self._named(k), None, None, None) for k in keys], SCHEMA), "delete")

    def delete_all(self) -> None:
        """Of this namespace only, if it has one."""
        database = _Database(self.options)
        database.ready()
        mine = (f"DELETE FROM {database.table} WHERE substr(key, 1, ?) = ?", (len(self.namespace) + 1, f"{self.namespace}:")) if self.namespace else f"DELETE FROM {database.table}"
        database.run(mine)
