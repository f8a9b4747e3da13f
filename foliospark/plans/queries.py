"""One query per operator over the driver's tables, with the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import paths as P
from foliospark.functions import scalars as S
from foliospark.functions.jsonpath import extract_key, path_values
from foliospark.functions.security import KeyMask, StringMask, mask_text
from foliospark.operators import cache as C
from foliospark.operators import records as R
from foliospark.operators import results as X
from foliospark.operators.fieldmap import UNIVERSAL_FIELDS, AcademicMap, FieldMap, coverage, first_by, normalise_pages, rename_flat
from foliospark.plans.workflow import carry_metadata, hand_off, search_plan
from foliospark.sources.parse import is_valid_response, parse_pages, rebuilt
from foliospark.sources.providers import PROVIDERS, Registry, request_parameters, request_url
from foliospark.sources.requests import endpoint, fetch_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- inputs shared by the queries ---


def orders_json(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey and a nested JSON record: id, status, customer {key, name, segment}, lines [{number, part, supplier, quantity}].

    The join is by shuffle whatever the sizes of the files say: broadcast, all records would be made in the tasks that the file of orders gives, often one.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("sorted"))
    named = F.transform("sorted", lambda x: F.struct(x["l_linenumber"].alias("number"), x["l_partkey"].alias("part"), x["l_suppkey"].alias("supplier"), x["quantity"].alias("quantity")))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    customer = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return orders.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), customer.alias("customer"), named.alias("lines"))).alias("record"))


def documents_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("origin"), F.struct(F.col("lang").alias("code")).alias("language"), F.col("n_chars"))).alias("record"))


def event_pages(spark: SparkSession, d: str) -> DataFrame:
    """Events read as result pages of three providers."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("query"),
        F.concat(F.lit("Prov_"), (F.col("user_id") % 3).cast("string")).alias("provider_name"),
        F.col("event_id").cast("int").alias("page"),
        F.when(F.col("event_type") == "error", "error").otherwise("processed").alias("status"),
        (F.col("user_id") * 7 % 40).cast("long").alias("hits"),
    )


PAGE_SQL = "SELECT event_type AS query, 'Prov_' || CAST(user_id % 3 AS VARCHAR) AS provider_name, CAST(event_id AS INTEGER) AS page, CASE WHEN event_type = 'error' THEN 'error' ELSE 'processed' END AS status, user_id * 7 % 40 AS hits FROM events"
LINES_SQL = "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS parts, count(*) AS n FROM lineitem GROUP BY 1"
ORDERS_SQL = f"SELECT o_orderkey, o_orderstatus, c_custkey, c_name, c_mktsegment, parts, coalesce(n, 0) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN ({LINES_SQL}) l ON l_orderkey = o_orderkey"

ORDER_MAP = AcademicMap("orders_api", {"record_id": "id", "title": "customer.name", "subjects": "customer.segment", "keywords": "lines.part", "record_type": "status"}, {"customer_key": "customer.key"}, {"language": "und"})
DOC_MAP = AcademicMap("docs_api", {"record_id": ["missing", "id"], "journal": "origin", "language": "language.code"}, {"n_chars": "n_chars"}, {"publisher": "unknown"})


def _universal(values: dict[str, str], extras: str) -> str:
    return ", ".join(f"{values.get(f, 'CAST(NULL AS VARCHAR)')} AS {f}" for f in UNIVERSAL_FIELDS) + extras


_ORDER_COLUMNS = {"provider_name": "'orders_api'", "record_id": "CAST(o_orderkey AS VARCHAR)", "title": "c_name", "subjects": "c_mktsegment", "keywords": "parts", "record_type": "o_orderstatus", "language": "'und'"}
_DOC_COLUMNS = {"provider_name": "'docs_api'", "record_id": "CAST(doc_id AS VARCHAR)", "journal": "source", "language": "lang", "publisher": "'unknown'"}


# --- field maps ---


@query("SELECT 'customers' AS provider_name, CAST(c_custkey AS VARCHAR) AS record_id, c_name AS title, c_mktsegment AS subjects, CAST(NULL AS VARCHAR) AS journal FROM customer")
def field_map_flat(spark, d):
    return rename_flat(table(spark, d, "customer"), {"record_id": "c_custkey", "title": "c_name", "subjects": "c_mktsegment", "journal": None}, "customers")


@query(f"SELECT 'nested' AS provider_name, CAST(o_orderkey AS VARCHAR) AS record_id, c_name AS title, parts AS keywords, o_orderstatus AS record_type FROM ({ORDERS_SQL}) t")
def field_map_nested(spark, d):
    return FieldMap("nested", {"record_id": "id", "title": "customer.name", "keywords": "lines.part", "record_type": "status"}).normalise(orders_json(spark, d), delimiter="; ")


@query("SELECT event_id, 'events' AS provider_name, json_extract_string(props, '$.k') AS value FROM events")
def field_map_fallback(spark, d):
    return FieldMap("events", {"value": ["missing", "k"]}).normalise(table(spark, d, "events"), "props", keep=["event_id"], delimiter="; ")


@query("SELECT event_id, 'events' AS provider_name, json_extract_string(props, '$.k') AS value, 'none' AS other FROM events")
def field_map_defaults(spark, d):
    return FieldMap("events", {"value": "k", "other": "missing"}, {}, {"other": "none", "value": "0"}).normalise(table(spark, d, "events"), "props", keep=["event_id"], delimiter="; ")


@query(f"SELECT {_universal(_DOC_COLUMNS, ', CAST(n_chars AS VARCHAR) AS n_chars')} FROM documents")
def universal_schema(spark, d):
    return DOC_MAP.normalise(documents_json(spark, d), delimiter="; ")


@query(
    f"SELECT {_universal(_ORDER_COLUMNS, ', CAST(c_custkey AS VARCHAR) AS customer_key, CAST(NULL AS VARCHAR) AS n_chars')} FROM ({ORDERS_SQL}) t"
    f" UNION ALL SELECT {_universal(_DOC_COLUMNS, ', CAST(NULL AS VARCHAR) AS customer_key, CAST(n_chars AS VARCHAR) AS n_chars')} FROM documents"
)
def normalize_union(spark, d):
    rows = orders_json(spark, d).select(F.lit("orders_api").alias("provider"), "record").unionByName(documents_json(spark, d).select(F.lit("docs_api").alias("provider"), "record"))
    return normalise_pages(rows, {"orders_api": ORDER_MAP, "docs_api": DOC_MAP}, delimiter="; ")


# --- projections ---


@query(f"SELECT o_orderkey, o_orderstatus AS status, c_name AS \"customer.name\" FROM ({ORDERS_SQL}) t")
def path_select(spark, d):
    return R.select_paths(orders_json(spark, d), ["status", "customer.name"], keep=["o_orderkey"])


@query(f"SELECT o_orderkey, c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS customer FROM ({ORDERS_SQL}) t")
def path_select_rename(spark, d):
    return R.select_paths(orders_json(spark, d), {"segment": "customer.segment", "customer": "customer.key"}, keep=["o_orderkey"])


@query("SELECT o_orderkey, CAST(p AS VARCHAR) AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, first(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def path_index(spark, d):
    return orders_json(spark, d).select("o_orderkey", F.get(path_values(F.col("record"), ["lines", 0, "part"]), F.lit(0)).alias("first_part"))


@query(f"SELECT o_orderkey, parts FROM ({ORDERS_SQL}) t")
def wildcard_list_join(spark, d):
    return orders_json(spark, d).select("o_orderkey", S.collapse(path_values(F.col("record"), "lines.part")).alias("parts"))


@query(f"SELECT o_orderkey, n AS n_values, CASE WHEN n = 1 THEN parts END AS only_part FROM ({ORDERS_SQL}) t")
def collapse_single(spark, d):
    values = path_values(F.col("record"), "lines.part")
    return orders_json(spark, d).select("o_orderkey", F.size(values).cast("long").alias("n_values"), F.when(F.size(values) == 1, S.collapse(values)).alias("only_part"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def idempotent_select(spark, d):
    flat = table(spark, d, "customer").select("c_custkey", F.to_json(F.create_map(F.lit("customer.name"), F.col("c_name"))).alias("record"))
    return flat.select("c_custkey", S.collapse(extract_key(F.col("record"), "customer.name")).alias("name"))


# --- filters ---


def _sparse_events(spark, d):
    code = F.when(F.col("event_type") == "error", F.col("event_id"))
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.array(F.struct(code.alias("error_code"))).alias("details"))).alias("record"))


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def keep_keys_exact(spark, d):
    return R.filter_records(_sparse_events(spark, d), keep_keys=["error_code"], regex=False).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def keep_keys_regex(spark, d):
    return R.filter_records(_sparse_events(spark, d), keep_keys=["err.*"]).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'error' OR event_type IS NULL")
def ignore_keys(spark, d):
    return R.filter_records(_sparse_events(spark, d), ignore_keys=["error_.*"]).select("event_id")


@query(f"SELECT * FROM ({PAGE_SQL}) t WHERE status = 'processed'")
def filter_success(spark, d):
    return X.succeeded(event_pages(spark, d))


@query(f"SELECT * FROM ({PAGE_SQL}) t WHERE status <> 'processed'")
def filter_failed(spark, d):
    return X.succeeded(event_pages(spark, d), invert=True)


@query(f"SELECT * FROM ({PAGE_SQL}) t WHERE query = 'click' AND provider_name = 'Prov_1' AND page IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def select_pages(spark, d):
    return X.select_pages(event_pages(spark, d), "click", "prov1", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])


# --- results ---


@query("SELECT 'orders' AS provider_name, CAST(o_orderkey AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS record_idx, CAST(l_partkey AS VARCHAR) AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def join_records(spark, d):
    pages = orders_json(spark, d).select(F.lit("q").alias("query"), F.lit("orders").alias("provider_name"), F.col("o_orderkey").cast("int").alias("page"), F.from_json(F.get_json_object("record", "$.lines"), "array<string>").alias("records"))
    return X.join_records(pages).select("provider_name", "page", "record_idx", F.get_json_object("record", "$.part").alias("part"))


@query(f"SELECT o_orderkey, CAST(n AS INTEGER) AS n_records FROM ({ORDERS_SQL}) t")
def record_count(spark, d):
    return orders_json(spark, d).select("o_orderkey", X.record_count(F.from_json(F.get_json_object("record", "$.lines"), "array<string>")).alias("n_records"))


@query(f"SELECT sum(n) AS n_records FROM ({ORDERS_SQL}) t")
def total_record_count(spark, d):
    return record_count(spark, d).agg(F.sum("n_records").cast("decimal(38,0)").alias("n_records"))


@query(f"SELECT DISTINCT lower(replace(provider_name, '_', '')) AS provider FROM ({PAGE_SQL}) t")
def providers_distinct(spark, d):
    return X.providers(event_pages(spark, d))


@query(f"SELECT query, provider_name, page, CASE WHEN status = 'processed' THEN hits END AS total_query_hits, CASE WHEN status = 'processed' THEN 10 END AS records_per_page, CASE WHEN status = 'processed' THEN greatest(0, CAST(ceil(hits / 10.0) AS BIGINT) - page) END AS pages_remaining FROM ({PAGE_SQL}) t")
def page_metadata(spark, d):
    return X.metadata_rows(event_pages(spark, d), F.col("hits"), F.lit(10))


@query("SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN greatest(0, CAST(ceil(user_id / 7.0) AS BIGINT) - event_id % 4) END AS pages_remaining FROM events")
def pages_remaining(spark, d):
    hits = F.when(F.col("user_id") % 5 != 0, F.col("user_id"))
    return table(spark, d, "events").select("event_id", S.pages_remaining(F.col("event_id") % 4, hits, F.lit(7)).alias("pages_remaining"))


@query(f"SELECT query, provider_name, page, status, hits FROM (SELECT *, min(CASE WHEN hits = 0 OR (status = 'error' AND page > 0) THEN page END) OVER (PARTITION BY provider_name, query) AS stop FROM ({PAGE_SQL}) t) u WHERE stop IS NULL OR page <= stop")
def halt_rule(spark, d):
    halt = X.halt_rule(F.lit(10), F.lit(10), F.col("hits"), F.col("status") == "error")
    return X.until_halt(event_pages(spark, d), halt)


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY provider_name ORDER BY page) AS INTEGER) AS turn FROM ({PAGE_SQL}) t")
def round_robin(spark, d):
    return X.round_robin(event_pages(spark, d))


# --- scalars ---


@query("SELECT event_id, 1 + ((event_id % 9) - 1) * 25 AS calculated, CASE WHEN event_id % 9 >= 1 THEN event_id % 9 END AS plain, CASE WHEN event_id % 9 >= 1 THEN ((event_id % 9) - 1) * 25 END AS zero_based FROM events WHERE event_id % 9 >= 1 UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 9 < 1")
def start_index(spark, d):
    page, size = F.col("event_id") % 9, F.lit(25).cast("long")
    return table(spark, d, "events").select("event_id", S.start_index(page, size).alias("calculated"), S.start_index(page, size, auto_calculate=False).alias("plain"), S.start_index(page, size, zero_indexed=True).alias("zero_based"))


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct([c_nationkey, c_custkey % 10, 3])), ',') AS pages FROM customer")
def page_list(spark, d):
    pages = S.page_list(F.array(F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 10).cast("string"), F.lit("3")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^(?:https?://)?(?:www\\.)?', 'https://'), '/+$', '') AS url, regexp_replace(regexp_replace(regexp_replace(url, '^(?:https?://)?(?:www\\.)?', 'https://'), '[?#;].*$', ''), '/+$', '') AS bare FROM pages")
def normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", S.normalize_url(F.col("url")).alias("url"), S.normalize_url(F.col("url"), keep_parameters=False).alias("bare"))


@query("SELECT page_id, regexp_replace(url, '[?#;].*$', '') AS bare FROM pages")
def strip_params(spark, d):
    return table(spark, d, "pages").select("page_id", S.strip_parameters(F.col("url")).alias("bare"))


@query(r"SELECT page_id, nullif(regexp_extract(url, '^https?://(?:[^/?#]*?\.)?([^./?#]+)\.(?:com|org|net|ac\.uk|io|gov|edu)(?:[/?#:]|$)', 1), '') AS name FROM pages")
def url_basename(spark, d):
    return table(spark, d, "pages").select("page_id", S.url_basename(F.col("url")).alias("name"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^/?#\s]+') AS valid FROM pages")
def url_valid(spark, d):
    return table(spark, d, "pages").select("page_id", S.valid_url(F.col("url")).alias("valid"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"))


@query("SELECT event_id, lower('Prov_' || CAST(user_id % 3 AS VARCHAR) || '_' || event_type || '_' || CAST(event_id AS VARCHAR) || '_25') AS key FROM events")
def cache_key(spark, d):
    return table(spark, d, "events").select("event_id", S.search_cache_key(F.concat(F.lit("Prov_"), (F.col("user_id") % 3).cast("string")), F.col("event_type"), F.col("event_id"), F.lit(25)).alias("key"))


@query("SELECT page_id, sha256(regexp_replace(url, '^[A-Za-z]+://', '') || '_200') AS key FROM pages")
def url_cache_key(spark, d):
    return table(spark, d, "pages").select("page_id", S.url_cache_key(F.col("url"), F.lit(200)).alias("key"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)(password["'']?\s*[:=]\s*["'']?)([A-Za-z0-9\-_.~%+/=@]+)', '\1***', 'g'),
    '[A-Za-z0-9._%+-]+(?:@|%40)[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '***', 'g') AS text FROM documents"""
)
def mask_documents(spark, d):
    masks = (KeyMask("password"), StringMask(r"[A-Za-z0-9._%+-]+(?:@|%40)[A-Za-z0-9.-]+\.[A-Za-z]{2,}", regex=True))
    return table(spark, d, "documents").select("doc_id", mask_text(F.col("text"), masks).alias("text"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS valid FROM customer")
def email_valid(spark, d):
    text = F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.when(F.col("c_custkey") % 2 == 0, "@mail.org").otherwise("@mail"))
    return table(spark, d, "customer").select("c_custkey", S.valid_email(text).alias("valid"))


@query("SELECT event_id, TRY_CAST(trim(json_extract_string(props, '$.k')) AS BIGINT) AS k, CAST(NULL AS BIGINT) AS none FROM events")
def coerce_int(spark, d):
    return table(spark, d, "events").select("event_id", S.coerce_int(F.get_json_object("props", "$.k")).alias("k"), S.coerce_int(F.concat("event_type", F.lit("1"))).alias("none"))


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def iso_timestamp(spark, d):
    return table(spark, d, "events").select("event_id", S.iso_timestamp(F.col("ts")).alias("iso"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'xml' WHEN 1 THEN 'json' WHEN 2 THEN 'yaml' WHEN 3 THEN 'yaml' ELSE 'unknown' END AS format FROM events")
def detect_format(spark, d):
    kinds = F.array(*map(F.lit, ("text/XML", "application/json; charset=utf-8", "application/x-yaml", "text/yml", "text/plain")))
    return table(spark, d, "events").select("event_id", S.detect_format(F.get(kinds, (F.col("event_id") % 5).cast("int"))).alias("format"))


@query("SELECT event_id, event_id % 600 BETWEEN 200 AND 399 AS ok, event_id % 600 IN (429, 500, 503, 504) AS again FROM events")
def status_predicates(spark, d):
    code = F.col("event_id") % 600
    return table(spark, d, "events").select("event_id", S.status_ok(code).alias("ok"), S.retryable(code).alias("again"))


@query("SELECT doc_id, CASE WHEN length(text) > 20 THEN left(text, 17) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.truncated(F.col("text"), 20).alias("short"))


@query("SELECT c_custkey, '<hashbytes>' || to_base64(encode(c_name)) AS encoded, c_name AS decoded FROM customer")
def binary_codec(spark, d):
    encoded = S.encode_bytes(F.col("c_name").cast("binary"))
    return table(spark, d, "customer").select("c_custkey", encoded.alias("encoded"), S.coerce_str(S.decode_bytes(encoded)).alias("decoded"))


@query("SELECT c_custkey, 'ns:' || c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN '''' || c_custkey || '''' ELSE c_name END AS quoted FROM customer")
def namespaced_keys(spark, d):
    key = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ns:"), "c_name")).otherwise(F.col("c_name"))
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.namespaced(key, "ns").alias("key"), S.quote_numeric(value).alias("quoted"))


@query("SELECT page_id, url, CAST(200 + page_id % 300 AS INTEGER) AS status_code, html AS content, regexp_matches(url, '^https?://[^/?#\\s]+') AS valid FROM pages")
def rebuild_response(spark, d):
    raw = table(spark, d, "pages").select("page_id", "url", (F.lit(200) + F.col("page_id") % 300).cast("string").alias("status"), F.col("html").alias("_content"), F.lit("").alias("text"))
    made = rebuilt(raw)
    return made.select("page_id", "url", "status_code", "content", is_valid_response(F.col("status_code"), F.col("url"), F.col("reason"), F.col("content")).alias("valid"))


# --- paths and flattening ---

_LEAVES = f"""SELECT o_orderkey, 'id' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM ({ORDERS_SQL}) a
UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM ({ORDERS_SQL}) b
UNION ALL SELECT o_orderkey, 'customer.key', CAST(c_custkey AS VARCHAR) FROM ({ORDERS_SQL}) c
UNION ALL SELECT o_orderkey, 'customer.name', c_name FROM ({ORDERS_SQL}) d
UNION ALL SELECT o_orderkey, 'customer.segment', c_mktsegment FROM ({ORDERS_SQL}) e
UNION ALL SELECT o_orderkey, 'lines.' || i || f.path, f.value FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer)) g, LATERAL (VALUES ('.number', CAST(l_linenumber AS VARCHAR)), ('.part', CAST(l_partkey AS VARCHAR)), ('.supplier', CAST(l_suppkey AS VARCHAR)), ('.quantity', CAST(q AS VARCHAR))) f(path, value)"""


def _order_nodes(spark, d):
    return R.nodes(orders_json(spark, d), keep=["o_orderkey"])


def _order_paths(spark, d):
    """The leaves' paths of each order in one array."""
    return orders_json(spark, d).select("o_orderkey", R.leaf_list(F.col("record")).alias("leaves")).select("o_orderkey", F.col("leaves.path").alias("paths"))


@query(_LEAVES)
def flatten_leaves(spark, d):
    return _order_nodes(spark, d).select("o_orderkey", P.join_path(F.col("path")).alias("path"), "value")


@query(f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, c_name AS customer_name, parts AS lines_part FROM ({ORDERS_SQL}) t")
def flatten_wide(spark, d):
    return R.to_wide(R.flatten_records(orders_json(spark, d), keep=["o_orderkey"]), ["id", "customer.name", "lines.part"], keep=["o_orderkey"])


_KEYS = "(VALUES ('id', 'id', true), ('status', 'status', true), ('customer', 'customer', false), ('key', 'customer.key', true), ('name', 'customer.name', true), ('segment', 'customer.segment', true), ('lines', 'lines', false), ('number', 'lines.number', true), ('part', 'lines.part', true), ('supplier', 'lines.supplier', true), ('quantity', 'lines.quantity', true)) t(key, paths, terminal)"


def _order_keys(spark, d):
    return R.discover_keys(orders_json(spark, d))


@query(f"SELECT * FROM {_KEYS}")
def discover_keys(spark, d):
    return _order_keys(spark, d).select("key", F.array_join("paths", ",").alias("paths"), "terminal")


@query(f"SELECT paths AS path FROM {_KEYS} WHERE terminal")
def terminal_paths(spark, d):
    return _order_keys(spark, d).where("terminal").select(F.explode("paths").alias("path"))


@query(f"SELECT key FROM {_KEYS} WHERE key LIKE 's%' OR key LIKE 'n%' OR paths LIKE '%lines%'")
def key_filter(spark, d):
    return R.filter_keys(_order_keys(spark, d), substring="lines", pattern="[sn].*").select("key")


@query(f"SELECT regexp_replace(path, '\\.[0-9]+', '.i', 'g') AS grp, count(*) AS n FROM ({_LEAVES}) t GROUP BY 1")
def path_groups(spark, d):
    paths = _order_nodes(spark, d).groupBy("path").agg(F.count("*").alias("n"))  # a path's group is found once, not for each leaf
    return paths.groupBy(P.join_path(P.group(F.col("path"))).alias("grp")).agg(F.sum("n").alias("n"))


@query(f"SELECT o_orderkey, path FROM ({_LEAVES}) t WHERE path LIKE 'customer.%'")
def path_prefix_filter(spark, d):
    return _order_nodes(spark, d).where(P.starts_with(F.col("path"), F.array(F.lit("customer")))).select("o_orderkey", P.join_path(F.col("path")).alias("path"))


@query(f"SELECT o_orderkey, path FROM ({_LEAVES}) t WHERE regexp_matches(path, '[0-9]\\.(part|supplier)$')")
def path_pattern_search(spark, d):
    rows = _order_nodes(spark, d).withColumn("path", P.join_path(F.col("path")))
    return rows.where(F.col("path").rlike(r"[0-9]\.(part|supplier)$")).select("o_orderkey", "path")


@query(f"SELECT o_orderkey, path, CAST(len(string_split(path, '.')) AS INTEGER) AS depth, list_last(list_filter(string_split(path, '.'), lambda x: NOT regexp_matches(x, '^[0-9]+$'))) AS name, array_to_string(string_split(path, '.')[1:len(string_split(path, '.')) - 1], '.') AS parent, len(string_split(path, '.')) || '.' || array_to_string(list_transform(string_split(path, '.'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 8, '0') ELSE x END), '.') AS sort_key FROM ({_LEAVES}) t")
def path_functions(spark, d):
    path = F.col("path")
    return _order_nodes(spark, d).select("o_orderkey", P.join_path(path).alias("path"), P.depth(path).alias("depth"), P.name(path).alias("name"), P.join_path(P.parent(path)).alias("parent"), P.sort_key(path).alias("sort_key"))


def _event_records(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct(F.col("user_id").alias("name")).alias("user"), F.struct(F.col("event_type").alias("name")).alias("event"))).alias("record"))


@query("SELECT event_id, event_type AS name, CAST(user_id AS VARCHAR) AS user_name FROM events")
def path_simplify_rows(spark, d):
    return R.to_wide(R.path_rows(_event_records(spark, d), keep=["event_id"]), ["name", "user.name"], keep=["event_id"])


@query("SELECT event_type, 'stats.values.value.' || event_type || '.count' AS path, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY 1")
def combine_value_counts(spark, d):
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    records = counted.select("event_type", F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("value"), F.col("n").alias("count")).alias("values")).alias("stats"))).alias("record"))
    made = R.combine_counts(R.nodes(records, keep=["event_type"]), ["event_type"])
    return made.select("event_type", P.join_path(F.col("path")).alias("path"), "value")


@query(f"SELECT o_orderkey, path FROM ({_LEAVES}) t")
def deepest_paths(spark, d):
    records = _order_paths(spark, d).select("o_orderkey", F.concat("paths", F.flatten(F.transform("paths", P.ancestors))).alias("paths"))
    return records.select("o_orderkey", F.explode(R.deepest(F.col("paths"))).alias("path")).select("o_orderkey", P.join_path(F.col("path")).alias("path"))


# --- extraction and parsing ---


def _customer_pages(spark, d):
    rec = F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("title"))
    grouped = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(rec)).alias("recs"))
    return grouped.select("o_custkey", F.to_json(F.struct(F.struct("total", F.lit("x").alias("unit")).alias("info"), F.array(F.lit(1), F.lit(2)).alias("dropped"), F.struct(F.col("recs").alias("items")).alias("body"))).alias("content"))


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS order_id FROM orders")
def dynamic_extract_records(spark, d):
    found = R.extract_dynamic(_customer_pages(spark, d), keep=["o_custkey"])
    return found.select("o_custkey", F.explode("records").alias("r")).select("o_custkey", F.get_json_object("r", "$.order").alias("order_id"))


@query("SELECT o_custkey, CAST(count(*) AS VARCHAR) AS total, 'x' AS unit FROM orders GROUP BY 1")
def dynamic_extract_metadata(spark, d):
    found = R.extract_dynamic(_customer_pages(spark, d), keep=["o_custkey"])
    return found.select("o_custkey", F.element_at("metadata", "total").alias("total"), F.element_at("metadata", "unit").alias("unit"))


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) - 1 AS INTEGER) AS record_idx, o_orderstatus AS title FROM orders")
def explicit_extract_records(spark, d):
    rows = R.explode_records(_customer_pages(spark, d), "body.items", keep=["o_custkey"])
    return rows.select("o_custkey", "record_idx", F.get_json_object("record", "$.title").alias("title"))


@query("SELECT o_custkey, CAST(count(*) AS VARCHAR) AS hits FROM orders GROUP BY 1")
def explicit_extract_metadata(spark, d):
    return R.page_metadata(_customer_pages(spark, d), {"hits": "info.total"}, keep=["o_custkey"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def parse_xml_records(spark, d):
    item = F.concat(F.lit('<nation id="'), F.col("n_nationkey").cast("string"), F.lit('"><name>'), "n_name", F.lit("</name></nation>"))
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<r><nation id='-1'/>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</r>")).alias("content")).withColumn("content_type", F.lit("text/xml"))
    rows = R.explode_records(parse_pages(pages), "r.nation")
    return R.select_paths(rows, {"id": "@id", "name": "name"}).where("id <> '-1'")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region")
def parse_yaml_records(spark, d):
    text = F.concat(F.lit("region:\n  id: "), F.col("r_regionkey").cast("string"), F.lit("\n  name: '"), "r_name", F.lit("'\n"))
    pages = table(spark, d, "region").select(text.alias("content"), F.lit("application/yaml").alias("content_type"))
    return R.select_paths(parse_pages(pages), {"id": "region.id", "name": "region.name"}, "content")


# --- cache ---


def _entries(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("updated_at"), "event_id", "event_type")


_LATEST = "SELECT key, updated_at, event_id, event_type FROM (SELECT CAST(user_id AS VARCHAR) AS key, ts AS updated_at, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1"


@query(_LATEST)
def cache_upsert_latest(spark, d):
    return C.latest(_entries(spark, d), order=("updated_at", "event_id"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS key, event_type FROM customer JOIN ({_LATEST}) l ON key = CAST(c_custkey AS VARCHAR)")
def cache_hit(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return C.hits(wanted, cache_upsert_latest(spark, d)).select("key", "event_type")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def cache_miss_anti(spark, d):
    return C.misses(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")), _entries(spark, d))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > (SELECT max(ts) FROM events)")
def cache_ttl(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("now"))
    return C.alive(e.withColumn("expire_at", F.col("ts") + F.expr("INTERVAL 1 DAY")).join(F.broadcast(newest)), F.col("now")).select("event_id")


@query("SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS valid FROM documents")
def cache_validity(spark, d):
    k = F.col("doc_id")
    stored = F.when(k % 5 == 0, F.lit("old")).otherwise(S.content_hash(F.col("text")))
    valid = C.is_valid(k, k, F.when(k % 3 != 0, "records"), stored, S.content_hash(F.col("text")), F.when(k % 7 == 0, F.lit("v1")), F.lit("v2"))
    return table(spark, d, "documents").select("doc_id", valid.alias("valid"))


# --- downstream ---


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) t WHERE r = 1")
def dedup_first(spark, d):
    return first_by(table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"]).drop("h")


@query("SELECT source, count(*) AS n_rows, count(CASE WHEN lang <> 'en' THEN lang END) AS n_other, count(doc_id) AS n_doc_id, round(100.0 * count(CASE WHEN lang <> 'en' THEN lang END) / count(*), 4) AS pct_other, round(100.0 * count(doc_id) / count(*), 4) AS pct_doc_id FROM documents GROUP BY 1")
def coverage_by_provider(spark, d):
    docs = table(spark, d, "documents").withColumn("other", F.when(F.col("lang") != "en", F.col("lang")))
    return coverage(docs, "source", ["other", "doc_id"])


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '[Nn]\s*=\s*([0-9]{1,9})', 1), '') AS INTEGER) AS n FROM documents")
def extract_sample_size(spark, d):
    return table(spark, d, "documents").select("doc_id", F.nullif(F.regexp_extract("text", r"[Nn]\s*=\s*([0-9]{1,9})", 1), F.lit("")).try_cast("int").alias("n"))


# --- scans, providers and workflows ---

_VALUES = ", ".join(f"('{p.name}', '{p.base_url}')" for p in PROVIDERS)


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN u.name ELSE v.name END AS provider FROM customer JOIN (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {_VALUES}) t(name, url)) u ON u.i = c_custkey % 8 JOIN (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {_VALUES}) t(name, url)) v ON v.i = (c_custkey + 1) % 8")
def provider_resolve(spark, d):
    names, urls = F.array(*(F.lit(p.name.upper()) for p in PROVIDERS)), F.array(*(F.lit(p.base_url.replace("https://", "http://www.") + "?a=1") for p in PROVIDERS))
    at = F.col("c_custkey").cast("int")
    rows = table(spark, d, "customer").select("c_custkey", F.when(at % 2 == 0, F.get(urls, at % 8)).otherwise("https://elsewhere.example").alias("url"), F.get(names, (at + 1) % 8).alias("name"))
    return Registry().resolve(rows, F.col("url"), F.col("name")).select("c_custkey", "provider")


@query("SELECT item_id, 'https://api.crossref.org/works?offset=' || CAST(1 + (item_id % 5) * 25 AS VARCHAR) || '&query=item' || CAST(item_id AS VARCHAR) || '&rows=25' AS url FROM benchmark")
def request_plan(spark, d):
    crossref = Registry().get("Cross_Ref")
    params = request_parameters(crossref, F.concat(F.lit("item"), F.col("item_id").cast("string")), F.col("item_id") % 5 + 1, mailto=F.lit(None))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return table(spark, d, "benchmark").select("item_id", request_url(crossref, ordered).alias("url"))


# --- requests of a table, answered from an archive of pages ---

_PAGED = """WITH n AS (SELECT c_custkey AS k, count(o_orderkey) AS n, 3 + c_custkey % 3 AS size, CASE c_custkey % 2 WHEN 0 THEN 'crossref' ELSE 'springernature' END AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
asked AS (SELECT *, unnest([1, 2, 3, 4]) AS page FROM n)"""


def customer_requests(spark, d):
    """Each customer is a query with a page size of its own, of which the first four pages are asked for."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey",
        F.when(key % 2 == 0, "crossref").otherwise("springernature").alias("provider_name"),
        F.concat(F.lit("c"), key.cast("string")).alias("query"),
        (3 + key % 3).cast("int").alias("records_per_page"),
        F.explode(F.expr("array(1, 2, 3, 4)")).alias("page"),
    )


def order_archive(spark, d):
    """The answers of an API whose hits are a customer's orders; those of every tenth customer are missing and of every next one expired."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    own = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))  # the orders of one customer
    asked = customer_requests(spark, d).join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    keys, size = F.coalesce("keys", F.expr("cast(array() as array<bigint>)")), F.col("records_per_page")
    name = lambda letter, k, n: F.concat(F.lit(letter), (k % n).cast("string"))
    item = lambda k: F.struct(
        F.concat(F.lit("order "), k.cast("string")).alias("title"),
        F.array(F.struct(name("A", k, 7).alias("name")), F.struct(name("B", k, 5).alias("name"))).alias("author"),
        F.array(F.struct(name("A", k, 7).alias("creator")), F.struct(name("B", k, 5).alias("creator"))).alias("creators"),
    )
    found = F.to_json(F.struct(F.size(keys).alias("total"), F.transform(F.slice(keys, (F.col("page") - 1) * size + 1, size), item).alias("items")))
    expires = F.when(F.col("c_custkey") % 10 == 1, F.lit("2020-01-01")).otherwise(F.lit("2999-01-01")).cast("timestamp")
    return asked.where(F.col("c_custkey") % 10 != 0).select("provider_name", "query", "page", "records_per_page", F.lit(200).alias("status_code"), F.lit("application/json").alias("content_type"), found.alias("content"), expires.alias("expire_at"))


def _archived_pages(spark, d):
    endpoints = [endpoint(Registry().get(p), "total", "items", 0.0) for p in ("crossref", "springernature")]
    return fetch_pages(customer_requests(spark, d).withColumn("search", F.col("query")), endpoints, cache=order_archive(spark, d))


@query(
    f"""{_PAGED} SELECT 'c' || k AS query, p AS provider_name, CAST(page AS INTEGER) AS page, CASE WHEN k % 10 < 2 THEN 'nonresponse' ELSE 'processed' END AS status, CASE WHEN k % 10 >= 2 THEN CAST(200 AS INTEGER) END AS status_code, k % 10 >= 2 AS from_cache
    FROM asked WHERE page <= CASE WHEN k % 10 < 2 THEN 1 ELSE greatest(1, (n + size - 1) // size) END"""
)
def datasource_scan(spark, d):
    return _archived_pages(spark, d).select("query", "provider_name", "page", "status", "status_code", "from_cache")


@query(
    f"""{_PAGED}, hits AS (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
    SELECT CAST(page AS INTEGER) AS page, p AS provider_name, 'order ' || o AS title, 'A' || o % 7 || '; B' || o % 5 AS authors FROM asked JOIN hits USING (k) WHERE k % 10 >= 2 AND (i - 1) // size + 1 = page"""
)
def search_to_table(spark, d):
    return search_plan(_archived_pages(spark, d), Registry().maps, {"crossref": "items", "springernature": "items"}).select("page", "provider_name", "title", "authors")


@query("SELECT o_orderkey, l_linenumber, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def workflow_search_fetch(spark, d):
    found = table(spark, d, "orders").select("o_orderkey", F.array("o_orderkey").alias("ids"))
    fetched = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_partkey").alias("part"))
    return hand_off(found, fetched).select("o_orderkey", "l_linenumber", "part")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, c_mktsegment) AS meta FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def workflow_carry_metadata(spark, d):
    pages = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("meta"))
    earlier = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("meta"))
    return carry_metadata(pages, earlier, ["k"], ["meta"]).select("o_orderkey", "meta")


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS at, event_type AS provider_name, count(*) AS n_pages FROM events GROUP BY 1, 2")
def window_counts(spark, d):
    from foliospark.streaming.pages import counts_by_window

    pages = table(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("event_type").alias("provider_name"), F.lit("processed").alias("status"))
    return counts_by_window(pages).select(F.col("window.start").alias("at"), "provider_name", "n_pages")


from foliospark.plans import harvest_queries, more_queries, response_queries  # noqa: E402, F401 - register further queries
