"""Queries over attempts, page metadata, response accessors, formats, stores and the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import paths as P
from foliospark.functions import scalars as S
from foliospark.functions.jsonpath import split_key, values_at
from foliospark.functions.security import KeyMask, StringMask, mask_text
from foliospark.operators import cache as C
from foliospark.operators import records as R
from foliospark.operators import responses
from foliospark.operators.attempts import due, settled
from foliospark.operators.extract import process
from foliospark.operators.fieldmap import AcademicMap, normalise_by
from foliospark.operators.metadata import MetadataMap, by_provider
from foliospark.plans.more_queries import _provided, _PROVIDED, _provider_records
from foliospark.plans.queries import ORDERS_SQL, _customer_pages, event_pages, orders_json, query, table
from foliospark.plans.workflow import Step, Workflow
from foliospark.sources.parse import parse_pages
from foliospark.sources.providers import Provider, Registry, request_parameters, request_url
from foliospark.sources.retries import RetryPolicy

# --- attempts ---

_POLICY = RetryPolicy(retries=3, factor=0.5, longest=3.0)
# Six attempts a request; an eighth of them isn't logged; some answers ask for a wait, in either header.
_ATTEMPTS = """logged AS (SELECT event_id // 6 AS request, event_id % 6 + 1 AS attempt, [200, 503, 429, 503, 404, 500, 503][user_id * 31 % 7 + 1] AS code,
    CASE WHEN user_id % 3 = 0 THEN CAST(user_id % 10 AS DOUBLE) ELSE least(0.5 * 2 ** (event_id % 6 + 1), 3.0) END AS wait FROM events WHERE (event_id + user_id) % 8 <> 0),
    slots AS (SELECT request, k, code, wait, code IS NULL OR code NOT IN (429, 500, 503, 504) AS ends FROM (SELECT DISTINCT request FROM logged) r CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) n LEFT JOIN logged USING (request) WHERE attempt = k OR attempt IS NULL
      UNION ALL SELECT request, k, NULL, NULL, true FROM (SELECT DISTINCT request FROM logged) r CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) n WHERE NOT EXISTS (SELECT 1 FROM logged l WHERE l.request = r.request AND l.attempt = k)),
    stops AS (SELECT request, min(k) FILTER (ends) AS stop FROM slots GROUP BY request),
    closed AS (SELECT t.request, CASE WHEN stop IS NULL THEN 4 WHEN s.code IS NULL THEN stop - 1 ELSE stop END AS n, CASE WHEN stop IS NULL THEN 'exhausted' WHEN s.code IS NULL THEN 'open' WHEN s.code = 200 THEN 'valid' ELSE 'refused' END AS outcome FROM stops t LEFT JOIN slots s ON s.request = t.request AND s.k = stop)"""


def _attempts(spark, d):
    wait = F.when(F.col("user_id") % 3 == 0, F.create_map(F.when(F.col("user_id") % 2 == 0, "Retry-After").otherwise("X-RateLimit-Retry-After"), (F.col("user_id") % 10).cast("string")))
    code = F.get(F.array(*map(F.lit, (200, 503, 429, 503, 404, 500, 503))), (F.col("user_id") * 31 % 7).cast("int"))
    logged = table(spark, d, "events").where((F.col("event_id") + F.col("user_id")) % 8 != 0)
    return logged.select(F.floor(F.col("event_id") / 6).alias("request"), (F.col("event_id") % 6 + 1).alias("attempt"), code.alias("status_code"), wait.alias("headers"), F.col("ts").cast("timestamp").alias("at"))


@query(
    f"""WITH {_ATTEMPTS} SELECT c.request, CAST(n AS INTEGER) AS attempts, outcome, CAST(max(code) FILTER (k = n) AS INTEGER) AS status_code, coalesce(sum(wait) FILTER (k < n), 0.0) AS waited, CASE WHEN outcome = 'open' THEN coalesce(max(wait) FILTER (k = n), 0.0) END AS next_wait
    FROM closed c JOIN slots s ON s.request = c.request GROUP BY c.request, n, outcome"""
)
def retry_outcomes(spark, d):
    return settled(_attempts(spark, d), ["request"], _POLICY)


@query(f"WITH {_ATTEMPTS} SELECT c.request, CAST(n + 1 AS INTEGER) AS attempt, coalesce(max(wait) FILTER (k = n), 0.0) AS wait FROM closed c JOIN slots s ON s.request = c.request WHERE outcome = 'open' GROUP BY c.request, n")
def retries_due(spark, d):
    return due(_attempts(spark, d), ["request"], _POLICY)


# --- metadata ---


@query(
    """SELECT o_custkey, CASE WHEN o_custkey % 5 <> 4 THEN n END AS total_query_hits, CASE WHEN o_custkey % 5 NOT IN (2, 3) THEN CAST(5 AS BIGINT) END AS records_per_page, CASE WHEN o_custkey % 5 IN (0, 1) THEN CAST(greatest(0, ceil(n / 5.0) - 2) AS BIGINT) END AS pages_left,
    CASE WHEN o_custkey % 5 <> 4 THEN CAST(greatest(0, ceil(n / 4.0) - 2) AS BIGINT) END AS left_by_4 FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) t"""
)
def metadata_map(spark, d):
    counted = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    nested = lambda total, size: F.to_json(F.struct(F.struct(total.alias("total")).alias("stats"), F.struct(size.alias("size")).alias("page")))
    flat = F.to_json(F.struct(F.col("n").alias("stats.total"), F.lit("5").alias("page.size"), F.struct(F.lit(-1).alias("total")).alias("stats")))
    shapes = (flat, nested(F.col("n"), F.lit("5")), nested(F.col("n").cast("string"), F.lit(5.5)), nested(F.col("n"), F.lit("five")), nested(F.lit("many"), F.lit(5)))
    at = F.col("o_custkey") % 5
    text = F.coalesce(*(F.when(at == i, s) for i, s in enumerate(shapes)))
    keys = MetadataMap("stats.total", "page.size")
    pages = counted.select("o_custkey", text.alias("m"))
    left = keys.pages_left(F.lit(2), F.col("m")).cast("long"), keys.pages_left(F.lit(2), F.col("m"), size=F.lit(4)).cast("long")
    return pages.select("o_custkey", keys.processed(F.col("m")).alias("p"), left[0].alias("pages_left"), left[1].alias("left_by_4")).select("o_custkey", "p.*", "pages_left", "left_by_4")


@query(
    """SELECT o_custkey, CASE o_custkey % 4 WHEN 0 THEN 'plos' WHEN 1 THEN 'crossref' WHEN 2 THEN 'springernature' ELSE 'unheard of' END AS provider_name, CASE WHEN o_custkey % 4 < 3 THEN n END AS total_query_hits, CASE WHEN o_custkey % 4 IN (1, 2) THEN CAST(20 AS BIGINT) END AS records_per_page
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) t"""
)
def metadata_by_provider(spark, d):
    counted = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("string").alias("n"))
    name = F.get(F.array(*map(F.lit, ("plos", "crossref", "springernature", "unheard of"))), (F.col("o_custkey") % 4).cast("int"))
    found = F.create_map(*(x for k in ("numFound", "total-results", "total") for x in (F.lit(k), F.col("n"))), F.lit("items-per-page"), F.lit("20"), F.lit("pageLength"), F.lit("20"))
    pages = counted.select("o_custkey", name.alias("provider_name"), found.alias("metadata"))
    return by_provider(pages, list(Registry().providers.values()), keyed=True).select("o_custkey", "provider_name", "processed.*")


# --- accessors ---


@query(
    """SELECT page_id, CAST([200, 404, 429, 299, NULL][page_id % 5 + 1] AS INTEGER) AS status_code, ['OK', 'Not Found', 'Slow down', NULL, NULL][page_id % 5 + 1] AS reason, ['OK', 'Not Found', 'Slow down', 'custom', 'custom'][page_id % 5 + 1] AS status_text,
    CASE WHEN page_id % 2 = 0 THEN html END AS text, CASE WHEN page_id % 3 <> 0 THEN url END AS url FROM pages"""
)
def response_accessors(spark, d):
    at = (F.col("page_id") % 5).cast("int")
    broken = F.concat(F.unhex(F.lit("FFFE")), F.col("html").cast("binary"))
    made = table(spark, d, "pages").select(
        "page_id", F.get(F.array(*map(F.lit, ("200", "404", "429", "299", "none"))), at).alias("status_code"), F.get(F.array(F.lit(""), F.lit(None), F.lit("Slow down"), F.lit(""), F.lit(None)), at).alias("reason"),
        F.create_map(F.lit("etag"), F.lit("e")).alias("headers"), F.when(F.col("page_id") % 2 == 0, F.col("html").cast("binary")).otherwise(broken).alias("content"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url")).alias("url"), F.lit("custom").alias("own"),
    )
    return responses.accessors(made, status="own").select("page_id", "status_code", "reason", F.col("status").alias("status_text"), "text", "url")


@query("SELECT event_id, event_type <> 'error' AS truth, CASE WHEN event_type = 'error' OR event_id % 4 = 3 THEN 0 ELSE CAST(event_id % 4 AS INTEGER) END AS length FROM events")
def response_truth(spark, d):
    n = (F.col("page") % 4).cast("int")
    records = F.when(n < 3, F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), n))
    return event_pages(spark, d).select(F.col("page").cast("long").alias("event_id"), responses.is_success(F.col("status")).alias("truth"), responses.length_of(F.col("status"), records).alias("length"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0")
def search_records(spark, d):
    pages = R.extract_dynamic(_customer_pages(spark, d), keep=["o_custkey"]).withColumn("status", F.when(F.col("o_custkey") % 3 == 0, "error").otherwise("processed"))
    return responses.search_data(pages).select(F.get_json_object("record", "$.order").cast("long").alias("o_orderkey"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'plos' WHEN 1 THEN 'crossref' ELSE 'a plan' END AS provider_name FROM customer")
def relabelled_pages(spark, d):
    at = F.col("c_custkey") % 3
    url = F.when(at == 0, "http://www.api.plos.org/search?q=a").when(at == 1, "https://api.crossref.org/works/").otherwise("https://nowhere.org")
    pages = table(spark, d, "customer").select("c_custkey", url.alias("url"), F.lit("a plan").alias("provider_name"))
    return Registry().relabelled(pages).select("c_custkey", "provider_name")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{"key":' || c_custkey || '}' WHEN 1 THEN '[{"key":' || c_custkey || '},{}]' WHEN 2 THEN '["{' || c_custkey || '}"]' ELSE '{"key":[' || c_custkey || ']}' END AS text FROM customer""")
def lone_records(spark, d):
    key, at = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    text = F.when(at == 0, F.concat(F.lit('[{"key":'), key, F.lit("}]"))).when(at == 1, F.concat(F.lit('[{"key":'), key, F.lit("},{}]"))).when(at == 2, F.concat(F.lit('["{'), key, F.lit('}"]'))).otherwise(F.concat(F.lit('{"key":['), key, F.lit("]}")))
    return table(spark, d, "customer").select("c_custkey", responses.lone_record(text).alias("text"))


# --- formats ---


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS id FROM (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) t")
def parse_json_records(spark, d):
    record = F.when(F.col("o_orderkey") % 3 == 0, F.expr("substr(record, 2)")).otherwise(F.col("record"))
    pages = orders_json(spark, d).select("o_orderkey", record.alias("content"), F.lit("application/json; charset=utf-8").alias("content_type"))
    return parse_pages(pages).select("o_orderkey", F.get_json_object("content", "$.id").cast("long").alias("id"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def custom_parser(spark, d):
    def parse_pairs(content):
        return dict(line.split("=", 1) for line in content.splitlines())

    text = F.concat(F.lit("name="), "c_name", F.lit("\nsegment="), "c_mktsegment")
    parsed = parse_pages(table(spark, d, "customer").select("c_custkey", text.alias("content")), fmt="pairs", additional={"pairs": parse_pairs})
    return parsed.select("c_custkey", F.get_json_object("content", "$.name").alias("name"), F.get_json_object("content", "$.segment").alias("segment"))


@query("SELECT event_id, sha256('u' || user_id || CASE WHEN event_id % 2 = 0 THEN 'etag=e' || event_id || 'last-modified=m' ELSE '' END || sha256(event_type)) AS hash FROM events")
def response_hashes(spark, d):
    marks = F.create_map(F.lit("Last-Modified"), F.lit("m"), F.lit("ETag"), F.concat(F.lit("e"), F.col("event_id").cast("string")), F.lit("Date"), F.col("ts").cast("string"))
    headers = F.when(F.col("event_id") % 2 == 0, marks).otherwise(F.create_map(F.lit("Date"), F.lit("d")))
    return table(spark, d, "events").select("event_id", S.response_hash(F.concat(F.lit("u"), F.col("user_id").cast("string")), headers, F.col("event_type")).alias("hash"))


# --- records and paths ---


@query(f"SELECT o_orderkey FROM ({ORDERS_SQL}) t WHERE n BETWEEN 4 AND 5")
def path_rows_filtered(spark, d):
    found = R.path_rows(orders_json(spark, d), keep=["o_orderkey"], keep_pattern=r"^lines\.3\.", ignore_pattern="lines.5.part")
    return found.select("o_orderkey")


@query("SELECT o_orderkey, c_name AS by_text, c_mktsegment AS by_list, CAST(o_orderkey AS VARCHAR) AS plain FROM orders JOIN customer ON o_custkey = c_custkey")
def prepared_keys(spark, d):
    paths = ["customer.name", ["customer", "segment"], "id"]
    assert [split_key(p) for p in paths] == [["customer", "name"], ["customer", "segment"], ["id"]]
    read = values_at(F.col("record"), paths)
    return orders_json(spark, d).select("o_orderkey", *(F.get(F.get(read, F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(("by_text", "by_list", "plain"))))


@query("SELECT event_id, props AS record FROM events")
def identity_processor(spark, d):
    return process(table(spark, d, "events").select("event_id", F.col("props").alias("record")), lambda records: records, ["event_id", "record"])


@query("""SELECT event_id, 'lines.' || user_id AS removed, 'lines.part' AS by_type, CAST(2 AS INTEGER) AS info, 'lines.' || user_id || '.part.' || event_id AS appended, event_type || '.lines' AS joined, CAST(event_id AS INTEGER) AS record FROM events""")
def path_removals(spark, d):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    path, types = F.array(F.lit("lines"), user, F.lit("part")), F.array(F.lit("dict"), F.lit("list"), F.lit("str"))
    return table(spark, d, "events").select(
        "event_id",
        P.join_path(P.remove(path, "part")).alias("removed"),
        P.join_path(P.remove_by_type(path, types, "list")).alias("by_type"),
        P.info_content(path).cast("int").alias("info"),
        P.join_path(P.append(path, event)).alias("appended"),
        P.join_path(P.concat(P.concat(F.array(F.lit("")), F.array("event_type")), F.array(F.lit("lines")))).alias("joined"),
        P.record_index(F.array(event, user)).alias("record"),
    )


# --- caches ---


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(0 AS BIGINT) AS held FROM customer")
def null_store(spark, d):
    store = C.open_store("null", spark)
    wanted = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("cache"))
    store.update(wanted)
    held = store.retrieve_all().groupBy("key").count()
    return C.misses(wanted, store.entries()).join(held, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("held"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(event_type) AS cache FROM events WHERE user_id NOT IN (1, 2, 3) GROUP BY 1")
def cache_delete(spark, d):
    store = C.open_store("memory", spark)
    store.update(table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("cache")))
    store.delete("1", "2", "3", "no such key")
    return store.retrieve_all().select("key", "cache")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'fresh' END AS by_need, 'fresh' AS always, CASE WHEN event_id % 2 = 0 THEN event_type END AS never FROM events")
def metadata_states(spark, d):
    stored, fresh = F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.lit("fresh")
    states = {"by_need": None, "always": True, "never": False}
    return table(spark, d, "events").select("event_id", *(responses.metadata_state(stored, fresh, how).alias(n) for n, how in states.items()))


# --- extension points ---


@query(_PROVIDED)
def normalise_by_name(spark, d):
    records = _provider_records(spark, d).withColumn("url", F.lit("https://nowhere.org/x"))
    return _provided(normalise_by(records.withColumnRenamed("provider", "name"), Registry(), name="name", keep=["c_custkey"]))


@query("SELECT c_custkey, 'https://own.example.org/find?q=' || c_custkey || '&from=' || 10 * (c_custkey % 5) || '&n=10&sort=new' AS url FROM customer")
def custom_provider(spark, d):
    registry = Registry()
    registry.add(Provider("own_source", "https://own.example.org/find", "q", "from", "n", True, True, 10), AcademicMap("own_source", {"title": "name"}))
    own = registry.get("Own Source".replace(" ", "_"))
    asked = request_parameters(own, F.col("c_custkey").cast("string"), (F.col("c_custkey") % 5 + 1).cast("int"), sort=F.lit("new"))
    ordered = F.map_from_arrays(F.array(*map(F.lit, ("q", "from", "n", "sort"))), F.transform(F.array(*map(F.lit, ("q", "from", "n", "sort"))), lambda k: F.try_element_at(asked, k)))
    return table(spark, d, "customer").select("c_custkey", request_url(own, ordered).alias("url"))


@query("SELECT c_custkey, 'seg <hidden> id=#' AS text FROM customer")
def custom_mask(spark, d):
    text = F.concat(F.lit("seg "), "c_mktsegment", F.lit(" id=i"), F.col("c_custkey").cast("string"))
    masks = (StringMask("AUTOMOBILE", replacement="<hidden>"), StringMask("BUILDING|FURNITURE|HOUSEHOLD|MACHINERY", regex=True, replacement="<hidden>"), KeyMask("id", r"i\d+", "#"))
    return table(spark, d, "customer").select("c_custkey", mask_text(text, masks).alias("text"))


@query("SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS n, 'b' AS label, 'first,second' AS steps FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def custom_workflow(spark, d):
    """Two steps of one provider: the second keeps the first's parameters but for its own, and counts lines of the ids found."""
    find = Step("first", lambda c: table(c["spark"], d, "orders").where(F.col("o_orderstatus") == c["parameters"]["status"]).select(F.col("o_orderkey").alias("id")), parameters={"status": "F", "label": "a"}, provider="p")
    count = Step("second", lambda c: c["previous"].join(table(c["spark"], d, "lineitem"), F.col("id") == F.col("l_orderkey")).groupBy("id").agg(F.count("*").alias("n")).withColumn("label", F.lit(c["parameters"]["label"] if c["parameters"]["status"] == "F" else "lost")), parameters={"label": "b"}, provider="p")
    plan = Workflow(find, count)
    result = plan.run(spark)
    return result.withColumn("steps", F.lit(",".join(name for name, _ in plan.history)))
