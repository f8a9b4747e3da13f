"""The opN queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import centroids, codes
from foliospark.llm.decontaminate import find_contamination
from foliospark.llm.fingerprints import fingerprint_edits
from foliospark.llm.html import extract_pages
from foliospark.llm.packing import pack_documents
from foliospark.llm.pii import KINDS, configured_key, pseudonymise
from foliospark.llm.secrets import BASE, find_secrets
from foliospark.llm.sharding import shard_documents
from foliospark.llm.simhash import near_duplicates
from foliospark.llm.substrings import drop_repeated_windows
from foliospark.llm.suffixes import drop_repeated_bytes
from foliospark.llm.toxicity import fit, held_out, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark), spans="pii_spans")
    of = lambda kind: F.filter("pii_spans", lambda s: s["kind"] == kind)
    counts = (F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS)
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_pii"), *counts)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_toxicity(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("span_ends", "span_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.with_digests(*codes.compress_vectors(table(spark, sf_dir, "embeddings")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_totals(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


_ALL = (
    op1_pii_pseudonyms, op2_suffix_array_dedup, op3_html_extraction, op4_substring_dedup, op5_simhash_near_dedup, op6_best_fit_packing, op7_toxicity, op8_decontamination,
    op9_secret_scan, op10_document_fingerprints, op11_sharding, op12_vector_codes, op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {"op12_vector_codes": codes.oracle_sql(), "op13_centroid_clustering": centroids.oracle_sql()}
