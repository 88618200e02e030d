"""The registered queries of the subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.cluster import cut
from barloom.llm.conversation_repair import damage, repair, repaired_digests
from barloom.llm.decontaminate import contamination
from barloom.llm.language_id import fit, identify
from barloom.llm.license_scan import license_scan
from barloom.llm.minhash_dedup import near_duplicates
from barloom.llm.quality import fit as fit_quality
from barloom.llm.quality import score
from barloom.llm.sentencepiece import Vocabulary, decode, encode
from barloom.llm.simhash import fingerprint_edits, likeness, near_pairs
from barloom.llm.substring_dedup import substring_dedup
from barloom.llm.suffix_dedup import suffix_dedup
from barloom.llm.token_shards import in_training_order
from barloom.llm.warc import archive_round_trip
from barloom.llm.whitening import fit as fit_whitening
from barloom.llm.whitening import whiten


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.load()
    out = decode(encode(_read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary), vocabulary)
    first, last = min(vocabulary.byte_ids.tolist()), max(vocabulary.byte_ids.tolist())
    return out.select("doc_id", F.coalesce(F.array_size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"),
                      F.coalesce(F.array_size(F.filter("token_ids", lambda x: x.between(first, last))), F.lit(0))
                      .cast("long").alias("n_byte_pieces"),
                      "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                      F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_read(spark, sf_dir, "documents", "doc_id", "text"),
                        _read(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("detections")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also, for the documents whose id is divisible by 50, how many rows the block tables find within the radius."""
    out = fingerprint_edits(_read(spark, sf_dir, "documents", "doc_id", "text"))
    out = cut(out.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited"))
    asks = F.when(F.col("doc_id") % 50 == 0, F.col("fingerprint"))
    near = near_pairs(out.select(asks.alias("asked")), out, asked_column="asked").groupBy("asked").agg(
        F.sum("n_rows").alias("n_near"), F.sum(F.when(F.col("distance") == 0, F.col("n_rows")).otherwise(0)).alias("n_exact"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(c)
    return out.join(near, asks == F.col("asked"), "left").select(
        "doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "n_near", "n_exact")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), fit(docs))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(_read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                          F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to",
                          F.sha2("record", 256).alias("record_sha256"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = in_training_order(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumn("tokens_sha256", F.sha2("tokens", 256)).drop("tokens")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return whiten(vectors, fit_whitening(vectors))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit_quality(docs, _read(spark, sf_dir, "labels", "doc_id", "quality")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    report, repaired = repair(damage(rows))
    out = rows.select("conv_id").distinct()
    for part in (report, repaired_digests(repaired)):
        part = part.withColumnRenamed("conv_id", "_own")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_own")), "left").drop("_own")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.fillna(0, counts).fillna("", ["audit"]).select(
        "conv_id", *counts, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_sentencepiece": op2_sentencepiece, "op3_decontaminate": op3_decontaminate,
           "op4_license_scan": op4_license_scan,
           "op5_simhash": op5_simhash,
           "op6_language_id": op6_language_id,
           "op7_minhash_dedup": op7_minhash_dedup,
           "op8_suffix_dedup": op8_suffix_dedup, "op9_warc": op9_warc, "op10_token_shards": op10_token_shards,
           "op11_embedding_whitening": op11_embedding_whitening,
           "op12_quality_classifier": op12_quality_classifier, "op13_conversation_repair": op13_conversation_repair}
