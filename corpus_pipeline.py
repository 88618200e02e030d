"""The corpus pipeline: language ID, near-dedup, suffix dedup, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.cluster import stored
from barloom.llm.decontaminate import contamination
from barloom.llm.language_id import fit, keep_identified
from barloom.llm.minhash_dedup import drop_near_duplicates
from barloom.llm.sentencepiece import Vocabulary, decode, encode
from barloom.llm.suffix_dedup import suffix_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go. The model learns from the labelled rows given; any score will do (MIN_SCORE is 0), and
    without a labelled row to learn from no language is told apart."""
    return keep_identified(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays."""
    return drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that also starts earlier in the corpus, 100 bytes or more, is cut out (whole characters only);
    n_chars counts the text that is left."""
    out = suffix_dedup(docs, keep_columns=True)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    if "n_chars" in kinds:
        out = out.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"]))
    return out.withColumn("doc_id", F.col("doc_id").cast(kinds["doc_id"])).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows on 5 % of their words or more go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, items, keep_columns=True)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    vocabulary = Vocabulary.load()
    out = decode(encode(docs.select("doc_id", "lang", "source", "text"), vocabulary), vocabulary)
    return out.select("doc_id", "lang", "source", F.coalesce(F.array_size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"),
                      "token_ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup),
          ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]

#: No stage but suffix dedup and decontamination can be said in SQL; the tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's table written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
