"""Result sinks: tables, CSV exports, JSON verdicts, the run manifest."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_journal(journal: DataFrame, path: str) -> None:
    """Journal as parquet under instrument/session directories.

    Rows are spread by day inside each directory, so one busy pair is many tasks.
    """
    (
        journal.repartition("instrument", "session", F.trunc("date", "MM"))
        .write.mode("overwrite").partitionBy("instrument", "session").parquet(path)
    )


def read_journal(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_verdict(verdict: DataFrame, path: str) -> None:
    """A one-row result as JSON."""
    verdict.coalesce(1).write.mode("overwrite").json(path)


def read_verdict(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def run_manifest(spark: SparkSession, config, master_seed: int, draws: int) -> DataFrame:
    """One row naming the configuration (SHA-256 of its sorted JSON), seed and draw count."""
    text = json.dumps(dataclasses.asdict(config), sort_keys=True, default=str)
    return spark.range(1).select(
        F.sha2(F.lit(text), 256).alias("config_hash"),
        F.lit(master_seed).cast("bigint").alias("master_seed"),
        F.lit(draws).cast("bigint").alias("completed_draws"),
        F.lit("cap-at-available-without-replacement").alias("null_days_policy"),
    )


def write_control_artifacts(root: str, *, null_t: DataFrame, variants: DataFrame,
                            pvalues: DataFrame, provenance: DataFrame, manifest: DataFrame) -> None:
    """The long draw table, its eligibility, the variant index, p-values and provenance."""
    write_table(null_t.withColumn("eligible", F.col("t").isNotNull()), f"{root}/null_t")
    write_table(variants, f"{root}/variant_index")
    write_table(pvalues, f"{root}/null_pvalues")
    write_table(provenance, f"{root}/null_provenance")
    write_verdict(manifest, f"{root}/manifest")
