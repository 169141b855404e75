"""Readers for the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> list[str]:
    """Expose each table as a temp view (S9). A missing table is skipped, not fatal."""
    done = []
    for name in names:
        try:
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
            done.append(name)
        except Exception:  # noqa: BLE001 - one bad dir must not stop the rest
            continue
    return done
