"""Materialising an intermediate that several branches of one plan read.

``materialise`` writes a Parquet table under the cluster's shared ``spark.checkpoint.dir`` and
reads it back: computed once, lineage cut, nothing lost with an executor.  ``stage`` keeps
the rows in executor memory and disk instead (lost blocks are recomputed from lineage); the
caller releases it with ``unpersist``.  Which of the two, or neither, is the caller's explicit
choice; nothing here looks at sizes.  Never ``localCheckpoint``: its blocks die with the
executor.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from casebook.sources.ingest import scratch_dir


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to a fresh folder of the shared checkpoint dir (removed when the
    application ends) and read back."""
    spark = df.sparkSession
    path = scratch_dir(spark, "stage")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame) -> DataFrame:
    """``df`` persisted in memory and on disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
