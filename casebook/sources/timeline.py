"""Patient timelines, laid out once (W1, A8): bucketed by patient, sorted by start inside a bucket.

Histories, first future events and novelty all group by patient.  On a table whose files are
already dealt by patient, Spark plans these groupings and their joins without an exchange:
each bucket is one task's input, whatever number of queries runs over it.  The layout costs
one shuffle, at ingest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casebook.sources.ingest import scratch_dir

BUCKETS = 64
#: Rows of a bucket, about: a query over the layout groups a whole bucket in one task.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int, least: int = BUCKETS) -> int:
    """Number of buckets for a table of so many rows: it grows with the table, a bucket does not."""
    return max(least, -(-rows // BUCKET_ROWS))


def lay_out(conditions: DataFrame, buckets: int = BUCKETS, path: str | None = None,
            name: str | None = None) -> DataFrame:
    """PATIENT, START (DATE), CODE, DESCRIPTION as a bucketed table, one file per bucket, and read back.

    ``path`` says where it is kept (default: scratch, until the application ends) and ``name``
    is the table's name in the session's catalog (default: a fresh one).  Rows whose START is
    no date are left out."""
    from casebook.operators.corpus import typed_conditions
    spark = conditions.sparkSession
    name = name or f"timeline_{uuid.uuid4().hex}"
    (typed_conditions(conditions).repartition(buckets, "PATIENT")
     .write.mode("overwrite").bucketBy(buckets, "PATIENT").sortBy("PATIENT", "START", "CODE", "DESCRIPTION")
     .option("path", path or scratch_dir(spark, "timeline")).saveAsTable(name))
    return spark.table(name)


def find(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
