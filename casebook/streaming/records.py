"""Append-only record log (S19) as an exactly-once Structured Streaming file stream.

Record files (JSON lines) dropped into a landing folder are appended to a Parquet log.  The
file sink and its checkpoint (under the cluster's shared ``spark.checkpoint.dir``) make the
append exactly-once across restarts and lost executors; ``availableNow`` processes what has
landed and stops, so the same job serves scheduled batch runs.  Open extra fields travel in
a MAP<STRING,STRING>, like the batch sink ``sources.ingest.append_records``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.sources.ingest import scratch_dir

DIAGNOSIS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("patient_id", T.StringType()),
    T.StructField("model_name", T.StringType()), T.StructField("predicted_diagnosis", T.StringType()),
    T.StructField("ground_truth", T.StringType()), T.StructField("confidence", T.DoubleType()),
])
LATENCY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("operation", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()), T.StructField("success", T.BooleanType()),
])


def start_record_log(spark: SparkSession, landing: str, log_path: str, schema: T.StructType,
                     extras: list[str] | None = None, checkpoint: str | None = None,
                     kind: str = "diagnosis"):
    """Start (and return) the streaming query landing -> Parquet log.

    Diagnosis records get ``correct`` (null when the truth is missing or empty).  Fields
    listed in ``extras`` are read as strings and folded into the ``extra`` map.
    """
    extras = extras or []
    full = T.StructType(list(schema.fields) + [T.StructField(e, T.StringType()) for e in extras])
    s = spark.readStream.schema(full).option("mode", "DROPMALFORMED").json(landing)
    if kind == "diagnosis":
        t = F.col("ground_truth")
        s = s.withColumn("correct", F.when(t.isNull() | (t == ""), F.lit(None).cast("boolean"))
                         .otherwise(t == F.col("predicted_diagnosis")))
    extra = (F.map_from_arrays(F.array(*[F.lit(e) for e in extras]),
                               F.array(*[F.col(e) for e in extras]))
             if extras else F.create_map().cast("map<string,string>"))
    s = s.select(*[c for c in s.columns if c not in extras], extra.alias("extra"))
    cp = checkpoint or scratch_dir(spark, f"{kind}-log-checkpoint")
    return (s.writeStream.format("parquet").option("path", log_path)
             .option("checkpointLocation", cp).trigger(availableNow=True).start())
