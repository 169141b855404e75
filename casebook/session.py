"""SparkSession construction and cluster-shared scratch locations."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every query in the library is written against.  They are only
# defaults: a cluster launcher that already set a key keeps its value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Parquet files are written with typed dates, so ISO dates compare as dates.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "casebook", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library's defaults applied.

    ``master`` / ``shuffle_partitions`` are for local runs and tests; on a
    cluster pass neither and let the launcher decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    sc = spark.sparkContext
    if is_local(sc.master) or sc.getConf().get("spark.checkpoint.dir", None):
        checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """``local`` and ``local[...]``: driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder used to cut lineage (``DataFrame.checkpoint``).

    The cluster names it in ``spark.checkpoint.dir``; that value always wins.  Only when it
    is unset and the master is local (tests, a laptop) is a local fallback registered; on a
    cluster an unset value is an error, because a machine-local folder is not shared.
    """
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if fallback is None and not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = fallback or os.path.join(os.environ.get("TMPDIR", "/tmp"), "casebook-checkpoints")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, also when the
    session was started without it on its path (``--py-files`` does the same on a cluster)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])
