"""File ingest and sinks.

CSV exports from many archives are found at any depth, merged per table name, de-duplicated,
typed, pruned to an allow-list of columns and written as Snappy Parquet.  All row work is
Spark's; the driver lists files (as ``spark.read`` does) and receives each file's header line
from one job over all files.

CSV is read losslessly: quoted fields with commas, doubled quotes and line breaks, and one
large file by many tasks (``csv_splits``).

Scratch locations are always under the cluster's shared ``spark.checkpoint.dir``
(see ``scratch_dir``), never a machine-local temporary folder, and go when the application
ends.
"""

from __future__ import annotations

import csv
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.session import checkpoint_dir

EXTRA_COL = "_extra"          # overflow column: a line with more fields than the header
ROWS_PER_FILE = 250_000       # Parquet part-file size of the converter

# The column allow-list per table ("*" keeps every column); names compare without case.
KEEP_COLUMNS = {
    "patients": ["ID", "BIRTHDATE", "DEATHDATE", "MARITAL", "RACE", "ETHNICITY", "GENDER"],
    "conditions": ["START", "STOP", "PATIENT", "CODE", "DESCRIPTION"],
    "observations": ["DATE", "PATIENT", "ENCOUNTER", "CODE", "DESCRIPTION", "VALUE", "UNITS"],
    "encounters": ["ID", "DATE", "PATIENT", "CODE", "DESCRIPTION", "REASONCODE", "REASONDESCRIPTION"],
    "medications": ["START", "STOP", "PATIENT", "CODE", "DESCRIPTION", "ENCOUNTER", "REASONCODE", "REASONDESCRIPTION"],
    "procedures": ["DATE", "PATIENT", "CODE", "DESCRIPTION", "ENCOUNTER", "REASONCODE", "REASONDESCRIPTION"],
    "allergies": ["PATIENT", "CODE", "DESCRIPTION", "START", "STOP"],
    "immunizations": ["PATIENT", "DATE", "CODE"],
}


#: Columns read as dates wherever they occur; what is no date becomes null and is counted.
DATE_COLUMNS = ("DATE", "START", "STOP", "BIRTHDATE", "DEATHDATE")


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A path not yet there under the shared checkpoint dir, removed when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-{name}-{uuid.uuid4().hex}"
    fs, p = _hadoop_fs(spark, path)
    fs.mkdirs(p)                       # only an existing path can be marked
    fs.deleteOnExit(p)
    return f"{path}/data"


# ---------------------------------------------------------------- file system (classic API)

def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualify(spark: SparkSession, path: str) -> str:
    """The fully qualified form Spark reports in ``_metadata.file_path`` (scheme included)."""
    fs, p = _hadoop_fs(spark, path)
    return str(fs.makeQualified(p))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob (driver-side listing, like ``spark.read`` does itself)."""
    fs, p = _hadoop_fs(spark, pattern)
    st = fs.globStatus(p)
    return sorted(str(s.getPath()) for s in (st or []) if s.isFile())


def find_files(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Files at any depth under ``root`` whose name ends in ``suffix`` (one recursive listing;
    hidden names are left out, as Spark's own readers do)."""
    fs, p = _hadoop_fs(spark, root)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        path = it.next().getPath()
        if path.getName().endswith(suffix) and path.getName()[0] not in "._":
            found.append(str(path))
    return sorted(found)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (0 when absent)."""
    fs, p = _hadoop_fs(spark, path)
    if not fs.exists(p):
        return 0
    return int(fs.getContentSummary(p).getLength())


# ---------------------------------------------------------------- S2 / S3 / S18

def parse_header(line: str | None) -> list[str] | None:
    """Column names of a CSV header line, quotes resolved; None for an empty line."""
    if line is None or not line.strip():
        return None
    return [c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]))]


def header_of(spark: SparkSession, path: str) -> list[str] | None:
    """Column names from the first line of a CSV file; None for an empty file (S3)."""
    first = spark.read.text(escape_glob(path)).limit(1).collect()
    return parse_header(first[0][0]) if first else None


def escape_glob(path: str) -> str:
    """The path with glob characters taken literally."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def file_path() -> F.Column:
    """Path of the row's file as a listing shows it."""
    return decoded(F.col("_metadata.file_path"))


def decoded(path: F.Column) -> F.Column:
    """A path of the metadata column, which is URL-encoded, as a listing shows it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def headers_of(spark: SparkSession, paths: list[str]) -> dict[str, list[str] | None]:
    """First line of every file: path -> column names (None for an empty file), from one job.

    Only the split that starts at offset 0 holds a file's first line; inside a split,
    ``monotonically_increasing_id`` grows with the position, so its minimum marks line 1.
    Paths are compared without their scheme (``file:/x`` and ``file:///x`` are one file).
    """
    lines = (spark.read.text([escape_glob(p) for p in paths])
             .where(F.col("_metadata.file_block_start") == 0)
             .select(F.col("_metadata.file_path").alias("raw"), "value", F.monotonically_increasing_id().alias("pos")))
    # paths are decoded after the grouping: once per file, not per line
    first = (lines.groupBy("raw").agg(F.min_by("value", "pos").alias("line"))
             .select(decoded(F.col("raw")).alias("path"), "line").collect())
    found = {_bare(r.path): r.line for r in first}
    return {p: parse_header(found.get(_bare(p))) for p in paths}


def _bare(path: str) -> str:
    scheme, mark, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if mark and "/" not in scheme else path


def read_csv_tolerant(spark: SparkSession, paths: list[str], columns: list[str],
                      multiline: bool = True, keep_source: bool = False) -> DataFrame:
    """All-string read that drops lines with too many fields and null-fills short ones.

    One overflow column is appended to the schema: lines with more fields than the header
    fill it and are dropped, like pandas ``on_bad_lines='skip'``.  Line breaks inside quoted
    fields are kept and large files are read by many tasks (``csv_splits``);
    ``multiline=False`` takes every line break as a record's end.  ``keep_source`` adds
    ``_src`` (the file's path) and ``_row`` (grows along the file).
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]
                          + [T.StructField(EXTRA_COL, T.StringType())])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    source = ["_src", "_row"] if keep_source else []
    if multiline:
        from casebook.sources.csv_splits import records
        # the header, if longer than a line, is a record too; lines that are empty are none
        text = F.regexp_replace("value", "\r$", "")
        rows = (records(spark, paths).where("row > 0").select("path", "row", text.alias("value"))
                .where("value <> ''"))
        df = rows.select(F.from_csv("value", _ddl(schema), options)
                         .alias("r"), F.col("path").alias("_src"), F.col("row").alias("_row"))
        df = df.select("r.*", *source)
    else:
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).options(**options)
              .csv([escape_glob(p) for p in paths]))
        if keep_source:
            df = df.withColumn("_src", file_path()).withColumn("_row", F.monotonically_increasing_id())
    return df.where(F.col(EXTRA_COL).isNull()).drop(EXTRA_COL)


def _ddl(schema: T.StructType) -> str:
    """The schema as DDL, every name quoted."""
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in schema)


def read_csv_columns(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """CSV scan with a column subset; a missing file or column raises."""
    hdr = header_of(spark, path)
    if hdr is None:
        raise FileNotFoundError(path)
    missing = [c for c in cols if c not in hdr]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return read_csv_tolerant(spark, [path], hdr).select(*cols)


# ---------------------------------------------------------------- S1 / S4 / U1

def merge_exports(spark: SparkSession, paths: list[str], multiline: bool = True) -> DataFrame:
    """Row-wise union of CSV exports of one table; differing headers are unioned by name,
    missing columns become null (S1, U1).  Adds ``_src`` (the file's path: files count in path
    order) and ``_row`` (grows along the file) for keep-first dedup.  Empty and header-only
    files contribute no rows.
    """
    paths = [qualify(spark, p) for p in paths]
    groups: dict[tuple, list[str]] = {}
    headers = headers_of(spark, paths) if paths else {}
    for p in paths:
        if headers[p] is not None:
            groups.setdefault(tuple(headers[p]), []).append(p)
    out = None
    for hdr, members in groups.items():
        df = read_csv_tolerant(spark, members, list(hdr), multiline, keep_source=True)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "_src string, _row long")
    return out


def dedup_keep_first(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """One row per ``key``: the first by ``order_cols`` (S4).  Null keys form one group.

    An aggregation (``min`` over an ordering struct) rather than a window, so a key held by a
    large share of the rows is reduced map-side before the shuffle.
    """
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in order_cols],
                                              *[F.col(c).alias(f"_v_{c}") for c in cols])).alias("_b"))
    return best.select(key, *[F.col(f"_b._v_{c}").alias(c) for c in cols])


def dedup_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_before, rows_after, removed, removed_pct."""
    b = before.agg(F.count(F.lit(1))).scalar()
    a = after.agg(F.count(F.lit(1))).scalar()
    return before.sparkSession.range(1).select(
        b.alias("rows_before"), a.alias("rows_after"), (b - a).alias("removed"),
        F.round(F.coalesce(F.try_divide((b - a) * 100.0, b), F.lit(0.0)), 6).alias("removed_pct"))


# ---------------------------------------------------------------- S5 / S6 / S7 / S8

@dataclass
class TableResult:
    table: str
    status: str                 # ok / empty / skipped / error
    rows: int = 0
    merged_rows: int = 0        # rows after merging the exports, before de-duplication
    parts: int = 0
    input_bytes: int = 0
    output_bytes: int = 0
    files: int = 0              # exports found
    rejected_dates: int = 0     # texts in date columns that are no dates
    message: str = ""


def write_csv(df: DataFrame, path: str) -> None:
    """Merged CSV with a header in every part file (S5); quotes are doubled, blanks kept."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# Texts that stand for "no value" in an export, as pandas reads CSV.
NO_VALUE = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
            "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: What a column's values may be, from the narrowest kind to text; a set of kinds is a bit mask.
KINDS = ("boolean", "long", "double", "text")
BOOLEAN, LONG, DOUBLE, TEXT = (1 << i for i in range(len(KINDS)))
LONG_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
DOUBLE_PATTERN = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def value_of(column: F.Column) -> F.Column:
    """The text, null where it stands for no value."""
    return F.when(~column.isin(*NO_VALUE), column)


def kind_of(column: F.Column) -> F.Column:
    """Bit of the narrowest kind that holds a text (null: no bit).  An integer that does not fit 64
    bits is text, so that nothing is rounded."""
    v = value_of(column)
    whole = v.rlike(LONG_PATTERN)
    return (F.when(v.isNull(), F.lit(0)).when(v.isin("True", "TRUE", "true", "False", "FALSE", "false"), F.lit(BOOLEAN))
            .when(whole & F.trim(v).try_cast("long").isNotNull(), F.lit(LONG)).when(whole, F.lit(TEXT))
            .when(v.rlike(DOUBLE_PATTERN), F.lit(DOUBLE)).otherwise(F.lit(TEXT)))


def kinds_seen(columns: list[str]) -> list[F.Column]:
    """One aggregate per column: the set of kinds among its values.  Sets of parts of a table are
    merged by bitwise or, so files, partitions and later loads add up."""
    return [F.bit_or(kind_of(F.col(f"`{c}`"))).alias(c) for c in columns]


def type_of(kinds: int | None) -> str:
    """SQL type that holds all the kinds: numbers widen to double, booleans with numbers are text;
    a column without values stays text."""
    kinds = kinds or 0
    if kinds == BOOLEAN:
        return "boolean"
    if not kinds or kinds & (TEXT | BOOLEAN):
        return "string"
    return "double" if kinds & DOUBLE else "bigint"


def infer_types(df: DataFrame) -> dict[str, str]:
    """Column -> SQL type of an all-string table, from one aggregation over all its rows."""
    dates = {c for c in df.columns if c.upper() in DATE_COLUMNS}
    others = [c for c in df.columns if c not in dates]
    seen = df.agg(*kinds_seen(others)).first() if others else {}
    return {c: "date" if c in dates else type_of(seen[c]) for c in df.columns}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """An all-string export with its columns cast to ``types`` (from ``infer_types``; a name in
    DATE_COLUMNS is a date).  Without ``types`` only the dates are typed.  Texts that stand
    for no value are null, also in text columns; so is what is no date."""
    def cast(c):
        kind = "date" if c.upper() in DATE_COLUMNS else (types or {}).get(c, "string")
        column = F.col(f"`{c}`")
        if kind == "date":
            return column.try_cast("date").alias(c)
        if types is None:
            return column
        value = value_of(column)
        return (value if kind == "string" else F.trim(value).try_cast(kind)).alias(c)

    return df.select(*map(cast, df.columns))


def convert_table(spark: SparkSession, name: str, paths: list[str], out_dir: str,
                  keep: list[str] | str | None = None, dedup_key: str | None = "Id",
                  multiline: bool = True) -> TableResult:
    """Merge, dedup, type, prune and write one table as Snappy Parquet.

    Duplicates are removed by ``dedup_key`` wherever the export has it, allow-listed or not.
    Column order in the output is the file's, not the allow-list's; a missing allow-listed
    column fails this table only.  The merged texts are parsed once and written to the shared
    scratch folder; that write also observes the counts and the kinds of every column's values,
    which type the final write.
    """
    keep = KEEP_COLUMNS.get(name) if keep is None else keep
    if keep is None:
        return TableResult(name, "skipped", message="not in allow-list")
    in_bytes = sum(path_bytes(spark, p) for p in paths)
    found = {"files": len(paths), "input_bytes": in_bytes}
    df = merge_exports(spark, paths, multiline)
    all_cols = [c for c in df.columns if c not in ("_src", "_row")]
    if not all_cols:
        return TableResult(name, "empty", **found)
    cols = all_cols
    if keep != "*":
        missing = [c for c in keep if c.lower() not in {x.lower() for x in cols}]
        if missing:
            return TableResult(name, "error", message=f"missing columns {missing}", **found)
        lowered = {k.lower() for k in keep}
        cols = [c for c in cols if c.lower() in lowered]
    key = next((c for c in all_cols if dedup_key and c.lower() == dedup_key.lower()), None)
    # The counts are observed during the single write job (observations keep the values of
    # the first action that runs them, so no other action may touch these frames first).
    obs_in = Observation(f"merged_{name}_{uuid.uuid4().hex[:8]}")
    df = df.observe(obs_in, F.count(F.lit(1)).alias("rows"))
    if key is not None:
        kept = [c for c in cols if c != key]
        df = dedup_keep_first(df.select(key, *kept, "_src", "_row"), key, ["_src", "_row"])
    raw = df.select(*cols)
    dates = [c for c in cols if c.upper() in DATE_COLUMNS]
    others = [c for c in cols if c not in dates]
    bad = [F.count(F.when((F.trim(f"`{c}`") != "") & F.col(f"`{c}`").try_cast("date").isNull(), 1))
           for c in dates]
    kinds = [k.alias(f"kinds_{i}") for i, k in enumerate(kinds_seen(others))]
    obs = Observation(f"rows_{name}_{uuid.uuid4().hex[:8]}")
    target, texts = f"{out_dir.rstrip('/')}/{name}", scratch_dir(spark, "texts")
    (raw.observe(obs, F.count(F.lit(1)).alias("rows"),
                 (sum(bad, F.lit(0)) if bad else F.count(F.lit(None))).alias("rejected"), *kinds)
     .write.mode("overwrite").parquet(texts))
    if not obs.get["rows"]:               # only empty / header-only exports (S3)
        return TableResult(name, "empty", **found)
    types = {c: type_of(obs.get[f"kinds_{i}"]) for i, c in enumerate(others)}
    (typed(spark.read.schema(raw.schema).parquet(texts), types).write.mode("overwrite")
     .option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "snappy").parquet(target))
    rows = int(obs.get["rows"])
    parts = len(list_files(spark, f"{target}/*.parquet"))
    return TableResult(name, "ok", rows=rows, merged_rows=int(obs_in.get["rows"]), parts=parts,
                       output_bytes=path_bytes(spark, target),
                       rejected_dates=int(obs.get["rejected"]), **found)


def convert_exports(spark: SparkSession, roots: list[str], out_dir: str,
                    keep_columns: dict | None = None) -> DataFrame:
    """Convert every ``csv/<table>.csv`` at any depth under the roots into Parquet; returns the
    load report (S8).

    Files whose table is not in the allow-list are skipped (not an error); one failing table
    does not stop the others.
    """
    keep_columns = KEEP_COLUMNS if keep_columns is None else keep_columns
    by_table: dict[str, list[str]] = {}
    for r in roots:
        for p in find_files(spark, r, ".csv"):
            if p.rsplit("/", 2)[-2] == "csv":
                by_table.setdefault(p.rsplit("/", 1)[1][:-4], []).append(p)
    results = []
    for name in sorted(by_table):
        paths = sorted(set(by_table[name]))
        if name not in keep_columns:
            results.append(TableResult(name, "skipped", files=len(paths), message="not in allow-list"))
            continue
        try:
            results.append(convert_table(spark, name, paths, out_dir, keep_columns[name]))
        except Exception as e:  # noqa: BLE001 - one table's failure is reported, not raised
            results.append(TableResult(name, "error", message=str(e)))
    return load_report(spark, results)


def load_report(spark: SparkSession, results: list[TableResult]) -> DataFrame:
    """table, status, rows, parts, input_bytes, output_bytes, ratio + a TOTAL row.

    ratio = input / output bytes (0 when nothing was written); the TOTAL row's status is
    'success' iff processed tables = total - skipped.
    """
    schema = ("table string, status string, rows long, merged_rows long, parts long, "
              "input_bytes long, output_bytes long, files long, rejected_dates long, message string")
    df = spark.createDataFrame([(r.table, r.status, r.rows, r.merged_rows, r.parts, r.input_bytes,
                                 r.output_bytes, r.files, r.rejected_dates, r.message)
                                for r in results], schema)
    total = df.agg(
        F.lit("TOTAL").alias("table"),
        F.when(F.count(F.when(F.col("status").isin("ok", "empty"), 1))
               == F.count(F.lit(1)) - F.count(F.when(F.col("status") == "skipped", 1)),
               "success").otherwise("partial").alias("status"),
        F.sum("rows").alias("rows"), F.sum("merged_rows").alias("merged_rows"),
        F.sum("parts").alias("parts"),
        F.sum("input_bytes").alias("input_bytes"), F.sum("output_bytes").alias("output_bytes"),
        F.sum("files").alias("files"), F.sum("rejected_dates").alias("rejected_dates"),
        F.lit("").alias("message"))
    out = df.unionByName(total)
    ratio = F.when(F.col("output_bytes") > 0, F.col("input_bytes") / F.col("output_bytes")) \
             .otherwise(F.lit(0.0))
    removed = F.col("merged_rows") - F.col("rows")
    return out.withColumn("ratio", F.round(ratio, 6)).withColumn(
        "duplicates_removed", F.when(F.col("status") == "empty", F.lit(0)).otherwise(removed)
    ).withColumn("removed_pct", F.round(F.coalesce(F.try_divide(
        F.col("duplicates_removed") * 100.0, F.col("merged_rows")), F.lit(0.0)), 6))


def register_parquet_views(spark: SparkSession, root: str) -> list[str]:
    """Each Parquet subdirectory of ``root`` becomes a temp view (S9); bad dirs are skipped."""
    fs, p = _hadoop_fs(spark, root)
    done = []
    for st in fs.listStatus(p) if fs.exists(p) else []:
        if not st.isDirectory():
            continue
        name = st.getPath().getName()
        try:
            spark.read.parquet(str(st.getPath())).createOrReplaceTempView(name)
            done.append(name)
        except Exception:  # noqa: BLE001
            continue
    return done


# ---------------------------------------------------------------- S10 / S11 / S13 / S15 / S17 / S19

SAMPLE_SCHEMA = T.StructType([T.StructField("text", T.StringType()),
                              T.StructField("label", T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema=SAMPLE_SCHEMA, strict: bool = False) -> DataFrame:
    """JSON-lines scan: malformed lines dropped, or the whole load fails when ``strict``."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def write_jsonl_if_absent(df: DataFrame, path: str) -> None:
    """JSON-lines sink that leaves an existing output alone."""
    df.write.mode("ignore").json(path)


def write_with_meta(df: DataFrame, meta: DataFrame, path: str) -> None:
    """Dataset as Parquet plus a one-row JSON metadata sidecar."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def result_document(predictions: DataFrame, summary: DataFrame, metadata: dict,
                    path: str) -> None:
    """A run's results (S15): ``path/predictions`` as a table, and ``path/document``, one JSON
    object with the run's metadata, its one-row summary and its metrics."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])
    (summary.select(meta.alias("metadata"), F.struct(*summary.columns).alias("metrics"))
     .coalesce(1).write.mode("overwrite").json(f"{path}/document"))


def to_result_documents(df: DataFrame, cols: list[str], name: str = "doc") -> DataFrame:
    """One JSON text per row from the named columns (S15); large tables stay tables."""
    return df.select(F.to_json(F.struct(*cols)).alias(name))


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """describe()-style summary as (stat, value) CSV rows."""
    cols = summary.columns
    long = summary.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("s")).select("s.*")
    long.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_records(df: DataFrame, path: str, extras: list[str] | None = None) -> None:
    """Append log records; open extra fields travel in a MAP<STRING,STRING>."""
    extras = extras or []
    base = [c for c in df.columns if c not in extras]
    m = (F.map_from_arrays(F.array(*[F.lit(c) for c in extras]),
                           F.array(*[F.col(c).cast("string") for c in extras]))
         if extras else F.create_map().cast("map<string,string>"))
    df.select(*base, m.alias("extra")).write.mode("append").parquet(path)


# ---------------------------------------------------------------- S14 / S16

def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail if a column is missing, then drop rows with a null in any of them."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.dropna(subset=cols)


def load_router_config(spark: SparkSession, path: str) -> tuple:
    """Router domains from a JSON file ``{domain: {"keywords": [...], "agent_id": "..."}}`` (S16):
    a tuple of ``routing.Domain``, in the file's order.  A missing file raises, a domain without
    keywords or agent is an error.  The config is a few KB of settings, not data."""
    from casebook.operators.routing import Domain
    fs, p = _hadoop_fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    text = spark.read.text(escape_glob(path), wholetext=True).first()[0]
    out = []
    for name, spec in json.loads(text).items():
        if not isinstance(spec, dict) or not spec.get("keywords") or not spec.get("agent_id"):
            raise ValueError(f"{path}: domain {name!r} needs keywords and agent_id")
        out.append(Domain(name, tuple(str(k) for k in spec["keywords"]), str(spec["agent_id"])))
    return tuple(out)


def load_domain_config(spark: SparkSession, text: str | None) -> DataFrame:
    """code -> domain frame from a small JSON config ``{domain: {"codes": [...]}}``.

    A missing config gives an empty map; a malformed domain entry is skipped; when a code
    is listed under several domains the last one wins.  The config is a few KB of settings
    read on the driver, not data.
    """
    rows = []
    if text:
        cfg = json.loads(text)
        for dom, spec in cfg.items():
            if isinstance(spec, dict) and isinstance(spec.get("codes"), list):
                rows += [(str(c), dom) for c in spec["codes"]]
    last = {}
    for code, dom in rows:
        last[code] = dom
    return spark.createDataFrame(sorted(last.items()), "code string, domain string")
