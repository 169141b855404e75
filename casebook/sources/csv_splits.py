"""CSV with line breaks inside quoted fields, read in parallel inside one file.

A quoted line break looks like a record's end, so a reader that starts in the middle of a file
cannot know where records begin; the usual way out reads each file in one task.  Here lines
come in splits of any size (Spark's splittable text source), in two passes:

1. A split does not know whether it starts inside a quoted field, so it is read under both
   assumptions: what state would it end in?  The answers, two flags per split, are chained in
   file order, which tells every split its true starting state.
2. From its state each split puts its lines together to records alone.  Only the lines at its
   edges can belong to a record that crosses the edge: these pieces (at most two per split) meet
   in one small shuffle.

A quote opens a field only at the field's start and is literal in the middle of an unquoted one, as
in Spark's own parser, which then takes the record texts apart.  Lines without quotes never
change the state; a batch without any is passed on as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.session import reach_workers

#: An unquoted field, or a whole quoted one (with doubled quotes) and what follows it.
FIELD = re.compile(r'(?:"(?:[^"]|"")*+"[^,]*|(?!")[^,]*)(?:,|\Z)', re.S)
#: The rest of a quoted field that an earlier line opened.
REST = re.compile(r'(?:[^"]|"")*+"[^,]*(?:,|\Z)', re.S)


def ends_inside(line: str, inside: bool) -> bool:
    """Does a line end inside a quoted field, when it starts inside one or not?"""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        rest = REST.match(line)
        if rest is None:
            return True
        at = rest.end()
        if at == len(line):
            return False
    while at < len(line):
        field = FIELD.match(line, at)
        if field is None:                    # an opened field without its end
            return True
        at = field.end()
    return False


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file (number of a path), raw (the path as Spark reports it), split (its start in the file) and
    value of each line, in file order inside a split.  Lines end with LF; a CR before it stays."""
    from casebook.sources.ingest import escape_glob
    raw = F.col("_metadata.file_path")
    return (spark.read.option("lineSep", "\n").text([escape_glob(p) for p in paths])
            .select(F.xxhash64(raw).alias("file"), raw.alias("raw"),
                    F.col("_metadata.file_block_start").alias("split"), "value"))


def _runs(batch: pa.RecordBatch) -> list[int]:
    """Where the rows of another split begin in a batch (0 included)."""
    file, split = (batch.column(c).to_numpy() for c in ("file", "split"))
    return [0, *(np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1).tolist()]


def _end_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, raw, split and the states it ends in, for a start outside and inside.  Lines without
    quotes are null: they change no state, but their splits are listed."""
    states, names = {}, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        for i in _runs(batch):
            key = batch.column("file")[i].as_py(), batch.column("split")[i].as_py()
            states.setdefault(key, (False, True))
            names[key[0]] = batch.column("raw")[i].as_py()
        quoted = batch.filter(batch.column("value").is_valid())
        for file, split, value in zip(*(quoted.column(c).to_pylist() for c in ("file", "split", "value"))):
            states[file, split] = tuple(ends_inside(value, s) for s in states[file, split])
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in states], pa.int64()), pa.array([names[k[0]] for k in states], pa.string()),
         pa.array([k[1] for k in states], pa.int64()),
         pa.array([s[0] for s in states.values()], pa.bool_()), pa.array([s[1] for s in states.values()], pa.bool_())],
        names=["file", "raw", "split", "from_outside", "from_inside"])


def start_states(lines: DataFrame) -> DataFrame:
    """file, path, split, inside: does the split start inside a quoted field?  One row per split."""
    from casebook.sources.ingest import decoded
    quoted = lines.withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")))
    ends = quoted.mapInArrow(_end_states, "file long, raw string, split long, from_outside boolean, from_inside boolean")
    chain = ends.groupBy("file", "raw").agg(
        F.sort_array(F.collect_list(F.struct("split", "from_outside", "from_inside"))).alias("ends"))
    # (state, states before each split so far), along the splits of one file
    start = F.struct(F.lit(False).alias("now"), F.array().cast("array<boolean>").alias("seen"))
    walked = F.aggregate("ends", start, lambda s, e: F.struct(
        F.when(s["now"], e["from_inside"]).otherwise(e["from_outside"]).alias("now"),
        F.concat(s["seen"], F.array(s["now"])).alias("seen")))
    return (chain.select("file", decoded(F.col("raw")).alias("path"),
                         F.explode(F.arrays_zip(F.col("ends.split").alias("split"), walked["seen"].alias("inside")))
                         .alias("s")).select("file", "path", "s.split", "s.inside"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and pieces of records that cross a split: file, split, place, begins, ends, value."""
    key, inside, parts, begins, place = None, False, [], True, 0
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    names = ["file", "split", "place", "begins", "ends", "value"]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        value, splits = batch.column("value"), batch.column("split")
        one = (batch.column("file")[0].as_py(), splits[0].as_py())
        same = len(_runs(batch)) == 1
        if same and one == key and not inside and not parts and \
                pc.sum(pc.count_substring(value, '"')).as_py() == 0:
            true = pa.array(np.ones(n, dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), splits, pa.array(np.arange(place, place + n)), true, true, value],
                names=names)
            place += n
            continue
        rows = []
        for file, split, started_inside, line in zip(*(batch.column(c).to_pylist()
                                                       for c in ("file", "split", "inside", "value"))):
            if (file, split) != key:
                if parts:
                    rows.append((*key, place, begins, False, "\n".join(parts)))
                key, inside, parts, begins, place = (file, split), started_inside, [], not started_inside, 0
            parts.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                rows.append((*key, place, begins, True, "\n".join(parts)))
                parts, begins, place = [], True, place + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                             names=names)
    if parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip((*key, place, begins, False, "\n".join(parts)), kinds)], names=names)


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, row (grows along the file) and value (the whole text) of every record.

    The table of starting states has one row per split (of ``spark.sql.files.maxPartitionBytes``,
    128 MB unless set), about a byte per megabyte of input, is written once and broadcast; a line
    carries its file's number instead of the path.  A quote that is never closed makes the rest of
    its file one record."""
    from casebook.plans.stage import materialise
    reach_workers(spark)
    lines = lines_of(spark, paths)
    states = materialise(start_states(lines))
    known = lines.drop("raw").join(F.broadcast(states.drop("path")), ["file", "split"])
    pieces = known.select("file", "split", "inside", "value").mapInArrow(
        _records, "file long, split long, place long, begins boolean, ends boolean, value string")
    # records have a byte at least, so a place never reaches the next split's start
    row = (F.col("split") + F.col("place")).alias("row")
    whole = pieces.where("begins AND ends").select("file", row, "value")
    # a record that crosses splits: its first piece begins, the pieces after it do not
    earlier = Window.partitionBy("file").orderBy("split", "begins")
    torn = (pieces.where("NOT (begins AND ends)")
            .withColumn("number", F.sum(F.col("begins").cast("long")).over(earlier))
            .groupBy("file", "number").agg(F.sort_array(F.collect_list(
                F.struct("split", "place", "value"))).alias("parts")))
    joined = torn.select("file", (F.col("parts")[0]["split"] + F.col("parts")[0]["place"]).alias("row"),
                         F.array_join(F.col("parts.value"), "\n").alias("value"))
    files = states.select("file", "path").distinct()
    return whole.union(joined).join(F.broadcast(files), "file").select("path", "row", "value")
