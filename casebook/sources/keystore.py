"""Keep-first merge of exports that arrive one after the other (S4, S11), without reading the rest.

A store holds rows by key: the first load that brought a key keeps it.  Rows lie in
``data/load=<load>/bucket=<hash of the key>``; next to each (load, bucket) there is a Bloom
filter of its keys.  A new load

1. keeps the first row of each of its own keys,
2. asks the filters of its keys' buckets: most new keys are told apart from all stored ones
   there and then,
3. reads the stored *keys* of only those buckets where some filter said "maybe", and drops what
   is really there,
4. appends the rest, writes their filters, and last of all the load's marker, which makes the
   load visible.

So a load costs its own rows, the filters (about ``BITS_PER_KEY`` bits per stored key) and the
hit buckets' key column.  Loads are named: one that has its marker is skipped, one that failed
half-way has none and is written anew.  A null key is a key of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.plans.stage import materialise
from casebook.session import reach_workers
from casebook.sources.ingest import _hadoop_fs, dedup_keep_first, escape_glob, list_files

BUCKETS = 64
BITS_PER_KEY, HASHES = 12, 8


class Bloom:
    """A Bloom filter over 64-bit hashes, its bits in a byte string (a power of two of them)."""

    def __init__(self, raw: bytes):
        self.bits = np.frombuffer(raw, dtype=np.uint8)
        self.size = np.uint64(8 * len(raw))

    @staticmethod
    def places(hashes: np.ndarray, size: np.uint64) -> np.ndarray:
        """One line per hash function: two halves of a scrambled hash, combined."""
        h = hashes.astype(np.int64).view(np.uint64)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(i) * step) & (size - np.uint64(1)) for i in range(HASHES)])

    @classmethod
    def of(cls, hashes: np.ndarray) -> bytes:
        size = 1 << max(6, int(BITS_PER_KEY * max(1, len(hashes)) - 1).bit_length())
        bits = np.zeros(size // 8, dtype=np.uint8)
        at = cls.places(hashes, np.uint64(size)).ravel()
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        return bits.tobytes()

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, self.size)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


@dataclass
class LoadResult:
    load: str
    rows_in: int = 0
    rows_new: int = 0
    buckets_read: int = 0          # buckets whose stored keys were read
    skipped: bool = False          # the load was there already


class KeyStore:
    """Rows by key under ``path``; ``key`` is the key column's name."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        known = self._read_json(f"{self.path}/store.json")
        if known is None:
            self._write_json(f"{self.path}/store.json", {"key": key, "buckets": buckets})
        elif known["key"] != key:
            raise ValueError(f"{path} is keyed by {known['key']}")
        self.buckets = known["buckets"] if known else buckets
        reach_workers(spark)

    # ------------------------------------------------------------ small files of the store

    def _read_json(self, path: str) -> dict | None:
        fs, p = _hadoop_fs(self.spark, path)
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.text(escape_glob(path), wholetext=True).first()[0])

    def _write_json(self, path: str, value: dict) -> None:
        fs, p = _hadoop_fs(self.spark, path)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _markers(self) -> list[dict]:
        found = [self._read_json(p) for p in list_files(self.spark, f"{escape_glob(self.path)}/loads/*.json")]
        return sorted(found, key=lambda f: f["number"])

    def loads(self) -> list[str]:
        """Names of the visible loads, in the order in which they came."""
        return [m["load"] for m in self._markers()]

    def _data(self) -> list[DataFrame]:
        """One frame per visible load (its marker holds the schema: a load may be without rows)."""
        return [self.spark.read.schema(T.StructType.fromJson(m["schema"])).parquet(
            escape_glob(f"{self.path}/data/load={m['load']}")) for m in self._markers()]

    # ------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        """All rows of the store (columns that a load did not have are null)."""
        frames = [f.drop("bucket") for f in self._data()]
        if not frames:
            raise FileNotFoundError(f"{self.path} holds no load")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def _stored_keys(self, buckets: list[int]) -> DataFrame:
        frames = [f.where(F.col("bucket").isin(buckets)).select(self._key()) for f in self._data()]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    def _key(self):
        return F.col(f"`{self.key}`").alias("_key")

    # ------------------------------------------------------------ writing

    def merge(self, rows: DataFrame, load: str, order: list[str]) -> LoadResult:
        """Add a load; of rows with one key the first by ``order`` counts, and none whose key the store
        holds already.  ``order`` columns are not stored."""
        loads = self.loads()
        if load in loads:
            return LoadResult(load, skipped=True)
        hashed = F.xxhash64(F.col(f"`{self.key}`"))
        first = dedup_keep_first(rows, self.key, order).drop(*order)
        first = materialise(first.withColumn("_h", hashed)
                            .withColumn("bucket", F.pmod("_h", F.lit(self.buckets)).cast("int")))
        result = LoadResult(load, rows_in=rows.count())
        if loads:
            maybe = materialise(self._maybe(first, loads))
            hit = sorted(r[0] for r in maybe.select("bucket").distinct().collect())     # at most ``buckets``
            result.buckets_read = len(hit)
            if hit:
                asked = first.join(maybe.select("_h").distinct(), "_h", "left_semi").select(self._key())
                there = asked.join(self._stored_keys(hit).withColumnRenamed("_key", "_old"),
                                   F.col("_key").eqNullSafe(F.col("_old")), "left_semi")
                first = first.join(there.distinct(), F.col(f"`{self.key}`").eqNullSafe(F.col("_key")), "left_anti")
        target = f"{self.path}/data/load={load}"
        first.drop("_h").write.mode("overwrite").partitionBy("bucket").parquet(target)
        self._filters(first).write.mode("overwrite").parquet(f"{self.path}/filters/load={load}")
        schema = first.drop("_h").schema
        result.rows_new = self.spark.read.schema(schema).parquet(escape_glob(target)).count()
        self._write_json(f"{self.path}/loads/{load}.json",
                         {"load": load, "number": len(loads), "schema": schema.jsonValue()})
        return result

    def _filters(self, rows: DataFrame) -> DataFrame:
        def build(table: pa.Table) -> pa.Table:
            return pa.table({"bucket": table.column("bucket").slice(0, 1),
                             "bits": pa.array([Bloom.of(table.column("_h").to_numpy())], pa.binary())})

        return rows.select("bucket", "_h").groupBy("bucket").applyInArrow(build, "bucket int, bits binary")

    def _maybe(self, rows: DataFrame, loads: list[str]) -> DataFrame:
        """bucket, _h of the rows whose key some filter of their bucket may hold."""
        filters = self.spark.read.schema("bucket int, bits binary").parquet(
            *[escape_glob(f"{self.path}/filters/load={name}") for name in loads])

        def probe(new: pa.Table, known: pa.Table) -> Iterator[pa.Table]:
            hashes = new.column("_h").to_numpy()
            found = np.zeros(len(hashes), dtype=bool)
            for raw in known.column("bits").to_pylist():
                found |= Bloom(raw).may_hold(hashes)
            return new.filter(pa.array(found))

        return (rows.select("bucket", "_h").groupBy("bucket").cogroup(filters.groupBy("bucket"))
                .applyInArrow(probe, "bucket int, _h long"))
