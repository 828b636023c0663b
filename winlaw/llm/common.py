"""What the corpus operators share: scratch tables, Arrow access, worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[\x20\x09-\x0D]`, the white space of the contracts, as a Java and a Python pattern.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: ASCII letters and everything beyond ASCII, after lower-casing also A-Z.
ALPHA_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged. All-ASCII texts take Spark's fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, if all run on this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="winlaw-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: Arrow batches of Spark's default of 10,000 rows would take tens of megabytes several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if "b" in spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower() or int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > 1 << 23:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 23))


class Scratch:
    """Tables written to the shared folder; each cuts the lineage behind it and survives lost executors."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/winlaw-{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def forget(self, *kept: DataFrame) -> None:
        """Deletes tables that nothing reads any more; a table that keep() didn't give is left alone."""
        for df in kept:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def join_rows(docs: DataFrame, keyed: DataFrame, how: str, id_col: str, text_col: str, more: dict[str, str] | None = None) -> DataFrame:
    """docs joined with keyed on (doc_id, text_key), a row's id and the hash of its text; `more` names columns of keyed and what they become."""
    free = [f"_{i}_{uuid.uuid4().hex}" for i in range(2)]
    more = more or {}
    right = keyed.select(F.col("doc_id").alias(free[0]), F.col("text_key").alias(free[1]), *(F.col(k).alias(v) for k, v in more.items())).dropDuplicates(free)
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(right, docs[id_col].cast("long").eqNullSafe(right[free[0]]) & (key == right[free[1]]), how).drop(*free)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker; tasks and queries of one worker share it."""
    home = sys.modules.setdefault("_winlaw_worker_cache", types.ModuleType("_winlaw_worker_cache"))
    return home.__dict__.setdefault(name, {})


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and the n + 1 offsets of its values; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of values of about `limit` bytes, so that temporary arrays stay small; a longer value stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
