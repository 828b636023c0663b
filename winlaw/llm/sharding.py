"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered from 0 in the order of (id, size, checksum); number r goes to place
P(r), where P permutes 0..N-1; shard = P(r) mod shards and slot = P(r) div shards. So
shard counts differ by one at most, slots have no gaps, and a row's shard and slot
follow from N, the key and its number alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _round_keys(seed: int) -> list[int]:
    base = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [int(k) for k in _mix(base, seed & (2**64 - 1))]


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """P on 0..n-1. A Feistel network over Z_a x Z_b with a * b just above n; what falls beyond n walks its cycle until it is back below n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    ua, ub, keys = np.uint64(a), np.uint64(b), _round_keys(seed)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // ub, v % ub
        for i, k in enumerate(keys):
            if i % 2:
                right = (right + _mix(left, k) % ub) % ub
            else:
                left = (left + _mix(right, k) % ua) % ua
        return left * ub + right

    out = once(np.asarray(x, np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def invert(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number at each place: P backwards."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    ua, ub, keys = np.uint64(a), np.uint64(b), _round_keys(seed)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // ub, v % ub
        for i, k in reversed(list(enumerate(keys))):
            if i % 2:
                right = (right + (ub - _mix(left, k) % ub)) % ub
            else:
                left = (left + (ua - _mix(right, k) % ua)) % ua
        return left * ub + right

    out = once(np.asarray(y, np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list[str], scratch: Scratch, name: str = "row_number") -> tuple[DataFrame, int]:
    """rows with global numbers 0.. in the given order, and how many there are.

    The sorted rows are written once, with their partition and place in it, so that
    numbers do not depend on a second, different range partitioning. Only the counts
    of partitions come to the driver. Equal rows share the range of a key; a place in
    the input breaks ties between partitions.
    """
    tie = F.monotonically_increasing_id()
    keyed = rows.withColumn("_tie", tie)
    parts = keyed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = scratch.keep(parts.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("c")).orderBy("_p").collect()
    starts, total = {}, 0
    for r in counts:
        starts[r["_p"]] = total
        total += r["c"]
    offsets = placed.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_p long, _start long")
    out = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return out.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_id", "_start"), total


def shard(docs: DataFrame, shards: int, scratch: Scratch, seed: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every row.

    size is the text's UTF-8 bytes plus 8 (null: 8, checksum 0). Null ids come first. Repeated
    rows are rows of their own. An empty table gives no rows. Texts are read once and not moved.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    small = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    numbered, total = number_rows(small, ["doc_id", "size", "text_crc32"], scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permute(np.asarray(batch.column("row_number")).astype(np.uint64), total, seed)
            cols = {n: batch.column(n) for n in ("doc_id", "size", "text_crc32")}
            n = batch.num_rows
            cols |= {"law": pa.array(["rows"] * n), "shard": pa.array((place % shards).astype(np.int32)), "slot": pa.array(place // shards), "grown_shard": pa.nulls(n, pa.int32()), "row_number": batch.column("row_number")}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return numbered.mapInArrow(run, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, row_number long")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, rows_per_file: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as one folder for each shard, in files of rows_per_file slots, sorted by slot; placed is what shard() gave for docs.

    A row of docs takes a place of its id, size and checksum; rows that repeat these take one each. Null ids and texts and empty
    texts are rows as others; an empty table writes no folder. Columns of docs named shard or slot are replaced.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = ["_doc", "_size", "_crc"]
    rows = docs.withColumns({"_doc": docs[id_col].cast("long"), "_size": (F.octet_length(text) + 8).cast("long"), "_crc": F.crc32(F.encode(text, "UTF-8"))}).drop("shard", "slot")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.monotonically_increasing_id())))
    places = placed.select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "size", "text_crc32"), key, strict=True)], F.col("shard"), F.col("slot"))
    places = places.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")))
    met = places.select(*[F.col(c).alias(f"_of{c}") for c in (*key, "_nth")], "shard", "slot")
    same = F.lit(True)
    for c in (*key, "_nth"):
        same = same & rows[c].eqNullSafe(met[f"_of{c}"])
    joined = rows.join(met, same).drop(*key, "_nth", *met.columns[:4]).withColumn("_part", F.floor(F.col("slot") / rows_per_file))
    joined.repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part").write.partitionBy("shard").parquet(path)
