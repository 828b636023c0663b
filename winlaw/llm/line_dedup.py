"""Line dedup that can be undone: exact reference counts, and cuckoo filters of the lines to drop.

State, two tables:
  counts   (h1 long, h2 long, docs long)              documents that hold each line key
  filters  (shard int, filter binary, keys long)      cuckoo filter of the keys with docs >= min_docs
A key is hashed to 128 bits; its shard is a function of the hash, and there are as many shards
as the number of keys asks for. Inserting or deleting documents adds or takes away counts,
and moves in the filters just the keys that cross min_docs. Lines pass the filters first and
are then held against the exact counts, so a filter's false positives drop nothing.

The filters and counts of the `broadcast_keys` keys that most documents hold travel to the texts.
Where there are more, the texts' other lines go to the filters: each shard's filter is read
before its lines, and the lines that pass meet the exact counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, binary_array, utf8
from .cuckoo import CuckooFilter

KEYS = "h1 long, h2 long, docs long"
FILTERS = "shard int, filter binary, keys long"


@dataclass(frozen=True)
class LineSpec:
    """min_docs: documents from which on a line goes. shard_keys: keys of a shard, about so many. broadcast_keys: up to so many
    keys to drop (16 bytes each, and about 3 of filters) travel to the tasks as a broadcast. shard_lines: lines of a shard that one task takes."""

    min_docs: int = 10
    shard_keys: int = 100_000
    broadcast_keys: int = 2_000_000
    shard_lines: int = 1_000_000


@dataclass(frozen=True)
class LineState:
    counts: DataFrame
    filters: DataFrame
    shards: int


def line_keys(raw: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and of each the 16-byte hash of its key, b"" for an empty key."""
    lines = raw.split(b"\n")
    return lines, [xxhash.xxh3_128_digest(k) if (k := x.strip(b" \t\n\r\x0b\x0c").lower()) else b"" for x in lines]


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _shard(h1, shards: int):
    return F.pmod(h1, F.lit(shards)).cast("int")


def _keys_of(batches: Iterator[pa.RecordBatch], tagged: bool) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each text (column 0), with the text's tag (column 1) or summed within the batch."""
    for batch in batches:
        data, off = utf8(batch.column(0))
        raw, seen, tags, keys = memoryview(data), {}, [], []
        for i in range(batch.num_rows):
            own = {k for k in line_keys(bytes(raw[off[i] : off[i + 1]]))[1] if k}
            if tagged:
                keys += own
                tags += [i] * len(own)
            else:
                for k in own:
                    seen[k] = seen.get(k, 0) + 1
        h1, h2 = _halves(keys if tagged else list(seen))
        if tagged:
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(1).take(pa.array(tags, pa.int64()))], names=["h1", "h2", "tag"])
        elif seen:
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(list(seen.values()), pa.int64())], names=["h1", "h2", "docs"])


def count_lines(docs: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """counts of a table of documents. Rows of one id are one document; a row without id is one of its own.

    Counts are summed within each batch before the shuffle; only rows whose id repeats are told apart by their ids.
    """
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].cast("string").alias("id"))
    again = scratch.keep(rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    single = rows
    found = None
    if again.take(1):
        single = rows.join(again, "id", "left_anti").select("text", "id")
        pairs = rows.join(again, "id", "left_semi").select("text", "id").mapInArrow(lambda b: _keys_of(b, True), "h1 long, h2 long, tag string")
        found = pairs.distinct().select("h1", "h2", F.lit(1).cast("long").alias("docs"))
    own = single.select("text").mapInArrow(lambda b: _keys_of(b, False), KEYS)
    found = own if found is None else own.unionByName(found)
    return found.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))


def _build(shard: int, keys: np.ndarray) -> pd.DataFrame:
    size = len(keys)
    while True:
        f = CuckooFilter.sized(size)
        if f.insert(keys):
            return pd.DataFrame({"shard": [shard], "filter": [f.to_bytes()], "keys": [len(keys)]})
        size *= 2


def to_drop(counts: DataFrame, spec: LineSpec) -> DataFrame:
    return counts.filter(F.col("docs") >= spec.min_docs)


def build_filters(drop: DataFrame, shards: int) -> DataFrame:
    rows = drop.select(_shard(F.col("h1"), shards).alias("shard"), "h1")
    return rows.groupBy("shard").applyInPandas(lambda pdf: _build(int(pdf.shard[0]), pdf.h1.to_numpy()), FILTERS)


def shards_for(keys: int, spec: LineSpec) -> int:
    return max(1, -(-keys // spec.shard_keys))


def build(docs: DataFrame, spec: LineSpec, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> LineState:
    counts = scratch.keep(count_lines(docs, scratch, text_col, id_col))
    drop = to_drop(counts, spec)
    shards = shards_for(drop.count(), spec)
    return LineState(counts, scratch.keep(build_filters(drop, shards)), shards)


def update(state: LineState, spec: LineSpec, scratch: Scratch, inserted: DataFrame | None = None, deleted: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id") -> LineState:
    """The state after documents came and went, each with all its rows. Deleting what was inserted gives the state before, counts
    and answers alike. Filters are built anew where they are outgrown, and all of them when there are twice as many keys as shards are for."""
    parts = [count_lines(d, scratch, text_col, id_col).withColumn("docs", F.lit(sign) * F.col("docs")) for d, sign in ((inserted, 1), (deleted, -1)) if d is not None]
    if not parts:
        return state
    change = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    both = state.counts.withColumn("old", F.col("docs")).unionByName(change.withColumn("old", F.lit(0).cast("long")))
    both = scratch.keep(both.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.sum("old").alias("old")))
    counts = scratch.keep(both.filter("docs > 0").select("h1", "h2", "docs"))
    drop = to_drop(counts, spec)
    keys = drop.count()
    if keys > 2 * state.shards * spec.shard_keys:
        return LineState(counts, scratch.keep(build_filters(drop, shards_for(keys, spec))), shards_for(keys, spec))
    was, now = F.col("old") >= spec.min_docs, F.col("docs") >= spec.min_docs
    crossed = both.filter(was != now).select(_shard(F.col("h1"), state.shards).alias("shard"), "h1", now.alias("now"))

    def move(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        shard = int((filters if len(filters) else keys).shard.iloc[0])
        add, gone = keys.h1[keys.now].to_numpy(np.int64), keys.h1[~keys.now].to_numpy(np.int64)
        if len(filters):
            f, n = CuckooFilter.from_bytes(filters["filter"].iloc[0]), int(filters["keys"].iloc[0])
        else:
            f, n = CuckooFilter(), 0
        f.delete(gone)
        fits = n + len(add) - len(gone) <= 0.9 * f.table.size and f.insert(add)
        return pd.DataFrame({"shard": [shard], "filter": [f.to_bytes() if fits else b""], "keys": [n + len(add) - len(gone)]})

    moved = scratch.keep(state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(move, FILTERS))
    full = moved.filter(F.length("filter") == 0).select("shard")  # outgrown: built anew from the counts
    rebuilt = build_filters(drop.join(F.broadcast(full), _shard(F.col("h1"), state.shards) == full["shard"], "left_semi"), state.shards)
    return LineState(counts, scratch.keep(moved.filter(F.length("filter") > 0).unionByName(rebuilt)), state.shards)


def drop_lines(docs: DataFrame, state: LineState, spec: LineSpec, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """docs with the columns n_lines, n_dropped and kept_text; all rows stay.

    Null or empty text: one empty line, kept. A key is a line stripped of white space
    and lower-cased (A-Z); empty keys are never dropped. A text all of whose lines go
    is left empty. Repeated rows get equal results. Columns of docs named like the new
    ones are replaced. A text is one row of a batch, however long.
    """
    drop = to_drop(state.counts, spec).select("h1", "h2", "docs")
    plain = docs.drop("n_lines", "n_dropped", "kept_text")
    n = drop.count()
    if n <= spec.broadcast_keys:
        return _apply(plain, state, drop, text_col)
    least = _most_held(drop, spec.broadcast_keys)
    top = drop.filter(F.col("docs") >= least)
    tag = F.sha2(F.coalesce(plain[text_col].cast("string"), F.lit("")), 256)
    found = _by_filters(plain.select(tag.alias("tag"), plain[text_col].cast("string").alias("text")), state, drop.filter(F.col("docs") < least), scratch, spec)
    free = f"_gone_{scratch.n}"
    joined = plain.withColumn("_tag", tag).join(found.select(F.col("tag").alias("_tag"), F.col("gone").alias(free)), "_tag", "left").drop("_tag")
    return _apply(joined, state, top, text_col, free)


def _most_held(drop: DataFrame, most: int) -> int:
    """The least number of documents from which on there are at most `most` keys."""
    total, least = 0, None
    for r in drop.groupBy(F.least("docs", F.lit(100_000)).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect():  # at most 100,000 rows
        total += r["k"]
        if total > most:
            break
        least = r["c"]
    return 1 << 62 if least is None else least


def _by_filters(texts: DataFrame, state: LineState, drop: DataFrame, scratch: Scratch, spec: LineSpec) -> DataFrame:
    """(tag, gone): of each distinct text the keys in drop, its lines having passed the filter of their shard.

    drop holds none of the commonest keys, so no shard's lines grow beyond others' by much; they are dealt into parts all the same.
    """
    distinct = texts.dropDuplicates(["tag"]).select("text", "tag")
    lines = distinct.mapInArrow(lambda b: _keys_of(b, True), "h1 long, h2 long, tag string")
    lines = scratch.keep(lines.withColumn("shard", _shard(F.col("h1"), state.shards)))
    most = lines.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, -(-most // spec.shard_lines))
    none = [F.lit(None).cast(k).alias(c) for c, k in (("h1", "long"), ("h2", "long"), ("tag", "string"))]
    filters = state.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *none, "filter")
    keyed = lines.select("shard", F.pmod(F.xxhash64("tag"), F.lit(salts)).cast("int").alias("salt"), "h1", "h2", "tag", F.lit(None).cast("binary").alias("filter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            shard, salt = np.asarray(batch.column("shard")), np.asarray(batch.column("salt"))
            h1 = np.asarray(batch.column("h1").fill_null(0)).astype(np.int64)
            keep = np.zeros(batch.num_rows, bool)
            filters_ = np.asarray(batch.column("filter").is_valid())
            cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])])).tolist() if len(shard) else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if key != (shard[a], salt[a]):
                    key, own = (shard[a], salt[a]), None
                if filters_[a]:
                    own = CuckooFilter.from_bytes(batch.column("filter")[a].as_py())
                if own is not None:
                    keep[a:b] = own.contains(h1[a:b]) & ~filters_[a:b]
            yield batch.select(["h1", "h2", "tag"]).filter(pa.array(keep))

    both = filters.unionByName(keyed).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    maybe = both.mapInArrow(run, "h1 long, h2 long, tag string")
    sure = maybe.join(drop.select("h1", "h2"), ["h1", "h2"])
    return sure.groupBy("tag").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_lines long, n_dropped long, kept_text string").fields])


def _apply(docs: DataFrame, state: LineState, exact: DataFrame, text_col: str, gone_col: str | None = None) -> DataFrame:
    """Drops the lines whose keys pass the filters and are in exact (a bounded number of keys), and those in the row's own gone_col."""
    sc = docs.sparkSession.sparkContext
    keys = exact.select("h1", "h2").toPandas()  # at most spec.broadcast_keys rows of 16 bytes
    raw = np.stack([keys.h1.to_numpy("<i8"), keys.h2.to_numpy("<i8")], 1)
    if gone_col is None:
        filters = {r["shard"]: bytes(r["filter"]) for r in state.filters.select("shard", "filter").collect()}  # as many keys
        shards = state.shards
    else:  # the filters of all keys stay where they are; those that travel have one of their own
        filters, shards = {0: _build(0, raw[:, 0])["filter"][0]} if len(raw) else {}, 1
    shared = sc.broadcast((raw.tobytes(), filters))
    names = [c for c in docs.columns if c != gone_col]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_exact, raw_filters = shared.value
        known = {raw_exact[i : i + 16] for i in range(0, len(raw_exact), 16)}
        by_shard = {s: CuckooFilter.from_bytes(f) for s, f in raw_filters.items()}
        for batch in batches:
            own = batch.column(gone_col).to_pylist() if gone_col else []
            batch = batch.select(names)
            data, off = utf8(batch.column(at))
            raw = memoryview(data)
            texts, keys, ends = [], [], [0]
            for i in range(batch.num_rows):
                lines, k = line_keys(bytes(raw[off[i] : off[i + 1]]))
                texts.append(lines)
                keys += k
                ends.append(len(keys))
            h1 = np.frombuffer(b"".join(k or bytes(16) for k in keys), "<i8")[::2]
            maybe, shard = np.zeros(len(keys), bool), h1 % shards
            for s, f in by_shard.items():
                mine = np.flatnonzero(shard == s)
                maybe[mine] = f.contains(h1[mine])
            dropped = np.zeros(len(keys), bool)
            for j in np.flatnonzero(maybe).tolist():
                dropped[j] = keys[j] in known
            for i, g in enumerate(own):
                if g:
                    more = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in g}
                    for j in range(ends[i], ends[i + 1]):
                        dropped[j] = dropped[j] or keys[j] in more
            yield _result(batch, texts, dropped, ends)

    return docs.mapInArrow(run, _schema(docs.select(names)))


def _result(batch: pa.RecordBatch, texts: list[list[bytes]], dropped: np.ndarray, ends: list[int]) -> pa.RecordBatch:
    kept, n_dropped = [], []
    for lines, a, b in zip(texts, ends, ends[1:], strict=False):
        d = dropped[a:b]
        n_dropped.append(int(d.sum()))
        kept.append(b"\n".join(lines) if not n_dropped[-1] else b"\n".join(x for x, y in zip(lines, d.tolist(), strict=True) if not y))
    cols = [*batch.columns, pa.array([len(x) for x in texts], pa.int64()), pa.array(n_dropped, pa.int64()), binary_array(kept).cast(pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "n_lines", "n_dropped", "kept_text"])
