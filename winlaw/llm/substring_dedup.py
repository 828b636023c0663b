"""Exact removal of repeated passages, behind count-min prefilters.

A window is `window` consecutive words. Of the short grams in a window the one of least
hash is its anchor (the first, if equal), so equal windows have equal anchors, and a
sketch of anchor counts overestimates window counts with a tenth of the keys:

1. Every partition counts its anchors in a sketch; merged, a bitmap says which anchors may
   occur twice. Then every partition counts the windows of those anchors, and a second merged
   bitmap says which windows may. Both are sized from the corpus, up to a bound.
2. The windows estimated repeated are written, one row for each anchor's place with the
   hashes from its first such window to its last, and grouped exactly by anchor. Anchors of
   more than `hot` places are dealt into parts before they are shuffled, so no task gets all
   places of a common passage.
3. An anchor's windows start at consecutive words, fewer than `window` of them; so the
   first and last repeated one bound what they cover. Spans go back to their documents.

No window is lost, however full the sketches are: they only decide what is left out of step 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_array, slices, utf8
from .sketch import PARTIAL, PartialSketch, SketchSpec, merge, passes
from .wordhash import hash_words, long_grams, mix


@dataclass(frozen=True)
class SubstringSpec:
    """window: words of a passage. gram: words of an anchor. hot: places from which on an anchor is dealt into parts, and
    hot_keys: how many anchors at most are (the commonest; 12 bytes each travel to the tasks). partition_windows: about so
    many windows are grouped in one task. cells: of a sketch's row for each of its keys; max_bits: at most 2^so many of
    them. sketch: of a given size instead."""

    window: int = 35
    gram: int = 12
    hot: int = 500
    hot_keys: int = 1_000_000
    partition_windows: int = 500_000
    cells: int = 4
    max_bits: int = 29
    sketch: SketchSpec | None = None

    def sized(self, keys: int) -> SketchSpec:
        return self.sketch or SketchSpec(rows=2, bits=min(self.max_bits, max(20, (self.cells * keys - 1).bit_length())))


def anchor_runs(h: np.ndarray, first: np.ndarray, spec: SubstringSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with word hashes h and first words `first` (n + 1): for each anchor's place its hash, text, first window and number of windows; and all windows' hashes.

    Windows are numbered by their first word in h."""
    none = np.zeros(0, np.int64)
    if len(h) < spec.window:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    arg_val = long_grams(h, spec.gram)
    arg = np.arange(len(arg_val), dtype=np.int32)
    span, have = spec.window - spec.gram + 1, 1
    while have < span:  # least gram of ever longer ranges; the left one wins ties
        step = min(have, span - have)
        left, right = arg_val[:-step], arg_val[step:]
        take = right < left
        arg_val, arg = np.where(take, right, left), np.where(take, arg[step:], arg[:-step])
        have += step
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(text[: len(h) - spec.window + 1] == text[spec.window - 1 :])
    if not len(whole):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    own = arg[whole]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
    count = np.diff(np.append(begin, len(own)))
    return arg_val[whole[begin]], text[whole[begin]], whole[begin], count, long_grams(h, spec.window)


def _counted(docs: DataFrame, spec: SubstringSpec) -> int:
    """About how many anchors the texts have: two in each stretch of grams of a window and one more, of words of six bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return total // 6 * 2 // (spec.window - spec.gram + 2) + 1


def _sketch(docs: DataFrame, spec: SubstringSpec, size: SketchSpec, first: tuple[np.ndarray, SketchSpec] | None = None) -> np.ndarray:
    """The bitmap of anchors that may occur twice; with that, `first`, the bitmap of windows that may."""
    shared = docs.sparkSession.sparkContext.broadcast(first and first[0])
    of = first and first[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = PartialSketch(size)
        for batch in batches:
            data, off = utf8(batch.column(0))
            for lo, hi in slices(off):
                h, begin, _, _ = hash_words(data, off[lo : hi + 1], lower=False)
                anchor, _, at, n, win = anchor_runs(h, begin, spec)
                if of is None:
                    yield from part.add(anchor)
                else:
                    yield from part.add(win[_passing((shared.value, of), anchor, at, n)[1]])
        yield from part.flush()

    return merge(docs.select("text").mapInArrow(run, PARTIAL), size, 2)


def _passing(first: tuple[np.ndarray, SketchSpec], anchor: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places whose anchors pass, their windows, and of each such window the place."""
    ok = np.flatnonzero(passes(first[0], anchor, first[1]))
    ends = np.cumsum(n[ok])
    place = np.repeat(np.arange(len(ok)), n[ok])
    which = np.arange(len(place)) + np.repeat(at[ok] - (ends - n[ok]), n[ok])
    return ok, which, place


PLACES = "h long, doc_id long, text_key long, start int, windows binary"


def _places(docs: DataFrame, first: tuple[np.ndarray, SketchSpec], second: tuple[np.ndarray, SketchSpec], spec: SubstringSpec) -> DataFrame:
    shared, sizes = docs.sparkSession.sparkContext.broadcast((first[0], second[0])), (first[1], second[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows_ = zip(shared.value, sizes, strict=True)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            data, off = utf8(batch.column(2))
            for lo, hi in slices(off):
                h, begin, _, _ = hash_words(data, off[lo : hi + 1], lower=False)
                anchor, text, start, count, win = anchor_runs(h, begin, spec)
                ok, which, place = _passing(anchors, anchor, start, count)
                hit = np.flatnonzero(passes(windows_[0], win[which], windows_[1]))
                if not len(hit):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], place[hit][1:] != place[hit][:-1]]))
                a, z = which[hit[edge]], which[hit[np.append(edge[1:], len(hit)) - 1]]  # first and last such window of a place
                own, n = ok[place[hit[edge]]], z - a + 1
                ends = np.cumsum(n)
                raw = win[np.repeat(a - (ends - n), n) + np.arange(ends[-1])].astype("<u8")
                windows = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], ends * 8]).astype("<i4")), pa.py_buffer(raw)])
                rows = pa.array(text[own] + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[own].view(np.int64)), ids.take(rows), keys.take(rows), pa.array((a - begin[text[own]]).astype(np.int32)), windows],
                    names=["h", "doc_id", "text_key", "start", "windows"],
                )

    return docs.mapInArrow(run, PLACES)


SPANS = "doc_id long, text_key long, first int, last int"


def _light(places: DataFrame, partitions: int) -> DataFrame:
    """first and last repeated window of each place, its anchors' places all in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        raw, off = utf8(t.column("windows"))
        n = np.diff(off) // 8
        w = raw[off[0] : off[-1]].view("<u8")
        place = np.repeat(np.arange(t.num_rows), n)
        h = np.asarray(t.column("h")).astype(np.int64).view(np.uint64)[place]
        key = mix(h) ^ w
        order = np.argsort(key, kind="stable")
        k, hs = key[order], h[order]
        same = k[1:] == k[:-1]
        if (same & (hs[1:] != hs[:-1])).any():  # two anchors' windows met in one key: sort by both
            order = np.lexsort((h, key))
            k, hs = key[order], h[order]
            same = (k[1:] == k[:-1]) & (hs[1:] == hs[:-1])
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.sort(order[twice])
        if not len(hit):
            return
        rows = place[hit]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(rows) != 0]))
        end = np.append(begin[1:], len(rows)) - 1
        row = rows[begin]
        base = np.asarray(t.column("start"))[row] - np.concatenate([[0], np.cumsum(n)])[row]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [t.column("doc_id").combine_chunks().take(take), t.column("text_key").combine_chunks().take(take), pa.array((hit[begin] + base).astype(np.int32)), pa.array((hit[end] + base).astype(np.int32))],
            names=["doc_id", "text_key", "first", "last"],
        )

    return places.repartition(partitions, "h").mapInArrow(run, SPANS)


def _deal(places: DataFrame, hot: DataFrame, spec: SubstringSpec) -> DataFrame:
    """places with `part`: for the anchors of `hot` (h, n), at most spec.hot_keys of them, one of n / spec.hot parts, else null."""
    table = hot.toPandas().sort_values("h")
    shared = places.sparkSession.sparkContext.broadcast((table.h.to_numpy(np.int64), -(-table.n.to_numpy(np.int64) // spec.hot)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = shared.value
        for batch in batches:
            h = np.asarray(batch.column(0)).astype(np.int64)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            there = known[at] == h
            doc = np.asarray(batch.column(1).fill_null(-1)).astype(np.int64)
            key = np.asarray(batch.column(2)).astype(np.int64) ^ np.asarray(batch.column(3)).astype(np.int64) << 40
            part = (mix(mix(doc.view(np.uint64)) ^ key.view(np.uint64)) % parts[at].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, mask=~there)], names=[*batch.schema.names, "part"])

    return places.mapInArrow(run, PLACES + ", part int")


def _hot(dealt: DataFrame, scratch: Scratch) -> DataFrame:
    """As _light() for anchors with more places than one task should hold, dealt into parts.

    Each part lists its distinct windows with their counts; summed over parts, these say
    which windows repeat, and the part gets back those it has. So what is joined are
    windows of parts, not of places.
    """

    def windows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raw, off = utf8(t.column("windows"))
        n = np.diff(off) // 8
        return raw[off[0] : off[-1]].view("<i8"), np.repeat(np.arange(t.num_rows), n)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        w, place = windows(t)
        h, part = (np.asarray(t.column(c))[place] for c in ("h", "part"))
        order = np.lexsort((w, part, h))
        h, part, w = h[order], part[order], w[order]
        begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (w[1:] != w[:-1])]))
        n = np.minimum(np.diff(np.append(begin, len(w))), 2)
        yield pa.RecordBatch.from_arrays([pa.array(h[begin]), pa.array(part[begin].astype(np.int32)), pa.array(w[begin]), pa.array(n)], names=["h", "part", "w", "n"])

    own = scratch.keep(dealt.repartition("h", "part").mapInArrow(distinct, "h long, part int, w long, n long"))
    repeated = own.groupBy("h", "w").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "w")
    back = own.join(repeated, ["h", "w"])
    none = [F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("text_key", "long"), ("start", "int"), ("windows", "binary"))]
    both = back.select("h", "part", "w", *none).unionByName(dealt.withColumn("w", F.lit(None).cast("long")).select("h", "part", "w", "doc_id", "text_key", "start", "windows"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, sorted_known = None, [], None
        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for h, part, w, doc, text, start, raw in zip(*cols, strict=True):
                if key != (h, part):
                    key, known, sorted_known = (h, part), [], None
                if raw is None:
                    known.append(w)
                    continue
                if sorted_known is None:
                    sorted_known = np.sort(np.array(known, np.int64))
                if len(sorted_known):
                    x = np.frombuffer(raw, "<i8")
                    hit = np.flatnonzero(sorted_known[np.minimum(np.searchsorted(sorted_known, x), len(sorted_known) - 1)] == x)
                    if len(hit):
                        out.append((doc, text, start + int(hit[0]), start + int(hit[-1])))
            if out:
                doc, text, first, last = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["doc_id", "text_key", "first", "last"])

    order = both.repartition("h", "part").sortWithinPartitions("h", "part", F.col("windows").isNotNull())
    return order.mapInArrow(bound, SPANS)


def _hottest(places: DataFrame, spec: SubstringSpec, scratch: Scratch) -> DataFrame:
    """(h, n) of the anchors with more than spec.hot places, or with so many more that there are at most spec.hot_keys of them."""
    hot = scratch.keep(places.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > spec.hot))
    total, least = 0, 1 << 62
    for r in hot.groupBy(F.least("n", F.lit(100_000)).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect():  # at most 100,000 rows
        total += r["k"]
        if total > spec.hot_keys:
            break
        least = r["c"]
    return hot.filter(F.col("n") >= least)


def spans(docs: DataFrame, spec: SubstringSpec, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, first, last): windows first..last of a text start in repeated ones and cover all between. docs: doc_id, text_key, text."""
    anchors = _counted(docs, spec)
    size = spec.sized(anchors)
    first = _sketch(docs, spec, size), size
    size = spec.sized(2 * anchors)  # windows: about twelve to an anchor, of the sixth or so of anchors that pass
    second = _sketch(docs, spec, size, first), size
    places = scratch.keep(_places(docs, first, second, spec))
    hot = _hottest(places, spec, scratch)
    total = places.agg(F.sum(F.length("windows"))).first()[0] or 0
    partitions = max(8, -(-total // (8 * spec.partition_windows)))
    if not hot.take(1):
        return _light(places, partitions)
    dealt = _deal(places, hot, spec)
    return _light(dealt.filter("part IS NULL").drop("part"), partitions).unionByName(_hot(dealt.filter("part IS NOT NULL"), scratch))


def remove_repeats(docs: DataFrame, spec: SubstringSpec, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row: its words outside repeated windows, joined by one space.

    Words are runs without `[\\x20\\x09-\\x0D]`. Null or empty text: no words, empty kept_text. A
    text of fewer words than a window loses nothing. Repeated rows are each other's
    repeats. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = spans(plain, spec, scratch).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "spans")
    joined = plain.join(found.hint("shuffle_hash"), plain.doc_id.eqNullSafe(F.col("_d")) & (plain.text_key == F.col("_k")), "left").select("doc_id", "text", "spans")
    window = spec.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw, kept, n_words, n_removed = memoryview(data), [], [], []
            for i, s in enumerate(batch.column(2).to_pylist()):
                words = bytes(raw[off[i] : off[i + 1]]).split()
                n_words.append(len(words))
                if s:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, [x["first"] for x in s], 1)
                    np.add.at(edge, [x["last"] + window for x in s], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                kept.append(b" ".join(words))
                n_removed.append(n_words[-1] - len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), binary_array(kept).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
