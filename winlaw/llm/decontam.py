"""Benchmark decontamination with DataFrame functions only.

A benchmark item's windows are its 13 consecutive words, or all of them if it has
fewer. The windows' first word pairs make two fixed-size bitmaps that travel as
literals; a text's positions that pass both are hashed and meet the windows in a hash
join (broadcast up to `broadcast_rows` windows, a shuffle join beyond). A hit is
verified by a second, independent 64-bit hash of the window's words and its length.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALPHA_RE, Scratch, join_rows, lower_ascii


@dataclass(frozen=True)
class DecontamSpec:
    """n: words of a window. share: of a document's words, from which on it counts as contaminated."""

    n: int = 13
    share: float = 0.05
    bitmap_bits: int = 1 << 17
    broadcast_rows: int = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(ALPHA_RE), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(words: Column, start: Column, length: Column) -> tuple[Column, Column]:
    window = F.slice(words, start + 1, length)
    return F.xxhash64(window), F.xxhash64(F.lit(13), window)


def _pair(h: Column, i: Column, salt: int) -> Column:
    """Of the hashes of two words next to each other: their number in a bitmap, before the mask."""
    return F.xxhash64(F.get(h, i + salt), F.get(h, i + salt + 1), F.lit(salt))


def windows(items: DataFrame, spec: DecontamSpec, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, len, a, b, p0, p2, one): each window's length, two hashes, its pairs' numbers, and its first word's hash."""
    words = items.select(items[id_col].cast("string").alias("item_id"), words_of(items[text_col]).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("len", F.least(F.lit(spec.n), F.size("words")))
    at = words.select("item_id", "len", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("i"))
    a, b = _hashes(F.col("words"), F.col("i"), F.col("len"))
    h = F.transform("words", lambda w: F.xxhash64(w))
    at = at.withColumn("h", h)
    return at.select("item_id", "len", a.alias("a"), b.alias("b"), _pair(F.col("h"), F.col("i"), 0).alias("p0"), _pair(F.col("h"), F.col("i"), 2).alias("p2"), F.get("h", F.col("i")).alias("one")).distinct()


def _bitmap(numbers: DataFrame, column: str, spec: DecontamSpec) -> Column:
    """A literal of bitmap_bits bits. At most that many numbers come to the driver."""
    bits = np.zeros(spec.bitmap_bits, np.uint8)
    mask = spec.bitmap_bits - 1
    for r in numbers.select(F.col(column).bitwiseAND(mask).cast("int").alias("x")).distinct().collect():
        bits[r["x"]] = 1
    longs = np.packbits(bits, bitorder="little").view("<i8")
    return F.split(F.lit(",".join(map(str, longs.tolist()))), ",").cast("array<bigint>")


def _has(bitmap: Column, x: Column, spec: DecontamSpec) -> Column:
    place = x.bitwiseAND(spec.bitmap_bits - 1)
    word = F.get(bitmap, F.shiftright(place, 6).cast("int"))
    bit = F.call_function("shiftright", word, place.bitwiseAND(63).cast("int"))
    return bit.bitwiseAND(1) == 1


def scan(docs: DataFrame, items: DataFrame, spec: DecontamSpec, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: doc_id, text_key, n_words, n_hit, n_items, items (sorted ids), spans (merged, in words), contaminated.

    Null or empty text has no words and no hits; a null item text has no windows; an item
    without id gives hits but is not listed. Repeated rows get equal results of their own.
    No benchmark: nothing is hit. No documents: no rows. Other columns are not read.
    """
    grams = scratch.keep(windows(items, spec, item_id, item_text))
    lens = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most n values
    if not lens:
        lens = [spec.n]
    pairs, seconds = (_bitmap(grams.filter(F.col("len") >= k), c, spec) for c, k in (("p0", 2), ("p2", 4)))
    ones = _bitmap(grams.filter("len = 1"), "one", spec) if lens[0] == 1 else None
    second_counts = all(x >= 4 for x in lens if x > 1)

    def passes(h: Column, i: Column) -> Column:
        ok = _has(pairs, _pair(h, i, 0), spec)
        if second_counts:
            ok = ok & _has(seconds, _pair(h, i, 2), spec)
        if ones is not None:
            ok = ok | _has(ones, F.get(h, i), spec)
        return ok

    def candidates(words: Column) -> Column:
        found = let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.filter(F.sequence(F.lit(0), F.size(words) - lens[0]), lambda i: passes(h, i)),
        )

        def at(i: Column) -> Column:
            each = [F.when(i + n <= F.size(words), F.struct(i.alias("i"), F.lit(n).alias("len"), *(x.alias(k) for k, x in zip("ab", _hashes(words, i, F.lit(n)), strict=True)))) for n in lens]
            return F.filter(F.array(*each), lambda x: x.isNotNull())

        return F.when(F.size(words) >= lens[0], F.flatten(F.transform(found, at)))

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    seen = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        let(words_of(docs[text_col]), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), candidates(w).alias("c"))).alias("s"),
    )
    seen = scratch.keep(seen.select("doc_id", "text_key", "s.n_words", "s.c", F.monotonically_increasing_id().alias("rid")))
    small = grams.select("item_id", "len", "a", "b").distinct()
    if small.count() <= spec.broadcast_rows:
        small = F.broadcast(small)
    hits = seen.select("rid", F.inline("c")).join(small, ["len", "a", "b"])
    merged = hits.groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set(F.struct(F.col("i").alias("start"), (F.col("i") + F.col("len")).alias("end")))).alias("spans"))
    merged = merged.withColumn("spans", _merge(F.col("spans")))
    out = seen.drop("c").join(merged, "rid", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.lit(0).cast("long"))
    out = out.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * spec.share))


def _merge(spans: Column) -> Column:
    """Sorted spans of words with those that touch or overlap made one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, empty, step)


def remove_documents(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones; a row is known by its id and the hash of its text."""
    return join_rows(docs, scanned.filter("contaminated"), "left_anti", id_col, text_col)


def remove_spans(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column clean_words: the words outside all spans, lower-cased."""
    own = f"_s_{uuid.uuid4().hex}"
    joined = join_rows(docs.drop("clean_words"), scanned.filter("n_hit > 0"), "left", id_col, text_col, {"spans": own})
    none = F.array().cast("array<struct<start:int,end:int>>")

    def outside(words: Column) -> Column:
        return F.filter(words, lambda x, i: ~F.exists(F.coalesce(F.col(own), none), lambda s: (i >= s["start"]) & (i < s["end"])))

    return joined.withColumn("clean_words", let(words_of(joined[text_col]), outside)).drop(own)
