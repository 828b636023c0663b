"""Quality grades by ordinal regression on hashed words.

Cumulative link model: P(grade >= j) = s(w.x - t_j) for j = 1..G-1, one weight vector for
all grades and ordered thresholds t_1 <= ... <= t_(G-1); s is the logistic function. x has
a value for each hashed feature in the text: its words, lower-cased, its runs of marks, and
its shape (length, share of distinct words, of marks and of capitals, in steps). A feature's
value is how far its share of rows differs between a grade and the others, so that words
that say nothing add no noise to long texts; it is multiplied into the weights in the end.

The model is fitted on a bounded sample of graded rows, as many of each grade as there
are, up to `rows_per_grade`, in the order of a hash of their ids. Scoring is one pass over all
texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, utf8
from .wordhash import hash_words, mix


@dataclass(frozen=True)
class OrdinalSpec:
    """grades: how many, from 0. rows_per_grade bounds the sample that is fitted, and row_features what a row of it counts with:
    of more features those of least number, 4 bytes each (so the driver gets at most grades * rows_per_grade * row_features of them); a feature
    in fewer than min_rows of its rows, of a smaller value than min_value, or whose difference is below min_sure standard errors, has weight 0; grades count by their rows to the power 1 - balance. The sample is gone through `epochs` times, and until there were `updates`. keep_grade, keep_prob: a row is kept if
    P(grade >= keep_grade) >= keep_prob."""

    grades: int = 3
    bits: int = 20
    rows_per_grade: int = 12000
    row_features: int = 1000
    min_rows: int = 5
    min_value: float = 0.7
    min_sure: float = 3.0
    balance: float = 0.25
    epochs: int = 8
    updates: int = 1000
    batch: int = 64
    rate: float = 0.1
    l2: float = 1e-5
    keep_grade: int = 2
    keep_prob: float = 0.5
    seed: int = 4


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray


def features(data: np.ndarray, off: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges lo..hi of texts: the text (from lo) and number of each distinct feature, by text."""
    for lo, hi in slices(off):
        keys, counts = [], []
        for kind in ("alnum", "marks"):
            h, first, _, _ = hash_words(data, off[lo : hi + 1], lower=True, kind=kind)
            text = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(first))
            keys.append((text << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
            counts.append(np.diff(first))
        words, marks = counts
        distinct = np.bincount(np.unique(keys[0]) >> bits, minlength=hi - lo)
        b = data[off[lo] : off[hi]]
        run = np.concatenate([[0], np.cumsum((b >= 65) & (b <= 90))])
        capitals = run[off[lo + 1 : hi + 1] - off[lo]] - run[off[lo:hi] - off[lo]]
        length = np.log2(words + 1).astype(np.int64)
        share = lambda x, y: np.minimum(np.ceil(20 * x / np.maximum(y, 1)), 40).astype(np.int64)
        shape = [length * 64 + share(distinct, words), share(marks, words), share(capitals, words)]
        for j, x in enumerate(shape):
            h = mix((x + (j << 32)).astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
            keys.append((np.arange(hi - lo) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
        key = np.sort(np.concatenate(keys))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        yield lo, hi, key >> bits, key & ((1 << bits) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gradient(z: np.ndarray, t: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted negative log-likelihood of grades y at scores z and thresholds t: its terms, and its slopes by z and by t."""
    edge = np.concatenate([[-np.inf], t, [np.inf]])
    up, down = _sigmoid(z - edge[y]), _sigmoid(z - edge[y + 1])  # P(>= y), P(>= y + 1)
    p = np.maximum(up - down, 1e-9)
    gu, gd = up * (1 - up) / p * weight, down * (1 - down) / p * weight
    return -weight * np.log(p), gd - gu, np.bincount(y, gu, minlength=len(t) + 1)[1:] - np.bincount(y, gd, minlength=len(t) + 1)[:-1]


def fit_arrays(grade: np.ndarray, first: np.ndarray, idx: np.ndarray, spec: OrdinalSpec) -> OrdinalModel:
    """Texts' features are idx[first[i]:first[i + 1]]. AdaGrad on the weighted likelihood."""
    rng = np.random.default_rng(spec.seed)
    size, g = 1 << spec.bits, spec.grades
    w, acc = np.zeros(size), np.full(size, 1e-3)
    t, t_acc = np.linspace(-0.5, 0.5, g - 1), np.full(g - 1, 1e-3)
    count = np.maximum(np.bincount(grade, minlength=g), 1)
    weight = ((len(grade) / (g * count)) ** spec.balance)[grade]
    owner = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(first))
    rows_with = np.stack([np.bincount(idx[grade[owner] == k], minlength=size) for k in range(g)])
    total = rows_with.sum(0)
    value, sure = np.zeros(size), np.zeros(size)
    p = np.clip(total / len(grade), 1e-9, 1 - 1e-9)
    for k in range(g):
        own, rest = rows_with[k], total - rows_with[k]
        n, m = count[k], max(len(grade) - count[k], 1)
        value = np.maximum(value, np.abs(np.log((own + 1) / (n + 2) * (m + 2) / (rest + 1))))
        sure = np.maximum(sure, np.abs(own / n - rest / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m)))
    kept = (total >= spec.min_rows) & (value >= spec.min_value) & (sure >= spec.min_sure)
    owner = owner[kept[idx]]
    idx, first = idx[kept[idx]], np.searchsorted(owner, np.arange(len(grade) + 1))
    batches = -(-len(grade) // spec.batch)
    for _ in range(max(spec.epochs, -(-spec.updates // batches))):
        order = rng.permutation(len(grade))
        for lo in range(0, len(order), spec.batch):
            rows = order[lo : lo + spec.batch]
            n = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            f, row = idx[at], np.repeat(np.arange(len(rows)), n)
            x = value[f]
            z = np.bincount(row, w[f] * x, minlength=len(rows))
            y = grade[rows]
            _, gz, gt = gradient(z, t, y, weight[rows])
            u, inv = np.unique(f, return_inverse=True)
            gw = np.bincount(inv, gz[row] * x, minlength=len(u)) / len(rows) + spec.l2 * w[u]
            acc[u] += gw * gw
            w[u] -= spec.rate * gw / np.sqrt(acc[u])
            gt = gt / len(rows)
            t_acc += gt * gt
            t = np.maximum.accumulate(t - spec.rate * gt / np.sqrt(t_acc))
    return OrdinalModel((w * value).astype(np.float32), t)


def fit(docs: DataFrame, grades: DataFrame, spec: OrdinalSpec, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """grades: (id, grade). Null or unknown grades and ids are passed over; without any row the model is all zero."""
    rows = grades.select(F.col(id_col).cast("long").alias("_d"), F.col("grade").cast("int").alias("_g")).dropna()
    some = None
    for g in range(spec.grades):
        own = rows.filter(F.col("_g") == g).orderBy(F.xxhash64("_d"), "_d").limit(spec.rows_per_grade)
        some = own if some is None else some.unionByName(own)
    text = docs.select(docs[id_col].cast("long").alias("_d"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))
    joined = text.join(F.broadcast(some), "_d").select("_d", "_g", "_t")  # at most grades * rows_per_grade rows of 12 bytes
    bits, most = spec.bits, spec.row_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            for lo, hi, t, f in features(data, off, bits):
                first = np.searchsorted(t, np.arange(hi - lo + 1))
                raw = f.astype("<i4")
                parts = [raw[a : min(b, a + most)].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(parts, pa.binary())], names=["_d", "_g", "f"])

    got = joined.mapInArrow(run, "_d long, _g int, f binary").toArrow().combine_chunks()
    if not got.num_rows:
        return OrdinalModel(np.zeros(1 << bits, np.float32), np.zeros(spec.grades - 1))
    raw = got.column("f").to_pylist()
    order = sorted(range(got.num_rows), key=list(zip(got.column("_d").to_pylist(), got.column("_g").to_pylist(), raw, strict=True)).__getitem__)
    idx = np.frombuffer(b"".join(raw[i] for i in order), "<i4")
    first = np.concatenate([[0], np.cumsum([len(raw[i]) // 4 for i in order])]).astype(np.int64)
    return fit_arrays(np.asarray(got.column("_g")).astype(np.int64)[order], first, idx, spec)


def score(docs: DataFrame, model: OrdinalModel, spec: OrdinalSpec, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability (P(grade >= keep_grade)) and keep, in the place of columns so named.

    A null or empty text has no features and gets the thresholds' own probabilities; equal
    texts get equal results; repeated rows stay; an empty table gives no rows.
    """
    docs = docs.drop("expected_grade", "tail_probability", "keep")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    out = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        for batch in batches:
            data, off = utf8(batch.column(at).cast(pa.string()))
            z = np.zeros(batch.num_rows)
            for lo, hi, text, f in features(data, off, spec.bits):
                z[lo:hi] = np.bincount(text, w[f].astype(np.float64), minlength=hi - lo)
            tail = _sigmoid(z[:, None] - t[None, :])
            p = tail[:, spec.keep_grade - 1]
            cols = [*batch.columns, pa.array(tail.sum(1)), pa.array(p), pa.array(p >= spec.keep_prob)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "expected_grade", "tail_probability", "keep"])

    return docs.mapInArrow(run, out)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the table of labels: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
