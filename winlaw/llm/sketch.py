"""Count-min sketches built per partition and merged by block, and fixed-size bitmaps of keys.

A partition's sketch is sparse: the cells it touched and their counts, cut into blocks.
Blocks are merged where they meet, a few megabytes at a time; all that reaches the driver
is one bit for each cell: whether its count is at least `least`. Its size is fixed by the
spec, whatever the input. A key's count is never underestimated, so a key whose true count
is at least `least` always passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 20


@dataclass(frozen=True)
class SketchSpec:
    """rows: hash functions. bits: log2 of the cells of a row; the merged bitmap has rows * 2^bits / 8 bytes."""

    rows: int = 2
    bits: int = 26


PARTIAL = "block int, cells binary, counts binary"
_ODD = [np.uint64(1), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def cells(keys: np.ndarray, row: int, spec: SketchSpec) -> np.ndarray:
    return ((keys * _ODD[row]) >> np.uint64(64 - spec.bits)).astype(np.int64)


class PartialSketch:
    """Gathers keys of one partition; memory is bounded by `held` keys."""

    def __init__(self, spec: SketchSpec, held: int = 1 << 20):
        self.spec, self.held, self.keys, self.n = spec, held, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.n += len(keys)
        if self.n >= self.held:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, self.keys, self.n = np.concatenate(self.keys), [], 0
        width = min(BLOCK, 1 << self.spec.bits)
        blocks, idx, counts = [], [], []
        for r in range(self.spec.rows):
            cell, n = np.unique(cells(keys, r, self.spec), return_counts=True)
            block = cell // width
            cuts = np.flatnonzero(np.diff(block)) + 1
            n = np.minimum(n, 255).astype(np.uint8)
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                blocks.append(r * ((1 << self.spec.bits) // width) + int(block[a]))
                idx.append((cell[a:b] % width).astype("<u4").tobytes())
                counts.append(n[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(idx, pa.binary()), pa.array(counts, pa.binary())], names=["block", "cells", "counts"])


def merge(partials: DataFrame, spec: SketchSpec, least: int) -> np.ndarray:
    """The bitmap of cells with a count of at least `least`, as rows of packed bits."""
    width = min(BLOCK, 1 << spec.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = held.setdefault(b, np.zeros(width, np.uint8))
                at = np.frombuffer(c, "<u4")
                own[at] = np.minimum(own[at].astype(np.uint16) + np.frombuffer(n, np.uint8), 255)
        for b, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(own >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros((spec.rows << spec.bits) // 8, np.uint8)
    size = width // 8
    for r in partials.repartition("block").mapInArrow(run, "block int, bits binary").collect():  # at most the bitmap
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(spec.rows, -1)


def passes(bitmap: np.ndarray, keys: np.ndarray, spec: SketchSpec) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for r in range(spec.rows):
        c = cells(keys, r, spec)
        ok &= (bitmap[r][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return ok


def key_bitmap(keys: DataFrame, column: str, spec: SketchSpec) -> np.ndarray:
    """A Bloom filter, as a bitmap for passes(), of a column of 64-bit keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = PartialSketch(spec)
        for batch in batches:
            yield from part.add(np.unique(np.asarray(batch.column(0)).astype(np.uint64)))
        yield from part.flush()

    return merge(keys.select(column).mapInArrow(run, PARTIAL), spec, 1)
