"""Packing documents into sequences by attention cost.

A piece of L tokens is taken to cost `linear * L + quadratic * L^2`. The pieces
of a chunk of documents are dealt in descending length, each to the sequence of
lowest cost so far that still has room for it; what fits nowhere is cut and
fills the room that is left, so that only the last sequence of a chunk is short.

A chunk is a run of documents of one input partition, so packing needs no
shuffle, a task holds the ids of one chunk only, and a lost task is done again
from its own input. A sequence's id holds its partition, chunk and place.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import utf8, worker_cache

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


@dataclass(frozen=True)
class PackSpec:
    """capacity: tokens of a sequence. chunk_tokens: packed together, which bounds memory. end_id: put after each document."""

    tokenizer: str
    capacity: int = 4096
    end_id: int | None = 2
    linear: float = 1.0
    quadratic: float = 1.0 / 4096
    chunk_tokens: int = 1 << 21
    cache_words: int = 1 << 19


def assign(lengths: np.ndarray, spec: PackSpec) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every token is in exactly one.

    A document of at least `capacity` tokens first gives full sequences. Of the
    rest, in descending length (ties: the earlier document first), each goes to
    the sequence of least cost with room for all of it. Pieces for which no
    sequence has room are cut over the sequences with most room.
    """
    cap, pieces, n_seq, rest = spec.capacity, [], 0, []
    for i, n in enumerate(lengths.tolist()):
        full, tail = divmod(n, cap)
        for f in range(full):
            pieces.append((i, f * cap, cap, n_seq, 0))
            n_seq += 1
        if tail:
            rest.append((-tail, i, full * cap))
    if not rest:
        return pieces
    rest.sort()
    bins = -(-sum(-t for t, _, _ in rest) // cap)
    used, cost = [0] * bins, [0.0] * bins
    heap, roomy, left = [(0.0, s) for s in range(bins)], [(-cap, s) for s in range(bins)], []

    def put(i: int, start: int, n: int, s: int) -> None:
        pieces.append((i, start, n, n_seq + s, used[s]))
        used[s] += n
        cost[s] += spec.linear * n + spec.quadratic * n * n

    for neg, i, start in rest:
        n, passed = -neg, []
        while cap - used[roomy[0][1]] != -roomy[0][0]:  # out of date
            s = roomy[0][1]
            heapq.heapreplace(roomy, (used[s] - cap, s))
        if n > -roomy[0][0]:
            left.append((i, start, n))
            continue
        while used[heap[0][1]] + n > cap:
            passed.append(heapq.heappop(heap))
        s = heap[0][1]
        put(i, start, n, s)
        heapq.heapreplace(heap, (cost[s], s))
        for item in passed:
            if used[item[1]] < cap:
                heapq.heappush(heap, item)
    room = sorted((s for s in range(bins) if used[s] < cap), key=lambda s: (used[s], s))
    at = 0
    for i, start, n in left:
        while n:
            s = room[at]
            take = min(n, cap - used[s])
            put(i, start, take, s)
            start, n = start + take, n - take
            at += used[s] == cap
    return pieces


#: ASCII punctuation but for "<" and "'", which can begin a special token or join letters.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


class PartIds(dict):
    """Part of a text between white space -> its ids, little-endian unsigned 32-bit; parts are learned when first met.

    The vocabulary splits letters from punctuation and lower-cases, so the ids of a part
    that is letters and punctuation after them are those of either. Plain letters go
    straight to the merges, in the byte alphabet; all other parts through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.model._resize_cache(0)  # this dict is the cache
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        stem = text.rstrip(TAIL)
        if stem.isalpha() and max(stem) < "\u0130" and self.model.end_of_word_suffix:  # below: composed, and lower case one to one
            low = stem.lower()
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
            if len(stem) < len(text):
                tail = text[len(stem) :].encode()
                ids += self.get(tail) or self.setdefault(tail, self.whole(tail.decode()))
        else:
            ids = self.whole(text)
        self[part] = ids
        return ids


def encoder(spec: PackSpec):
    """text bytes -> ids with the end id. The parts learned stay with the worker and are forgotten when there are `cache_words`."""
    cache = worker_cache("packing")
    if cache.get("path") != spec.tokenizer:
        cache.update(path=spec.tokenizer, parts=PartIds(spec.tokenizer))
    parts = cache["parts"]
    end = b"" if spec.end_id is None else spec.end_id.to_bytes(4, "little")

    def encode(texts: list[bytes]) -> list[bytes]:
        if len(parts) > spec.cache_words:
            parts.clear()
        get = parts.__getitem__
        return [b"".join(map(get, t.split())) + end for t in texts]

    return encode


def pack(docs: DataFrame, spec: PackSpec, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of PIECES, and with `with_ids` its ids as binary.

    Null or empty text: one piece with the end id (none if there is no end id and no
    token). Null doc_id stays null. Repeated rows are packed once each. An empty
    table gives no rows. Other columns, of whatever name, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, where = encoder(spec), TaskContext.get().partitionId()
        chunk: list[tuple[object, bytes]] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, held, number
            lengths = np.array([len(x) // 4 for _, x in chunk], np.int64)
            pieces = assign(lengths, spec)
            base = (where << 32) + (number << 16)
            full = base + (1 << 16)
            costs: dict[int, float] = {}
            for _, _, n, s, _ in pieces:
                costs[s] = costs.get(s, 0.0) + spec.linear * n + spec.quadratic * n * n
            cut = [chunk[i][1][4 * a : 4 * (a + n)] for i, a, n, _, _ in pieces]
            cols = [
                pa.array([chunk[p[0]][0] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                pa.array([int(lengths[p[0]]) for p in pieces], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([costs[p[3]] for p in pieces], pa.float64()),
            ]
            most = max((p[3] for p in pieces), default=-1)
            number += max(1, -(-(most + 1) // (1 << 16)))  # an id block of 65536 for each chunk, more for a giant one
            assert base + most < full + (number << 16)
            chunk, held = [], 0
            names = [x.split()[0] for x in PIECES.split(",")]
            if with_ids:
                cols, names = [*cols, pa.array(cut, pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = utf8(batch.column(1))
            raw = memoryview(data)
            for lo in range(0, len(ids), 256):
                hi = min(lo + 256, len(ids))
                for key, enc in zip(ids[lo:hi], encode([bytes(raw[off[i] : off[i + 1]]) for i in range(lo, hi)]), strict=True):
                    chunk.append((key, enc))
                    held += len(enc) // 4
                    if held >= spec.chunk_tokens:
                        yield flush()
        if chunk:
            yield flush()

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
