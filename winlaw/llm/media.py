"""Media columns: payloads kept as lossless WebP images, and what is read back from them.

A payload is a multiple of 64 bytes; four of its bytes are a pixel's R, G, B, A. Rows have 16
pixels, or the multiple of 16 that makes the image about four times as wide as high; pixels
beyond the payload are zero, and its length is kept beside the image. A payload has at most
2^30 bytes, the format's 16384 pixels a side.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vp8l
from .common import utf8

BLOCK = 64
BANDS = 8


def to_image(payload: np.ndarray) -> np.ndarray:
    rows = len(payload) // BLOCK
    wide = min(max(1, round((rows / 4) ** 0.5)), 1024)
    height = -(-rows // wide)
    full = np.zeros(height * wide * BLOCK, np.uint8)
    full[: len(payload)] = payload
    return full.reshape(height, 16 * wide, 4)


def _by_block(x: np.ndarray, step: int) -> np.ndarray:
    """Sums of x (height, width, ...) over blocks of 2^step pixels a side."""
    x = np.add.reduceat(x, np.arange(0, x.shape[0], 1 << step), 0)
    return np.add.reduceat(x, np.arange(0, x.shape[1], 1 << step), 1)


def _predictor(image: np.ndarray, step: int) -> np.ndarray:
    """Of the predictions from the row above, that of the least residuals in each block."""
    h, w = image.shape[:2]
    ways = vp8l.FROM_ABOVE[1:]
    cost = np.zeros((len(ways), h, w), np.int64)
    if h > 1 and w > 1:
        wide = image.astype(np.int16)
        near = vp8l._neighbours(wide)
        for i, m in enumerate(ways):
            cost[i, 1:, 1:] = np.abs(vp8l._signed(wide[1:, 1:] - vp8l.PREDICTIONS[m](*near))).sum(-1)
    return np.array(ways, np.uint8)[np.stack([_by_block(c, step) for c in cost]).argmin(0)]


def _factors(image: np.ndarray, step: int) -> np.ndarray:
    """Cross-colour factors of each block by least squares, in 32nds: green to red, then green and red to blue."""
    if max(image.shape[:2]) <= 1 << step:  # one block: whole numbers far below 2^53
        own = image.reshape(-1, 4)[:, :3].T.astype(np.int8, order="C").astype(np.float64)
        ((rr, rg, rb), (_, gg, gb), _) = (own @ own.T).astype(np.int64).reshape(3, 3, 1, 1)
    else:
        r, g, b = (vp8l._signed(image[..., c]).astype(np.int64) for c in range(3))
        gg, rr, rg, gb, rb = np.moveaxis(_by_block(np.stack([g * g, r * r, r * g, g * b, r * b], -1), step), -1, 0)
    slope = lambda x, y: np.clip(np.rint(32 * x / np.maximum(y, 1)), -128, 127).astype(np.int8).view(np.uint8)
    out = np.zeros((*gg.shape, 4), np.uint8)
    out[..., 2], out[..., 1], out[..., 0], out[..., 3] = slope(rg, gg), slope(gb, gg), slope(rb, 2 * rr), 255
    return out


STEP = 6
CACHE_BITS = 6


def plan(image: np.ndarray, payload: np.ndarray) -> dict:
    """How an image is stored. A checksum of the payload decides which means it is stored by, so that a column has files of every
    kind, as one of many writers has: references, with a palette where the image has at most 256 colours and cross-colour where
    it has more; cross-colour and a colour cache; or a predictor. All have prefix codes."""
    kind = zlib.crc32(payload) % 3
    if kind == 0:
        if len(np.unique(image.view(np.uint32))) <= 256:
            return {"references": True, "palette": True}
        return {"references": True, "step": STEP, "cross": _factors(image, STEP)}
    if kind == 1:
        return {"step": STEP, "cross": _factors(image, STEP), "cache_bits": CACHE_BITS}
    return {"step": STEP, "predictor": _predictor(image, STEP)}


def padded(raw: np.ndarray) -> np.ndarray:
    """raw and zeros up to the next positive multiple of 64."""
    out = np.zeros(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), np.uint8)
    out[: len(raw)] = raw
    return out


def features(image: np.ndarray) -> str:
    """Size, mean of each channel, and the mean of each channel in 8 bands of columns, in hex."""
    h, w = image.shape[:2]
    sums = image.sum(0, dtype=np.int64).reshape(BANDS, -1, 4).sum(1)
    return f"{w}x{h}:{bytes((sums.sum(0) // (h * w)).astype(np.uint8)).hex()}:{bytes((sums * BANDS // (h * w)).astype(np.uint8).ravel()).hex()}"


#: Documents that are stored together, at most: so many, or of so many bytes (or a single one). Their prefix codes are made and read at once.
GROUP, GROUP_BYTES = 512, 1 << 21


def groups(off: np.ndarray) -> Iterator[range]:
    """Rows of a batch, whose texts begin and end at `off`, in groups."""
    at = 0
    while at < len(off) - 1:
        stop = int(np.searchsorted(off, off[at] + GROUP_BYTES, side="right")) - 1
        stop = min(max(stop, at + 1), at + GROUP, len(off) - 1)
        yield range(at, stop)
        at = stop


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """SCHEMA of every row, and with `with_media` the files: text as UTF-8 -> payload -> file -> pixels read back from the file's bytes.

    Null or empty text: a payload of 64 zeros. Equal texts get equal values; repeated rows
    stay; an empty table gives no rows; other columns are not read. A group of texts at a time is in memory, its pixels as arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            data, off = utf8(batch.column(1))
            rows, files = [], []
            for group in groups(off):
                payloads = [padded(data[off[i] : off[i + 1]]) for i in group]
                images = [to_image(x) for x in payloads]
                made = vp8l.encode_all(images, [plan(x, y) for x, y in zip(images, payloads, strict=True)])
                for i, payload, file, image in zip(group, payloads, made, vp8l.decode_all(made), strict=True):
                    back = np.ascontiguousarray(image).ravel()[: len(payload)]
                    rows.append((int(off[i + 1] - off[i]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), features(image)))
                if with_media:
                    files += made
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))] if rows else [batch.column(0), *(pa.array([], k) for k in kinds)]
            if with_media:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(files, pa.binary())], names=[*names, "media"])
            else:
                yield pa.RecordBatch.from_arrays(cols, names=names)

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SCHEMA + (", media binary" if with_media else ""))


def pixels(media: DataFrame, column: str = "media") -> DataFrame:
    """media with height, width and pixels (R, G, B, A bytes) of the WebP files in `column`; null or damaged files give nulls."""
    rest = media.drop("height", "width", "pixels")
    at = rest.columns.index(column)
    out = T.StructType([*rest.schema.fields, *T._parse_datatype_string("height int, width int, pixels binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for raw in batch.column(at).to_pylist():
                try:
                    image = vp8l.decode(raw or b"")
                    got.append((*image.shape[:2], image.tobytes()))
                except (vp8l.FormatError, IndexError, TypeError):
                    got.append((None, None, None))
            h, w, p = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(p, pa.binary())], names=[*batch.schema.names, "height", "width", "pixels"])

    return rest.mapInArrow(run, out)
