import hashlib
import heapq
import zlib

import numpy as np
import pytest

from winlaw.llm import media, vp8l


def image(h, w, seed=0, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        palette = rng.integers(0, 256, (colours, 4), np.uint8)
        return palette[rng.integers(0, colours, (h, w))]
    out = rng.integers(0, 256, (h, w, 4), np.uint8)
    out[h // 2 :] = out[: h - h // 2]  # something to refer back to
    return out


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 70000, 64 * (1 << 14) + 5])
def test_payload_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256 if n % 2 else 20, n).astype(np.uint8)
    payload = media.padded(raw)
    back = vp8l.decode(vp8l.encode(px := media.to_image(payload), **media.plan(px, payload))).ravel()[: len(payload)]
    assert len(payload) % 64 == 0 and len(payload) >= 64
    assert (back == payload).all() and (back[: len(raw)] == raw).all() and not back[len(raw) :].any()


@pytest.mark.parametrize("colours", [1, 2, 3, 5, 17, 200])
def test_uniform_codes_of_every_length(colours):
    px = np.random.default_rng(colours).integers(0, colours, (9, 16, 4)).astype(np.uint8)
    assert (vp8l.decode(vp8l.encode(px)) == px).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 17, 256])
def test_palette(colours):
    px = image(11, 13, colours, colours)
    assert (vp8l.decode(vp8l.encode(px, palette=True)) == px).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    px = image(9, 10, mode)
    modes = np.full((3, 3), mode, np.uint8)
    assert (vp8l.decode(vp8l.encode(px, predictor=modes)) == px).all()


def test_prediction_values():
    f = vp8l.PREDICTIONS
    left, top, right, corner = (np.array([v] * 4) for v in (10, 20, 31, 4))
    assert [int(p(left, top, right, corner)[0]) for p in f] == [0, 10, 20, 31, 4, 20, 7, 15, 12, 25, 16, 20, 26, 20]


@pytest.mark.parametrize("kw", [
    {"references": True},
    {"cache_bits": 4},
    {"cache_bits": 10, "references": True},
    {"group_step": 2},
    {"subtract_green": True},
    {"cross": True},
    {"cross": True, "predictor": True, "subtract_green": True, "references": True, "cache_bits": 6, "group_step": 3},
    {"palette": True, "references": True, "predictor": True},
])
def test_everything_else(kw):
    px = image(17, 22, 3, 40 if "cache_bits" in kw or "palette" in kw else None)
    rng = np.random.default_rng(1)
    kw = dict(kw)
    if kw.pop("cross", None):
        kw["cross"] = rng.integers(0, 256, (5, 6, 4), np.uint8)
    if kw.pop("predictor", None):
        kw["predictor"] = rng.integers(0, 14, (5, 6), np.uint8)
    assert (vp8l.decode(vp8l.encode(px, **kw)) == px).all()


def test_near_distances():
    assert len(vp8l.NEAR) == 120
    assert vp8l.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert vp8l.NEAR[-1] == (8, 7)


def test_known_file():
    """A 1x1 opaque red pixel, bit by bit: five codes of one symbol each."""
    out = vp8l.BitWriter()
    for v, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        out.put(v, n)
    for symbol in (0, 255, 0, 255, 0):  # green, red, blue, alpha, distance
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.put(v, n)
    assert vp8l.decode(vp8l._file(out.to_bytes())).tolist() == [[[255, 0, 0, 255]]]


def test_damage_is_reported():
    good = vp8l.encode(image(4, 16))
    for bad in (b"", good[:20], b"XXXX" + good[4:]):
        with pytest.raises(vp8l.FormatError):
            vp8l.decode(bad)


def test_store(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 5000), (1, "hello"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS feature", "2 AS n_bytes")
    got = media.store(docs, with_media=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {1: "hello", 2: "", 3: "", 4: "é" * 5000, None: "x"}[r["doc_id"]].encode()
        want = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-64:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert len({r["feature"] for r in got if r["doc_id"] == 1}) == 1
    assert media.store(docs.limit(0)).count() == 0
    px = media.pixels(media.store(docs, with_media=True).select("doc_id", "media")).collect()
    assert all(r["height"] * r["width"] * 4 == len(r["pixels"]) for r in px)
    assert media.pixels(spark.createDataFrame([(b"junk",), (None,)], "media binary")).filter("pixels IS NULL").count() == 2


# The alpha plane, 16 x 16, of a small logo that a common WebP library wrote: a stream without a file's head, values in green.
FOREIGN = """
27a2a89124e57ae7185fe7df2a998898ff74718de02630e2e18b7732c8c1115c832b30e8b078158e785135c1080c024f92a06ab055191cd6b66d462f4ec6763c
b6ed77fbaf29ae21a2ff49d1fd8f90f7ba4449241b3a259134f3146d0ec7d3e51620f40b14be90e183b71a329e36827f1d297e4e7608fb889eb391ef997346e8
3282dbf8cc48b2f745307d20fd36178c2132562da5d66b23bc5de3a55915d59c81a4d96e96758a18310f8aaa2c5034fa3082dfba6b505229b52dcfe954140a010000
"""


def test_a_stream_of_another_library():
    px = vp8l.read_stream(vp8l.Bits(bytes.fromhex(FOREIGN)), 16, 16)[..., 1].astype(int)
    assert px[0].tolist() == [0, 0, 0, 0, 175, 237, 255, 255, 255, 247, 146, 11, 3, 0, 0, 0]
    assert px[8].tolist() == [247, 255, 255, 170, 78, 166, 247, 255, 255, 255, 255, 255, 255, 255, 247, 71]
    assert px[15].tolist() == [0, 0, 0, 0, 8, 29, 53, 66, 71, 69, 56, 31, 8, 0, 0, 0]


def _code(rng, symbols):
    """Random lengths of a complete code: {symbol: (bits as text, first bit first)}."""
    parts = [""]
    while len(parts) < len(symbols):
        i = int(rng.integers(len(parts)))
        if len(parts[i]) < 12:
            parts[i : i + 1] = [parts[i] + "0", parts[i] + "1"]
    lengths = {s: len(p) for s, p in zip(rng.permutation(symbols).tolist(), parts, strict=True)}
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code, last = code << (n - last), n
        out[s] = f"{code:0{n}b}"
        code += 1
    return out


def _written(rng, code, size):
    """A code in its long form, with lengths of 4 bits each, zeros in runs of up to 10 and repeats by symbol 16 here and there."""
    own = {s: f"{i:04b}"[: 4] for i, s in enumerate([*range(13), 16, 17])}
    lengths = {s: 4 for s in own}
    lengths[17] = 3  # fifteen codes of 4 bits leave room for one of 3
    own, at, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        at, last = at << (n - last), n
        own[s] = f"{at:0{n}b}"
        at += 1
    low = lambda v, n: f"{v:0{n}b}"[::-1] if n else ""
    out = "0" + low(15, 4) + "".join(low(lengths.get(s, 0), 3) for s in vp8l.CODE_LENGTH_ORDER) + "0"
    s, before = 0, 8
    while s < size:
        v = len(code[s]) if s in code else 0
        run = 1
        while s + run < size and run < 10 and (len(code[s + run]) if s + run in code else 0) == v:
            run += 1
        if not v and run >= 3:
            out += own[17] + low(run - 3, 3)
            s += run
        elif v == before and run >= 3 and rng.integers(2):
            run = min(run, 6)
            out += own[16] + low(run - 3, 2)
            s += run
        else:
            out += own[v]
            before = v or before
            s += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_files_of_another_writer(seed):
    """Random items with random codes, written bit by bit, and what they mean by the format's own words."""
    rng = np.random.default_rng(seed)
    w, h, cache_bits = int(rng.integers(3, 60)), int(rng.integers(2, 40)), int(rng.integers(0, 5))
    low = lambda v, n: f"{v:0{n}b}"[::-1] if n else ""
    literals = sorted({int(x) for x in rng.integers(0, 256, 30)})
    slots = [280 + i for i in range(1 << cache_bits)] if cache_bits else []
    green = _code(rng, [*literals, *range(256, 256 + 14), *slots])
    others = [_code(rng, literals) for _ in range(3)]
    distance = _code(rng, list(range(14)))
    value = lambda s, x: (s if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + x) + 1
    bits = low(0x2F, 8) + low(w - 1, 14) + low(h - 1, 14) + "1" + "000" + "0"
    bits += ("1" + low(cache_bits, 4) if cache_bits else "0") + "0"
    bits += _written(rng, green, 280 + len(slots))
    for c in others:
        bits += _written(rng, c, 256)
    bits += _written(rng, distance, 40)
    px, cache = [], {}
    while len(px) < w * h:
        kind = rng.integers(4)
        new = []
        if kind == 0 and px:
            s, d = int(rng.integers(14)), int(rng.integers(14))
            sx, dx = (int(rng.integers(1 << max(0, (v - 2) >> 1))) for v in (s, d))
            n, far = value(s, sx), value(d, dx)
            far = far - 120 if far > 120 else max(1, vp8l.NEAR[far - 1][0] + vp8l.NEAR[far - 1][1] * w)
            if far > len(px) or len(px) + n > w * h:
                continue
            bits += green[256 + s] + low(sx, max(0, (s - 2) >> 1)) + distance[d] + low(dx, max(0, (d - 2) >> 1))
            for _ in range(n):
                px.append(px[-far])
                new.append(px[-1])
        elif kind == 1 and slots:
            c = int(rng.integers(len(slots)))
            bits += green[280 + c]
            new = [cache.get(c, (0, 0, 0, 0))]
            px += new
        else:
            g, r, b, a = (literals[int(rng.integers(len(literals)))] for _ in range(4))
            bits += green[g] + others[0][r] + others[1][b] + others[2][a]
            new = [(r, g, b, a)]
            px += new
        for r, g, b, a in new:
            if cache_bits:
                cache[((a << 24 | r << 16 | g << 8 | b) * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = (r, g, b, a)
    bits += "0" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert vp8l.decode(vp8l._file(body)).reshape(-1, 4).tolist() == [list(p) for p in px]


def test_stretches_are_joined(monkeypatch):
    """An image read in many short stretches, and item by item."""
    px = image(40, 50, 3, 40)
    file = vp8l.encode(px, references=True, cache_bits=5)
    monkeypatch.setattr(vp8l, "STRETCH", 128)
    assert (vp8l.decode(file) == px).all()
    monkeypatch.setattr(vp8l, "SMALL", 1 << 30)
    assert (vp8l.decode(file) == px).all()


def test_every_kind_of_plan_occurs():
    kinds = set()
    for i in range(60):
        payload = media.padded(np.frombuffer(f"{i} some text of a document ".encode() * (1 + 20 * (i % 7)), np.uint8))
        px = media.to_image(payload)
        plan = media.plan(px, payload)
        kinds |= set(plan)
        assert (vp8l.decode(vp8l.encode(px, **plan)) == px).all()
    assert {"references", "palette", "cross", "cache_bits", "predictor"} <= kinds


def _plain_lengths(counts, most=15):
    """Huffman lengths by a heap; leaves come before joined nodes of the same weight, each kind as it came."""
    own = [max(int(x), 0) for x in counts]
    while True:
        heap = [(w, 0, r, [s]) for r, (w, s) in enumerate(sorted((w, s) for s, w in enumerate(own)))]
        heapq.heapify(heap)
        depth, made = [0] * len(own), 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[3] + b[3]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], 1, made, a[3] + b[3]))
            made += 1
        if max(depth) <= most:
            return depth
        top = max(own)
        own = [(x >> 1) + 1 + (top >> most) for x in own]


def test_codes_of_many_are_those_of_each():
    """Trees joined together, some too deep, some of two symbols, are those that each has alone."""
    rng = np.random.default_rng(5)
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    some = [np.array(fib), np.array([7, 7]), np.ones(256, np.int64), np.array(fib[::-1][:22]), np.array([0, 5]), *(rng.integers(1, 60, k) for k in (3, 40, 255, 300))]
    n = np.array([len(x) for x in some])
    got = np.split(vp8l.code_lengths(np.concatenate(some), n), n.cumsum()[:-1])
    for own, counts in zip(got, some, strict=True):
        assert own.tolist() == _plain_lengths(counts)
        assert sum(2.0 ** -own) == 1 and own.max() <= 15


def test_files_made_together_are_those_of_each():
    """A group of images of every kind, of one pixel, of one colour, of a symbol beyond the short form and of a wide alphabet."""
    images, how = [], []
    for i in range(40):
        payload = media.padded(np.frombuffer(f"{i} some text of a document ".encode() * (1 + 9 * (i % 7)), np.uint8))
        images.append(media.to_image(payload))
        how.append(media.plan(images[-1], payload))
    run = np.zeros((3, 700, 4), np.uint8)
    run[0, 1] = 9
    images += [image(1, 1, 1), np.full((5, 5, 4), 7, np.uint8), run, image(60, 70, 4, 1500), image(9, 9, 2)]
    how += [{}, {"cache_bits": 3}, {"references": True}, {"cache_bits": 11, "references": True}, {"group_step": 2, "predictor": np.zeros((3, 3), np.uint8)}]
    files = vp8l.encode_all(images, how)
    assert files == [vp8l.encode(x, **k) for x, k in zip(images, how, strict=True)]
    for px, back in zip(images, vp8l.decode_all(files), strict=True):
        assert (back == px).all()
    with pytest.raises(vp8l.FormatError):
        vp8l.decode_all([files[0], files[1][:30], files[2]])


def test_code_making_does_not_grow_with_the_files(monkeypatch):
    """Codes of a group are made, and their tables built, in a round for all: one by one they took most of a small file's time."""
    rounds = {"made_codes": 0, "prefix_codes": 0, "packed": 0}
    for name in rounds:
        def counted(*a, name=name, own=getattr(vp8l, name)):
            rounds[name] += 1
            return own(*a)
        monkeypatch.setattr(vp8l, name, counted)
    images = [image(8, 16, i) for i in range(50)]
    back = vp8l.decode_all(vp8l.encode_all(images, [{"references": True}] * 50))
    assert all((a == b).all() for a, b in zip(images, back, strict=True))
    assert rounds["made_codes"] == 1 and rounds["packed"] == 1 and rounds["prefix_codes"] <= 2


def test_groups_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(media, "GROUP_BYTES", 100)
    monkeypatch.setattr(media, "GROUP", 4)
    off = np.array([7, 7, 7, 7, 7, 7, 60, 300, 300, 350, 390, 391])
    got = list(media.groups(off))
    assert [i for g in got for i in g] == list(range(11))
    assert all(len(g) <= 4 and (len(g) == 1 or off[g.stop] - off[g.start] <= 100) for g in got)
    assert list(media.groups(np.array([0]))) == [] and list(media.groups(np.array([3, 3]))) == [range(0, 1)]
