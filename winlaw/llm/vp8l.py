"""Lossless WebP: a decoder of the whole format, and an encoder.

The format's pixels are kept as arrays (height, width, 4) of R, G, B, A bytes. The decoder
reads prefix codes (one group or several), back-references and the colour cache, and inverts
the predictor, cross-colour, subtract-green and palette transforms.

Where an image has one group of codes, what begins at a bit (a pixel, a reference or an entry
of the cache) and where the next one begins depend on that bit alone. So they are looked up
for all bits of a stretch at once, and only the chain of beginnings is walked. References
and cache entries then are pointers to earlier pixels, which are followed for all pixels at
once: a cache entry points to the last pixel before it with the same hash, and hashes follow
references. Images of several groups, and very small ones, are read item by item.

encode() takes any of the transforms, references, the cache and groups of codes, and works on
whole arrays too.

Small files cost most by their prefix codes, so those of many files are made and read together:
a file is written, and read, by a generator that asks for codes, and encode_all() and
decode_all() answer all that ask at once.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
#: The near distances: offsets within 8 columns and 7 rows that come before a pixel, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
#: The farthest that a reference's 18 extra bits reach, beyond the near distances.
FARTHEST = (1 << 20) - len(NEAR)
#: Bits that are looked up at once.
STRETCH = 1 << 17
#: Images of fewer pixels are read item by item.
SMALL = 12


class FormatError(ValueError):
    pass


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return (int.from_bytes(self.data[a : a + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise FormatError("the data end too soon")
        return v


class BitWriter:
    """Collects values, lowest bit first, of up to 63 bits each; packed() makes bytes of them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.few: list[tuple[int, int]] = []  # behind the parts

    def put(self, v: int, n: int) -> None:
        self.few.append((v, n))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flush()
        self.parts.append((values, sizes))

    def flush(self) -> None:
        if self.few:
            few = np.array(self.few, np.int64)
            self.parts.append((few[:, 0], few[:, 1]))
            self.few = []

    def to_bytes(self) -> bytes:
        return packed([self])[0]


def packed(writers: list[BitWriter]) -> list[bytes]:
    """The bytes of each of the writers, which hold something."""
    for w in writers:
        w.flush()
    values = np.concatenate([v for w in writers for v, _ in w.parts]).view(np.uint64)
    sizes = np.concatenate([n for w in writers for _, n in w.parts])
    count = np.array([sum(len(v) for v, _ in w.parts) for w in writers])
    end = sizes.cumsum()
    stop = end[count.cumsum() - 1]
    bits = np.diff(stop, prepend=0)
    words = (bits + 63) >> 6
    begin = words.cumsum() - words  # each begins with a word of its own
    at = end - sizes + ((begin << 6) - (stop - bits)).repeat(count)
    word, shift = at >> 6, (at & 63).view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(words.sum()) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    spill = np.where(shift > 0, values >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    out[word[first] + 1] |= np.bitwise_or.reduceat(spill, first)
    raw = out.astype("<u8").tobytes()
    return [raw[8 * b : 8 * b + ((n + 7) >> 3)] for b, n in zip(begin.tolist(), bits.tolist(), strict=True)]


def together(steps: list[Generator], answer: Callable[[list], list]) -> list:
    """The results of generators that yield lists of questions: all that are asked in a round are answered at once."""
    out, live, say = [None] * len(steps), list(range(len(steps))), [None] * len(steps)
    while live:
        asked = {}
        for i in live:
            try:
                asked[i] = steps[i].send(say[i])
            except StopIteration as end:
                out[i] = end.value
        got = iter(answer([x for own in asked.values() for x in own]) if asked else ())
        for i, own in asked.items():
            say[i] = [next(got) for _ in own]
        live = list(asked)
    return out


# ---- prefix codes


@lru_cache(16)
def _reversal(k: int) -> np.ndarray:
    """The numbers below 2^k with their k bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(k):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class PrefixCode:
    """A code of a single symbol (`only`) takes no bits. table: symbol << 4 | length, by the next `most` bits."""

    __slots__ = ("only", "most", "table")

    def __init__(self, only: int | None, most: int, table: np.ndarray):
        self.only, self.most, self.table = only, most, table

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        entry = int(self.table[bits.peek(self.most)])
        bits.read(entry & 15)
        return entry >> 4


@lru_cache(4096)
def _single(symbol: int) -> PrefixCode:
    return PrefixCode(symbol, 0, np.array([symbol << 4], np.int64))


def prefix_codes(lengths: list[bytes]) -> list[PrefixCode]:
    """The codes of such code lengths by symbol, two symbols or more each."""
    if not lengths:
        return []
    flat = np.frombuffer(b"".join(lengths), np.uint8)
    used = flat.nonzero()[0]
    size = np.array([len(x) for x in lengths])
    stop = size.cumsum()
    code = stop.searchsorted(used, side="right")
    first = code.searchsorted(np.arange(len(size)))
    own = flat.take(used).astype(np.int64)
    most = np.maximum.reduceat(own, first)
    order = np.sort(code << 16 | own << 12 | (used - (stop - size).take(code)))  # by length, then symbol
    own = order >> 12 & 15
    span = 1 << (most.take(code) - own)
    if (np.add.reduceat(span, first) != 1 << most).any():
        raise FormatError("a code isn't complete")
    table = ((order & 4095) << 4 | own).repeat(span)
    out, at = [], 0
    for k in most.tolist():
        out.append(PrefixCode(None, k, table[at : at + (1 << k)].take(_reversal(k))))
        at += 1 << k
    return out


#: Bits of code lengths that are looked up at once, and how many values of them are kept.
AHEAD, KNOWN = 16, 1 << 15


@lru_cache(8)
def _code_of_lengths(x: int) -> tuple[list[int], dict[int, tuple[int, bytes, int]]]:
    """The table of a code of code lengths, whose own lengths are 3 bits each; and what is known of _ahead()."""
    own = bytearray(len(CODE_LENGTH_ORDER))
    for i, s in enumerate(CODE_LENGTH_ORDER):
        own[s] = x >> 3 * i & 7
    used = [s for s, n in enumerate(own) if n]
    if not used:
        raise FormatError("a code without symbols")
    return (_single(used[0]) if len(used) == 1 else prefix_codes([bytes(own)])[0]).table.tolist(), {}


def _ahead(table: list[int], x: int) -> tuple[int, bytes, int]:
    """What AHEAD bits of code lengths say: how many bits are taken, the lengths, and how many; up to a repeat, which depends on what was before."""
    used, out, mask = 0, b"", len(table) - 1
    while True:
        entry = table[x >> used & mask]
        s, n = entry >> 4, entry & 15
        extra = (2, 3, 7)[s - 16] if s >= 16 else 0
        if s == 16 or not n or used + n + extra > AHEAD:
            return used, out, len(out)
        used += n
        out += bytes((s,)) if s < 16 else bytes((3 if s == 17 else 11) + (x >> used & ((1 << extra) - 1)))
        used += extra


def _read_lengths(bits: Bits, size: int) -> int | bytes:
    """The code lengths by symbol that the data state; of a code of a single symbol that symbol."""
    a, begin = bits.at >> 3, bits.at & 7
    x = int.from_bytes(bits.data[a : a + 4], "little") >> begin
    if x & 1:
        wide = 8 if x & 4 else 1
        symbol, used = (x >> 3) & ((1 << wide) - 1), 3 + wide
        other = symbol
        if x & 2:
            other = (x >> used) & 255
            used += 8
        if max(symbol, other) >= size:
            raise FormatError("a symbol beyond the alphabet")
        bits.at += used
        if bits.at > 8 * len(bits.data):
            raise FormatError("the data end too soon")
        if symbol == other:
            return symbol
        out = bytearray(size)
        out[symbol] = out[other] = 1
        return bytes(out)
    x = int.from_bytes(bits.data[a : a + 16], "little") >> begin
    n = 4 + (x >> 1 & 15)
    used = 5 + 3 * n
    table, known = _code_of_lengths(x >> 5 & ((1 << 3 * n) - 1))
    x >>= used
    left = size
    if x & 1:
        n = 2 + 2 * (x >> 1 & 7)
        left = 2 + (x >> 4 & ((1 << n) - 1))
        x >>= 4 + n
        used += 4 + n
    else:
        x >>= 1
        used += 1
    at, out, got = bits.at + used, bytearray(), 0
    if left >= size:
        low, ends = (1 << AHEAD) - 1, 8 * len(bits.data)
        n = 1
        while n and at < ends:
            x = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 64], "little") >> (at & 7)
            stop = at + 400
            while at < stop:
                piece = known.get(x & low)
                if piece is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    piece = known[x & low] = _ahead(table, x & low)
                n, some, more = piece
                if not n or got + more > size:
                    n = 0
                    break
                x >>= n
                at += n
                got += more
                out += some
    x = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 14 * size // 8 + 16], "little") >> (at & 7)  # a length takes 14 bits at most
    mask, last = len(table) - 1, next((s for s in reversed(out) if s), 8)
    while len(out) < size and left:
        left -= 1
        entry = table[x & mask]
        s, n = entry >> 4, entry & 15
        x >>= n
        at += n
        if s < 16:
            last = s or last
            out.append(s)
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        run = least + (x & ((1 << extra) - 1))
        x >>= extra
        at += extra
        if len(out) + run > size:
            raise FormatError("lengths beyond the alphabet")
        out += bytes((last if s == 16 else 0,)) * run
    if at > 8 * len(bits.data):
        raise FormatError("the data end too soon")
    bits.at = at
    out += bytes(size - len(out))
    zeros = out.count(0)
    if zeros >= size - 1:
        if zeros == size:
            raise FormatError("a code without symbols")
        return size - len(out.lstrip(b"\0"))
    return bytes(out)


def _extra(symbol: int, bits: Bits) -> int:
    """The value, from 1, of a length or distance symbol and its extra bits."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _extra_bits(symbol: np.ndarray) -> np.ndarray:
    return np.maximum((symbol - 2) >> 1, 0)


def _extras(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _extra() of many symbols and the bits that follow each: values, and numbers of bits taken."""
    n = _extra_bits(symbol)
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << n) + (window & ((1 << n) - 1))) + 1, n


def _extras_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra bits' values and numbers of lengths or distances."""
    v = value - 1
    n = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 2, 0)
    return np.where(v < 4, v, 2 * n + 2 + ((v >> n) & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), np.where(v < 4, 0, n)


@lru_cache(64)
def _near(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances in pixels of the near codes; and by distance the code, 0 for those without one."""
    near = np.array([max(1, x + y * width) for x, y in NEAR])
    back = np.zeros(8 * width + 9, np.int64)
    back[near[::-1]] = np.arange(len(NEAR), 0, -1)
    return near, back


def _distances(codes: np.ndarray, width: int) -> np.ndarray:
    near, _ = _near(width)
    return np.where(codes > len(NEAR), codes - len(NEAR), near[np.minimum(codes, len(NEAR)) - 1])


# ---- entropy-coded images


def _pack(rgba: np.ndarray) -> np.ndarray:
    x = rgba.astype(np.uint32)
    return (x[..., 3] << 24) | (x[..., 0] << 16) | (x[..., 1] << 8) | x[..., 2]


def _unpack(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(*argb.shape, 4)[..., [2, 1, 0, 3]]


def _read_image(bits: Bits, width: int, height: int, main: bool) -> Generator[list[bytes], list[PrefixCode], np.ndarray]:
    """(height, width, 4) of an entropy-coded image; only the main one can have several groups of codes. Asks for prefix_codes()."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise FormatError("a colour cache too large")
    groups, which, step = 1, None, 0
    if main and bits.read(1):
        step = bits.read(3) + 2
        meta = yield from _read_image(bits, (width + (1 << step) - 1) >> step, (height + (1 << step) - 1) >> step, False)
        which = (meta[..., 0].astype(np.int64) << 8) | meta[..., 1]
        groups = int(which.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    own = [_read_lengths(bits, n) for _ in range(groups) for n in sizes]
    if groups == 1 and all(isinstance(x, int) for x in own[:4]) and own[0] < 256:
        green, red, blue, alpha = own[:4]
        return np.broadcast_to(np.array([red, green, blue, alpha], np.uint8), (height, width, 4)).copy()
    asked = [x for x in own if not isinstance(x, int)]
    made = iter((yield asked) if asked else ())
    flat = [_single(x) if isinstance(x, int) else next(made) for x in own]
    codes = [flat[i : i + 5] for i in range(0, len(flat), 5)]
    if groups == 1 and width * height >= SMALL:
        px = _read_stretches(bits, width, width * height, codes[0], cache_bits)
    else:
        px = _read_items(bits, width, width * height, codes, cache_bits, which, step)
    return _unpack(px.reshape(height, width))


def _read_items(bits: Bits, width: int, total: int, codes: list[list[PrefixCode]], cache_bits: int, which: np.ndarray | None, step: int) -> np.ndarray:
    out, at = [0] * total, 0
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    fresh = 0  # from here on pixels aren't yet in the cache
    while at < total:
        y, x = divmod(at, width)
        green, red, blue, alpha, distance = codes[which[y >> step, x >> step]] if which is not None else codes[0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = (a << 24) | (r << 16) | (s << 8) | b
            at += 1
        elif s < 256 + LENGTH_CODES:
            n = _extra(s - 256, bits)
            d = int(_distances(np.array([_extra(distance.read(bits), bits)]), width)[0])
            if d > at or at + n > total:
                raise FormatError("a reference beyond the image")
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            while fresh < at:
                p = out[fresh]
                cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = p
                fresh += 1
            out[at] = cache[s - 256 - LENGTH_CODES]
            at += 1
    return np.array(out, np.uint32)


def _walk(after: np.ndarray, p: int, stop: int, most: int) -> np.ndarray:
    """p, after[p], after[after[p]] ... while below stop, `most` of them at most; four at a time."""
    twice = after.take(after, mode="clip")
    step, chain = memoryview(twice.take(twice, mode="clip")), []
    add, left = chain.append, most
    while p < stop and left > 0:
        add(p)
        p = step[p]
        left -= 4
    first = np.array(chain, np.int64)
    second = after.take(first)
    third = after.take(second, mode="clip")
    own = np.stack([first, second, third, after.take(third, mode="clip")], 1).ravel()
    return own[: min(int(own.searchsorted(stop)) if len(own) and own[-1] >= stop else len(own), most)]


def _read_stretches(bits: Bits, width: int, total: int, codes: list[PrefixCode], cache_bits: int) -> np.ndarray:
    """The pixels of an image of one group, a stretch of bits after another."""
    green, red, blue, alpha, distance = codes
    parts, done = [], 0
    raw = np.frombuffer(bits.data, np.uint8)
    base = bits.at
    mask = [len(c.table) - 1 for c in codes]
    sizes = [c.table & 15 for c in codes]
    symbol = green.table >> 4
    is_ref = (symbol >= 256) & (symbol < 256 + LENGTH_CODES)
    literal, refs = symbol < 256, bool(is_ref.any())
    if refs:  # with the extra bits
        sizes[0] += np.where(is_ref, _extra_bits(symbol - 256), 0)
        sizes[4] += _extra_bits(distance.table >> 4)
    while done < total:
        if base >= 8 * len(raw):
            raise FormatError("the data end too soon")
        a, size = base >> 3, min(STRETCH, 64 * (total - done) + 64)
        some = raw[a : a + (size >> 3) + 32]  # items take 100 bits at most
        size = min(size, 8 * len(some))
        part = np.zeros((size >> 3) + 52, np.uint64)
        part[: len(some)] = some
        five = part[:-4] | part[1:-3] << 8 | part[2:-2] << 16 | part[3:-1] << 24 | part[4:] << 32
        window = (five[:, None] >> np.arange(8, dtype=np.uint64)).ravel().view(np.int64)
        key = window[:size] & mask[0]
        at = np.arange(size) + sizes[0].take(key)
        after = at
        for c in (1, 2, 3):
            if mask[c]:
                after = after + sizes[c].take(window.take(after) & mask[c])
        if after is not at and not literal.all():
            after = np.where(literal.take(key), after, at)
        if refs:
            more = is_ref.take(key).nonzero()[0]
            here = at[more]
            after[more] = here + sizes[4].take(window.take(here) & mask[4])
        own = _walk(after, base & 7, size, total - done)
        entry = green.table.take(key[own])
        kind, value, here = entry >> 4, (entry >> 4) << 8, own + (entry & 15)
        count, back, found = np.ones(len(own), np.int64), None, None
        if refs:
            found = ((kind >= 256) & (kind < 256 + LENGTH_CODES)).nonzero()[0]
            at = here[found]
            count[found], used = _extras(kind[found] - 256, window.take(at))
            stop = int(count.cumsum().searchsorted(total - done)) + 1
        else:
            stop = total - done
        end = int(after[own[-1]]) if stop >= len(own) else int(own[stop])
        if refs:
            if stop < len(own):  # beyond the image
                own, kind, value, here, count = (x[:stop] for x in (own, kind, value, here, count))
                found = found[found < stop]
            at, used = at[: len(found)], used[: len(found)]
            entry = distance.table.take(window.take(at + used) & mask[4])
            codes_, _ = _extras(entry >> 4, window.take(at + used + (entry & 15)))
            back = np.zeros(len(own), np.int64)
            back[found] = _distances(codes_, width)
        for c, shift in ((1, 16), (2, 0), (3, 24)):
            if not mask[c]:
                value |= codes[c].only << shift
                continue
            entry = codes[c].table.take(window.take(here) & mask[c])
            here = here + (entry & 15)
            value |= (entry >> 4) << shift
        parts.append((kind, value.astype(np.uint32), count, np.zeros(len(own), np.int64) if back is None else back))
        done += int(count.sum())
        base = (a << 3) + end
    if done > total or base > 8 * len(raw):
        raise FormatError("a reference beyond the image" if done > total else "the data end too soon")
    bits.at = base
    kind, value, count, back = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
    return _resolve(kind, value, count, back, total, cache_bits)


def _follow(source: np.ndarray) -> np.ndarray:
    """Where chains of pointers to earlier places end; a place that points to itself is an end."""
    while True:
        far = source[source]
        if (far == source).all():
            return source
        source = far


def _in_order(slot: np.ndarray) -> np.ndarray:
    """Places by slot (below 2^32), those of a slot as they come."""
    return np.sort(slot.astype(np.int64) << 31 | np.arange(len(slot))) & 0x7FFFFFFF


def _hashes(px: np.ndarray, cache_bits: int) -> np.ndarray:
    return (px * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)


def _resolve(kind: np.ndarray, value: np.ndarray, n: np.ndarray, back: np.ndarray, total: int, cache_bits: int) -> np.ndarray:
    """Pixels of items: kind is the green symbol, value a pixel's own, n how many pixels, back how far a reference reaches."""
    if len(kind) == total and kind.max() < 256:
        return value
    at = np.cumsum(n) - n
    if (back > at).any():
        raise FormatError("a reference beyond the image")
    source = np.arange(total) - back.repeat(n)
    px = np.zeros(total, np.uint32)
    px[at] = value
    cached = np.flatnonzero(kind >= 256 + LENGTH_CODES)
    if len(cached):
        slot = np.zeros(total, np.uint32)
        slot[at] = _hashes(value, cache_bits)
        slot[at[cached]] = (kind[cached] - 256 - LENGTH_CODES).astype(np.uint32)
        slot = slot[_follow(source)]
        order = _in_order(slot)
        before = np.full(total, -1)
        same = slot[order[1:]] == slot[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        mine = at[cached]
        if (before[mine] < 0).any():  # an entry that was never filled: a pixel of zeros, whose hash isn't the entry's
            return _one_by_one(kind, value, n, back, total, cache_bits)
        source[mine] = before[mine]
    return px[_follow(source)]


def _one_by_one(kind: np.ndarray, value: np.ndarray, n: np.ndarray, back: np.ndarray, total: int, cache_bits: int) -> np.ndarray:
    """As _resolve(), an item after another."""
    out: list[int] = []
    cache, shift, fresh = [0] * (1 << cache_bits), 32 - cache_bits, 0
    for k, v, m, d in zip(kind.tolist(), value.tolist(), n.tolist(), back.tolist(), strict=True):
        if k < 256:
            out.append(v)
        elif k < 256 + LENGTH_CODES:
            for _ in range(m):
                out.append(out[-d])
        else:
            for p in out[fresh:]:
                cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = p
            fresh = len(out)
            out.append(cache[k - 256 - LENGTH_CODES])
    return np.array(out, np.uint32)


# ---- transforms


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255)


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
    return np.where(nearer, left, top)


def _half_more(a: np.ndarray, corner: np.ndarray) -> np.ndarray:
    d = a - corner
    return _clamp(a + ((d + (d < 0)) >> 1))


#: prediction from (left, top, top right, top left), arrays (..., 4) of signed integers
PREDICTIONS = [
    lambda l, t, tr, tl: np.broadcast_to(np.array([0, 0, 0, 255], t.dtype), t.shape),
    lambda l, t, tr, tl: l,
    lambda l, t, tr, tl: t,
    lambda l, t, tr, tl: tr,
    lambda l, t, tr, tl: tl,
    lambda l, t, tr, tl: _average(_average(l, tr), t),
    lambda l, t, tr, tl: _average(l, tl),
    lambda l, t, tr, tl: _average(l, t),
    lambda l, t, tr, tl: _average(tl, t),
    lambda l, t, tr, tl: _average(t, tr),
    lambda l, t, tr, tl: _average(_average(l, tl), _average(t, tr)),
    lambda l, t, tr, tl: _select(l, t, tl),
    lambda l, t, tr, tl: _clamp(l + t - tl),
    lambda l, t, tr, tl: _half_more(_average(l, t), tl),
]
#: Those that don't need the pixel to the left: a row is predicted at once.
FROM_ABOVE = [0, 2, 3, 4, 8, 9]


def _predict(mode: np.ndarray, l: np.ndarray, t: np.ndarray, tr: np.ndarray, tl: np.ndarray) -> np.ndarray:  # noqa: E741
    """Predictions of pixels (n, 4) with a mode each."""
    modes = np.flatnonzero(np.bincount(mode, minlength=14))
    if len(modes) == 1:
        return PREDICTIONS[modes[0]](l, t, tr, tl)
    out = np.empty_like(t)
    for m in modes.tolist():
        own = mode == m
        out[own] = PREDICTIONS[m](l[own], t[own], tr[own], tl[own])
    return out


def by_pixel(blocks: np.ndarray, step: int, h: int, w: int) -> np.ndarray:
    """The value of each pixel's block of 2^step pixels a side; a single block is left as it is."""
    if blocks.shape[:2] == (1, 1):
        return blocks
    return blocks.repeat(1 << step, 0)[:h].repeat(1 << step, 1)[:, :w]


def _mode_map(modes: np.ndarray, step: int, h: int, w: int) -> np.ndarray:
    return np.minimum(modes[np.arange(h)[:, None] >> step, np.arange(w)[None, :] >> step], 13)


def invert_predictor(residual: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    out = residual.astype(np.int16)
    h, w = out.shape[:2]
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], 0, dtype=np.int64) & 255
    out[:, 0] = np.cumsum(out[:, 0], 0, dtype=np.int64) & 255
    if h == 1 or w == 1:
        return out.astype(np.uint8)
    mode = _mode_map(modes, step, h, w)
    kinds = set(np.unique(mode[1:, 1:]).tolist())
    if kinds <= {1}:
        out[1:] = np.cumsum(out[1:], 1, dtype=np.int64) & 255
    elif kinds <= {2}:
        out[:, 1:] = np.cumsum(out[:, 1:], 0, dtype=np.int64) & 255
    elif kinds <= set(FROM_ABOVE):
        one = np.where((mode[:, 1:] == mode[:, 1:2]).all(1), mode[:, 1].astype(np.int64), -1).tolist()
        for y in range(1, h):
            above, own = out[y - 1], out[y, 1:]
            right = np.concatenate([above[2:], out[y, :1]]) if one[y] in (-1, 3, 9) else above[1:]
            own += _predict(mode[y, 1:], above[1:], above[1:], right, above[:-1]) if one[y] < 0 else PREDICTIONS[one[y]](above[1:], above[1:], right, above[:-1])
            own &= 255
    else:  # by waves: a pixel's neighbours lie in waves before its own
        for s in range(3, w + 2 * h - 2):
            ys = np.arange(max(1, -(-(s - w + 1) // 2)), min(h - 1, (s - 1) // 2) + 1)
            if not len(ys):
                continue
            xs = s - 2 * ys
            right = np.where((xs + 1 < w)[:, None], out[ys - 1, np.minimum(xs + 1, w - 1)], out[ys, 0])
            out[ys, xs] = (out[ys, xs] + _predict(mode[ys, xs], out[ys, xs - 1], out[ys - 1, xs], right, out[ys - 1, xs - 1])) & 255
    return out.astype(np.uint8)


def _neighbours(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left, top, top right and top left of the pixels beyond the first row and column."""
    top = image[:-1]
    return image[1:, :-1], top[:, 1:], np.concatenate([top[:, 2:], image[1:, :1]], 1), top[:, :-1]


def apply_predictor(image: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    wide = image.astype(np.int16)
    h, w = wide.shape[:2]
    out = wide.copy()
    out[0, 1:] -= wide[0, :-1]
    out[1:, 0] -= wide[:-1, 0]
    out[0, 0, 3] -= 255
    if h > 1 and w > 1:
        flat = [x.reshape(-1, 4) for x in _neighbours(wide)]
        out[1:, 1:] -= _predict(_mode_map(modes, step, h, w)[1:, 1:].ravel(), *flat).reshape(h - 1, w - 1, 4)
    return (out & 255).astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int16)


def cross_colour(image: np.ndarray, table: np.ndarray, step: int, inverse: bool) -> np.ndarray:
    """table: (rows, columns, 4) whose B, G, R are green to red, green to blue, red to blue."""
    h, w = image.shape[:2]
    t = by_pixel(_signed(table), step, h, w)
    out = image.astype(np.int16)
    green = _signed(image[..., 1])
    sign = 1 if inverse else -1
    red = (out[..., 0] + sign * ((t[..., 2] * green) >> 5)) & 255
    true_red = red if inverse else out[..., 0]
    out[..., 2] = (out[..., 2] + sign * (((t[..., 1] * green) >> 5) + ((t[..., 0] * _signed(true_red)) >> 5))) & 255
    out[..., 0] = red
    return out.astype(np.uint8)


def add_green(image: np.ndarray, sign: int = 1) -> np.ndarray:
    out = image.copy()
    for c in (0, 2):
        out[..., c] = out[..., c] + image[..., 1] if sign > 0 else out[..., c] - image[..., 1]
    return out


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def expand_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle_bits(len(palette))
    per, size = 1 << bits, 8 >> bits
    index = image[..., 1][..., None] >> (np.arange(per) * size) & ((1 << size) - 1) if bits else image[..., 1][..., None]
    index = index.reshape(image.shape[0], -1)[:, :width]
    whole = np.zeros((256, 4), np.uint8)  # an index beyond the palette is transparent black
    whole[: len(palette)] = palette
    return whole[index]


# ---- files


@dataclass(frozen=True)
class _Transform:
    kind: int
    step: int = 0
    data: np.ndarray | None = None
    width: int = 0


def _payload(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise FormatError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise FormatError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width, 4), R G B A, of a lossless WebP file."""
    return decode_all([data])[0]


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """As decode() of each; the tables of their codes are made together."""
    return together([_decoding(x) for x in files], prefix_codes)


def _decoding(data: bytes) -> Generator[list[bytes], list[PrefixCode], np.ndarray]:
    bits = Bits(_payload(data))
    if bits.read(8) != 0x2F:
        raise FormatError("not a lossless image")
    width = bits.read(14) + 1
    height = bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise FormatError("an unknown version")
    image = yield from _reading(bits, width, height)
    if not alpha:
        image = image.copy()
        image[..., 3] = 255
    return image


def read_stream(bits: Bits, width: int, height: int) -> np.ndarray:
    """The pixels of what follows a file's head: transforms and the main image. Planes of alpha are stored so too, in green."""
    return together([_reading(bits, width, height)], prefix_codes)[0]


def _reading(bits: Bits, width: int, height: int) -> Generator[list[bytes], list[PrefixCode], np.ndarray]:
    full, transforms = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t.kind for t in transforms}:
            raise FormatError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            step = bits.read(3) + 2
            size = ((width + (1 << step) - 1) >> step, (height + (1 << step) - 1) >> step)
            transforms.append(_Transform(kind, step, (yield from _read_image(bits, *size, False))))
        elif kind == SUBTRACT_GREEN:
            transforms.append(_Transform(kind))
        else:
            colours = bits.read(8) + 1
            palette = np.cumsum((yield from _read_image(bits, colours, 1, False))[0], 0).astype(np.uint8)
            transforms.append(_Transform(kind, 0, palette, width))
            width = (width + (1 << _bundle_bits(colours)) - 1) >> _bundle_bits(colours)
    image = yield from _read_image(bits, width, height, True)
    for t in reversed(transforms):
        if t.kind == PREDICTOR:
            image = invert_predictor(image, t.data[..., 1], t.step)
        elif t.kind == CROSS_COLOUR:
            image = cross_colour(image, t.data, t.step, True)
        elif t.kind == SUBTRACT_GREEN:
            image = add_green(image)
        else:
            image = expand_palette(image, t.data, t.width)
    if image.shape[1] != full:
        raise FormatError("the width doesn't fit")
    return image


# ---- the encoder


#: More than any count.
BEYOND = 1 << 60


def _depths(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Depths in Huffman trees; n (two or more) of the counts, one tree after another. All trees are joined at once, node by node."""
    by = np.argsort(-n, kind="stable")  # the largest first, so that those that go on are the first ones
    n_by = n[by]
    rank = np.empty(len(n), np.int64)
    rank[by] = np.arange(len(n))
    tree = rank.repeat(n)
    order = np.lexsort((counts, tree))
    total = len(counts)
    first = n_by.cumsum() - n_by
    leaves = np.full(total + len(n), BEYOND)  # one beyond any behind each tree's
    place = np.arange(total) + tree[order]
    leaves[place] = counts[order]
    nodes = np.full(total, BEYOND)  # a tree's in the order they are made, which is that of weight; one place is left
    size = len(leaves)
    up = np.arange(size + total)
    i, j = first + np.arange(len(n)), first.copy()
    going = np.bincount(n_by - 1)[::-1].cumsum()[::-1].tolist()  # trees of more than t nodes, from t + 1
    for t in range(int(n_by[0]) - 1):
        a = going[t + 1]
        leaf_at, node_at, made = i[:a], j[:a], first[:a] + t
        weight = 0
        for _ in (0, 1):
            x, y = leaves.take(leaf_at), nodes.take(node_at)
            is_leaf = x <= y
            weight = weight + np.minimum(x, y)
            up[np.where(is_leaf, leaf_at, node_at + size)] = made + size
            leaf_at += is_leaf
            node_at += ~is_leaf
        nodes[made] = weight
    depth = (up != np.arange(len(up))).astype(np.int64)
    while True:  # pointers upwards are doubled
        more = depth.take(up)
        if not more.any():
            break
        depth += more
        up = up.take(up)
    out = np.empty(total, np.int64)
    out[order] = depth[place]
    return out


def code_lengths(counts: np.ndarray, n: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman lengths of at most `most` of codes whose n symbols (two or more) have such counts; counts are flattened until they fit."""
    out = _depths(counts, n)
    deep = np.maximum.reduceat(out, n.cumsum() - n) > most
    if deep.any():
        own, k = deep.repeat(n), n[deep]
        x = counts[own]
        top = np.maximum.reduceat(x, k.cumsum() - k).repeat(k)
        out[own] = code_lengths((x >> 1) + 1 + (top >> most), k, most)
    return out


def canonical(lengths: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The code, its first bit lowest, of each symbol of codes of n symbols with such lengths."""
    code = np.arange(len(n)).repeat(n)
    first = n.cumsum() - n
    most = np.maximum.reduceat(lengths, first)
    order = np.argsort(code << 4 | lengths, kind="stable")
    span = 1 << (most.take(code) - lengths.take(order))
    begin = span.cumsum() - span
    begin -= begin[first].repeat(n)
    out = np.empty(len(lengths), np.int64)
    # reversed over `most` bits a code's first bit is lowest; those beyond its length are 0 at its range's begin
    out[order] = _reversal(15).take(begin) >> (15 - most).repeat(n)
    return out


#: The encoder's own code of code lengths: by symbol its length. Symbols 16 aren't written.
LENGTHS_CODE = [4, 6, 6, 5, 4, 3, 3, 3, 3, 4, 5, 5, 6, 6, 6, 6, 5, 4, 5]
#: Zeros that are written as one value: four of the longest runs.
ZEROS = 4 * 138


@lru_cache(1)
def _lengths_code() -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LENGTHS_CODE's own bits in a file; the bits, and how many, of each number of symbols without code, and of each length (none of 0)."""
    head = 15 << 1
    for i, s in enumerate(CODE_LENGTH_ORDER):
        head |= LENGTHS_CODE[s] << (5 + 3 * i)
    sizes = np.array(LENGTHS_CODE)
    codes = canonical(sizes, np.array([len(sizes)])).tolist()
    values, took = [0], [0]
    for zeros in range(1, ZEROS + 1):
        value = size = 0
        while zeros:
            take = min(zeros, 138) if zeros >= 3 else 1
            s, v, k = (18, take - 11, 7) if take >= 11 else (17, take - 3, 3) if take >= 3 else (0, 0, 0)
            value |= (codes[s] | v << LENGTHS_CODE[s]) << size
            size += LENGTHS_CODE[s] + k
            zeros -= take
        values.append(value)
        took.append(size)
    return head, np.array(values), np.array(took), np.array([0, *codes[1:16]]), np.array([0, *LENGTHS_CODE[1:16]])


def made_codes(counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each code's counts by symbol: codes and their lengths by symbol, and what states the code in a file, values and sizes."""
    if not counts:
        return []
    size = np.array([len(x) for x in counts])
    stop = size.cumsum()
    begin = stop - size
    flat = np.concatenate(counts)
    used = flat.nonzero()[0]
    code = stop.searchsorted(used, side="right")
    n = np.bincount(code, minlength=len(size))
    lone = [c for c in np.flatnonzero(n == 1).tolist() if counts[c][256:].any()]
    if lone:  # beyond the short form: a second symbol makes a code of two
        used = np.sort(np.append(used, begin[lone]))
        code = stop.searchsorted(used, side="right")
        n = np.bincount(code, minlength=len(size))
    last = n.cumsum() - 1
    short = (n < 2) | ((n == 2) & (used.take(last, mode="clip") - begin < 256)) if len(used) else n < 2
    lengths, codes = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    if n.max() > 1:
        real = (n > 1)[code]
        some, k = used[real], n[n > 1]
        own = code_lengths(flat[some], k)
        lengths[some] = own
        codes[some] = canonical(own, k)
    head, zero_values, zero_sizes, values, sizes = _lengths_code()
    # what stands before each symbol: zeros in steps of ZEROS, and its own length; behind the last one zeros alone
    long_ = ~short
    if long_.any():
        own = long_[code]
        at = np.insert(used[own], n[long_].cumsum(), stop[long_])
        k = n[long_] + 1
        ends = k.cumsum()
        before = np.concatenate([[0], at[:-1] + 1])
        before[ends - k] = begin[long_]
        gap = at - before
        step = np.append(lengths, 0)[at]
        step[ends - 1] = 0
        many = gap // ZEROS + 1
        final = many.cumsum() - 1
        zeros, own = np.full(int(many.sum()), ZEROS), np.zeros(int(many.sum()), np.int64)
        zeros[final], own[final] = gap % ZEROS, step
        rows = zero_values[zeros] | values[own] << zero_sizes[zeros]
        taken = zero_sizes[zeros] + sizes[own]
        cuts = np.concatenate([[0], many.cumsum()[ends - 1]])
    out, r = [], 0
    head_value, head_size = np.array([head]), np.array([5 + 3 * 19 + 1])
    for b, e, is_short, m, z in zip(begin.tolist(), stop.tolist(), short.tolist(), n.tolist(), last.tolist(), strict=True):
        if is_short:
            first = int(used[z - m + 1]) - b if m else 0
            v, w = [1 | (m == 2) << 1 | (first > 1) << 2, first], [3, 8 if first > 1 else 1]
            if m == 2:
                v.append(int(used[z]) - b)
                w.append(8)
            out.append((codes[b:e], lengths[b:e], np.array(v), np.array(w)))
            continue
        x, y = int(cuts[r]), int(cuts[r + 1])
        r += 1
        out.append((codes[b:e], lengths[b:e], np.concatenate([head_value, rows[x:y]]), np.concatenate([head_size, taken[x:y]])))
    return out


def _repeats(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel how many from it on repeat what stands where it and the next stood last (1 if nowhere), and how far back that is."""
    n, at = len(px), np.arange(len(px))
    back = np.zeros(n, np.int64)
    if n < 3:
        return np.ones(n, np.int64), back
    pair = px[:-1].astype(np.uint64) << np.uint64(32) | px[1:]
    key = (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(28) << np.uint64(28)  # an image has at most 2^28 pixels
    order = (np.sort(key | np.arange(n - 1, dtype=np.uint64)) & np.uint64((1 << 28) - 1)).astype(np.int64)
    gap = order[1:] - order[:-1]
    own = pair[order]
    same = (own[1:] == own[:-1]) & (gap > 0) & (gap <= FARTHEST)
    back[order[1:][same]] = gap[same]
    goes_on = np.append((back[:-1] > 0) & (back[1:] == back[:-1]), False)
    end = np.minimum.accumulate(np.where(goes_on, n, at)[::-1])[::-1]  # the last place of a run of equal distances
    return np.where(back > 0, np.minimum(end - at + 2, 4096), 1), back


def _put_image(out: BitWriter, image: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, step: int = 0) -> Generator[list[np.ndarray], list[tuple], None]:
    """Writes an entropy-coded image. Asks for made_codes()."""
    h, w = image.shape[:2]
    px = _pack(image).ravel()
    total = len(px)
    if not cache_bits and not step and (px == px[0]).all():  # one colour: codes that take no bits
        out.put(0, 2 if main else 1)
        for s in (px[0] >> 8 & 255, px[0] >> 16 & 255, px[0] & 255, px[0] >> 24, 0):
            out.put(5 | int(s) << 3, 11)
        return
    if references:
        length, back = _repeats(px)
        at = _walk(np.arange(total) + length, 0, total, total)
        n, d = length[at], back[at]
    else:
        at = np.arange(total)
        n, d = np.ones(total, np.int64), np.zeros(total, np.int64)
    is_ref = n > 1
    cached = np.zeros(len(at), bool)
    slot = None
    if cache_bits:
        slot = _hashes(px, cache_bits)
        order = _in_order(slot)
        hit = (slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
        there = np.zeros(total, bool)
        there[order[1:][hit]] = True
        cached = there[at] & ~is_ref
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups, which = 1, np.zeros(len(at), np.int64)
    if main:
        out.put(1 if step else 0, 1)
        if step:
            rows, cols = (h + (1 << step) - 1) >> step, (w + (1 << step) - 1) >> step
            board = (np.arange(rows)[:, None] + np.arange(cols)[None, :]) % 2
            groups = int(board.max()) + 1
            meta = np.zeros((rows, cols, 4), np.uint8)
            meta[..., 1], meta[..., 3] = board, 255
            out.put(step - 2, 3)
            yield from _put_image(out, meta, False)
            which = board[(at // w) >> step, (at % w) >> step]
    plain = ~is_ref & ~cached if references or cache_bits else None  # None: all
    argb = px[at].astype(np.int64) if references else px.astype(np.int64)
    green = (argb >> 8) & 255
    if references:
        ls, lv, ln = _extras_of(n)
        green = np.where(is_ref, 256 + ls, green)
    if cache_bits:
        green = np.where(cached, 256 + LENGTH_CODES + slot[at].astype(np.int64), green)
    parts = [(green, None, 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0))]
    for shift in (16, 0, 24):
        x = (argb >> shift) & 255
        parts.append((None, x[0], 256) if (x == x[0]).all() else (x, plain, 256))
    if references:
        _, near = _near(w)
        own = near.take(np.minimum(d, len(near) - 1))
        ds, dv, dn = _extras_of(np.where((d < len(near)) & (own > 0), own, d + len(NEAR)))
        parts.append((ds, is_ref, DISTANCE_CODES))
    else:
        parts.append((None, 0, DISTANCE_CODES))

    def counts_of(c: int, g: int) -> np.ndarray:
        s, takes, k = parts[c]
        own = takes if groups == 1 else which == g if takes is None else takes & (which == g)
        return np.bincount(s if own is None else s[own], minlength=k)

    asked = [(g, c) for g in range(groups) for c in range(5) if parts[c][0] is not None]
    made = iter((yield [counts_of(c, g) for g, c in asked]) if asked else ())
    codes = []
    for i in range(5 * groups):
        s, takes, _ = parts[i % 5]
        if s is None:  # the same everywhere: no bits
            out.put(1 | (takes > 1) << 2 | int(takes) << 3, 11 if takes > 1 else 4)
            codes.append(None)
            continue
        codes.append(next(made))
        out.put_all(*codes[-1][2:])
    value, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for c, (s, takes, _) in enumerate(parts):
        if s is None:
            continue
        if groups == 1:
            code, bits = codes[c][0].take(s), codes[c][1].take(s)
        else:
            code, bits = (np.stack([codes[5 * g + c][i] for g in range(groups)])[which, s] for i in range(2))
        if takes is not None:
            code, bits = np.where(takes, code, 0), np.where(takes, bits, 0)
        value |= code << size
        size += bits
        if references and c in (0, 4):
            v, k = ((lv, ln), (dv, dn))[c // 4]
            value |= np.where(is_ref, v, 0) << size
            size += np.where(is_ref, k, 0)
    out.put_all(value, size)


def _head(width: int, height: int) -> BitWriter:
    if not (1 <= width <= 1 << 14 and 1 <= height <= 1 << 14):
        raise FormatError("a side beyond 16384")
    out = BitWriter()
    out.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    return out


def _file(body: bytes) -> bytes:
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def colours_of(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pixels (n, 4), by value, and each pixel's number among them."""
    found, index = np.unique(_pack(image).ravel(), return_inverse=True)
    return _unpack(found), index.reshape(image.shape[:2])


def encode(image: np.ndarray, **how) -> bytes:
    """A file of an image; how: what _encoding() takes."""
    return encode_all([image], [how])[0]


def encode_all(images: list[np.ndarray], how: list[dict]) -> list[bytes]:
    """As encode() of each; their codes are made, and their bits packed, together."""
    return [_file(x) for x in packed(together([_encoding(x, **k) for x, k in zip(images, how, strict=True)], made_codes))]


def _encoding(image: np.ndarray, *, palette: bool = False, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, subtract_green: bool = False, step: int = 2, cache_bits: int = 0, references: bool = False, group_step: int = 0) -> Generator[list[np.ndarray], list[tuple], BitWriter]:
    """Writes an image with the transforms asked for. predictor: modes, cross: factors, one for each block of 2^step pixels a side."""
    h, w = image.shape[:2]
    out = _head(w, h)
    if palette:
        colours, index = colours_of(image)
        if len(colours) > 256:
            raise FormatError("more than 256 colours")
        out.put(1 | PALETTE << 1 | (len(colours) - 1) << 3, 11)
        yield from _put_image(out, np.diff(colours.astype(np.int16), axis=0, prepend=0).astype(np.uint8)[None], False)
        bits = _bundle_bits(len(colours))
        per, size = 1 << bits, 8 >> bits
        wide = np.zeros((h, -(-w // per) * per), np.int64)
        wide[:, :w] = index
        image = np.zeros((h, wide.shape[1] // per, 4), np.uint8)
        image[..., 1] = (wide.reshape(h, -1, per) << (np.arange(per) * size)).sum(-1) if bits else wide
        image[..., 3] = 255
    if predictor is not None:
        out.put(1 | PREDICTOR << 1 | (step - 2) << 3, 6)
        modes = np.zeros((*predictor.shape, 4), np.uint8)
        modes[..., 1], modes[..., 3] = predictor, 255
        yield from _put_image(out, modes, False)
        image = apply_predictor(image, predictor, step)
    if cross is not None:
        out.put(1 | CROSS_COLOUR << 1 | (step - 2) << 3, 6)
        yield from _put_image(out, cross, False)
        image = cross_colour(image, cross, step, False)
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        image = add_green(image, -1)
    out.put(0, 1)
    yield from _put_image(out, image, True, cache_bits, references, group_step)
    return out
