"""Exact Jaccard self-join of documents on sets of word n-grams, by grouped prefixes.

1. One pass hashes each document's n-grams and gives its set size, a 128-bit digest of the
   set, and the hashes that met themselves in its partition. Documents with equal sets form a
   class, which is one unit from here on.
2. In an order by (how frequent, hash), two sets that are similar enough share one of their
   first n - ceil(t n) + 1 n-grams, t = similarity. Classes with the same such prefix and
   size are one group; its name is a digest of both, so that groups form without a shuffle.
   Each group's prefix is posted once. Postings meet by n-gram.
3. Stars: of the groups that share an n-gram and are of about one size, each is paired with a few
   leaders. Copies share most of their n-grams, so they are paired with the same ones,
   and a group has few such pairs, however many groups share its n-grams. Pairs whose sizes, or
   whose n-grams from the shared one on, are too far apart drop out. Members of the
   others are expanded and verified. Their links join most copies into clusters.
4. The rest: of the clusters that share an n-gram, or a group, pairs stay that pass the same
   filters, and their members are verified until the clusters are linked. So a link is found
   between any two clusters that have one. All links give the components.

n-grams are held as 64-bit hashes. The sets of frequent hashes are Bloom filters; whatever they
hold, the order is the same everywhere, so no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_rows, slices, utf8
from .components import components
from .sketch import SketchSpec, key_bitmap, passes
from .wordhash import grams, hash_words, mix

@dataclass(frozen=True)
class JoinSpec:
    """n: words of a gram. num / den: least similarity. frequent: how many grams at most are ordered last, those in most
    documents; steps: numbers of documents from which on they come later still. star_grams: n-grams of a group, about so many, by which it looks for stars. leaders: of a star, besides the least edited. salt_rows: rows of a hot
    group, star or n-gram that stay together. tile: sets of one side that members are compared with at once. bloom_bits:
    at most 2^so many bits in each of a Bloom filter's rows."""

    n: int = 5
    num: int = 75
    den: int = 100
    frequent: int = 2_000_000
    steps: tuple = (8, 32, 128, 512)
    star_grams: int = 16
    leaders: int = 1
    salt_rows: int = 256
    tile: int = 64
    partition_rows: int = 400_000
    bloom_bits: int = 28


def bloom_for(keys: int, spec: JoinSpec) -> SketchSpec:
    """Eight bits a key or more, within the bound."""
    return SketchSpec(rows=2, bits=min(spec.bloom_bits, max(20, (4 * keys).bit_length())))


def gram_sets(data: np.ndarray, off: np.ndarray, spec: JoinSpec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges lo..hi of texts: their sorted distinct gram hashes one after another, and where each text's begin (hi - lo + 1)."""
    n = spec.n
    for lo, hi in slices(off):
        h, first, _, _ = hash_words(data, off[lo : hi + 1], lower=True)
        words = np.diff(first)
        count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(count)])
        s = np.empty(at[-1], np.uint64)
        short = np.flatnonzero((words > 0) & (words < n))
        place = np.ones(at[-1], bool)
        place[at[short]] = False
        text = np.repeat(np.arange(hi - lo), words)
        if len(h) >= n:
            s[place] = grams(h, n)[text[: len(h) - n + 1] == text[n - 1 :]]
        for i in short.tolist():
            own = h[first[i] : first[i + 1]]
            s[at[i]] = mix(grams(own, len(own)) + np.uint64(len(own)))[0]
        cuts = at.tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            s[a:b].sort()
        owner = np.repeat(np.arange(hi - lo), count)
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        yield lo, hi, s[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=hi - lo))])


def _digest(s: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """Of each set between the places at: a hash that doesn't depend on order."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + np.uint64(salt)))])
    return mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def _counts(s: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """Of each set how many of its hashes fall in each of its slots, a byte each; None if one doesn't fit. There are half as many slots as hashes, or up to twice that."""
    low, out, cuts = ((s >> np.uint64(20)) & np.uint64(8191)).astype(np.int64), [], at.tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        slots = min(max(32, 1 << ((b - a) // 2).bit_length()), 8192)
        n = np.bincount(low[a:b] & (slots - 1), minlength=slots)
        out.append(n.astype(np.uint8).tobytes() if n.max() < 256 else None)
    return out


def _most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of the lesser counts, the finer of the two folded to the other's slots."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    return int(np.minimum(x, y).sum())


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _profile(docs: DataFrame, spec: JoinSpec) -> DataFrame:
    """A row for each document (doc_id, text_key, n, d1, d2, slots), and rows with doc_id null and n = -1: a gram's hash (d1)
    and in how many documents of a stretch of the partition it is (d2), if more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0
        names = ["doc_id", "text_key", "n", "d1", "d2", "slots"]

        def frequent() -> Iterator[pa.RecordBatch]:
            nonlocal n_held
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                h, c = h[c > 1], c[c > 1]
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.full(k, -1)), _longs(h), pa.array(c.astype(np.int64)), pa.nulls(k, pa.binary())], names=names)
            held.clear()
            n_held = 0

        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi, s, at in gram_sets(data, off, spec):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(at)), _longs(_digest(s, at, 1)), _longs(_digest(s, at, 2)), pa.array(_counts(s, at), pa.binary())], names=names)
                held.append(s)
                n_held += len(s)
                if n_held > 1 << 21:
                    yield from frequent()
        yield from frequent()

    return docs.mapInArrow(run, "doc_id long, text_key long, n long, d1 long, d2 long, slots binary")


def verify(docs: DataFrame, classes: DataFrame, roles: DataFrame, spec: JoinSpec, scratch: Scratch) -> DataFrame:
    """Links (a, b) of classes that are similar enough, by their whole sets.

    roles: (cid, g, salt, member, side). In each (g, salt) the members (1) are compared with
    the leaders (0). Leaders of one side stand for a cluster, and members of a group with
    sides for another: a side that is linked is done. Without sides (null) a member is done
    with its first link, and leaders are compared with each other too.

    Before any set is fetched, the leaders and members are held against each other by their
    counts in slots: two sets share at most the sum of the lesser counts. Those whom that
    rules out with everyone drop out.

    The sets are made again from the texts, of each class from its representative (a Bloom
    filter of a bounded size leaves out nearly all others). A task holds the sets of the
    leaders of one (g, salt), which are few, and streams through the members.
    """
    every, roles = roles, scratch.keep(_possible(roles, classes, spec))
    scratch.forget(every)
    d = F.coalesce("rep", F.lit(-1).cast("long"))
    need = roles.select("cid").distinct().join(classes.select("cid", "rep"), "cid").select(F.col("cid").bitwiseXOR(F.shiftleft(d, 17)).bitwiseXOR(d).alias("key"))
    bloom = bloom_for(roles.count(), spec)
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(need, "key", bloom))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            ids = np.asarray(batch.column(0).fill_null(-1)).astype(np.int64)
            for lo, hi, s, at in gram_sets(data, off, spec):
                cid, own = _digest(s, at, 1), ids[lo:hi]
                key = cid ^ (own << 17).view(np.uint64) ^ own.view(np.uint64)
                ok = np.flatnonzero(passes(bits.value, key, bloom) & (np.diff(at) > 0))
                if len(ok):
                    yield pa.RecordBatch.from_arrays([_longs(cid[ok]), pa.array([s[at[i] : at[i + 1]].tobytes() for i in ok.tolist()], pa.binary())], names=["cid", "grams"])

    found = docs.mapInArrow(sets, "cid long, grams binary")
    met = found.join(roles, "cid").select("g", "salt", "member", "cid", "side", "grams")
    num, den = spec.num, spec.den

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        if den * min(len(x), len(y)) < num * max(len(x), len(y)):
            return False
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        both = int((x[at] == y).sum())
        return den * both >= num * (len(x) + len(y) - both)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders, done = None, {}, set()
        for batch in batches:
            links = []
            for g, salt, member, cid, side, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if key != (g, salt):
                    key, leaders, done = (g, salt), {}, set()
                if cid in leaders:
                    continue
                if member and side is not None:
                    for other, (o_side, grams_) in leaders.items():
                        if o_side not in done and similar(grams_, own):
                            links.append((other, cid))
                            done.add(o_side)
                elif member:
                    hit = next((other for other, (_, x) in leaders.items() if similar(x, own)), None)
                    if hit is not None:
                        links.append((hit, cid))
                else:
                    if side is None:
                        links += [(other, cid) for other, (_, x) in leaders.items() if similar(x, own)]
                    leaders[cid] = (side, own)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = met.repartition("g", "salt").sortWithinPartitions("g", "salt", "member")
    links = scratch.keep(dealt.mapInArrow(compare, "a long, b long"))
    scratch.forget(roles)
    return links


def _possible(roles: DataFrame, classes: DataFrame, spec: JoinSpec) -> DataFrame:
    """The roles without leaders and members that are unlike everyone in their (g, salt), by sizes and counts in slots."""
    num, den = spec.num, spec.den
    columns = ["cid", "g", "salt", "member", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders, used = None, [], set()

        def like(n: int, x: np.ndarray | None, m: int, y: np.ndarray | None) -> bool:
            if den * min(n, m) < num * max(n, m):
                return False
            return x is None or y is None or (den + num) * _most_shared(x, y) >= num * (n + m)

        for batch in batches:
            out = []
            for cid, g, salt, member, side, n, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if key != (g, salt):
                    key, leaders, used = (g, salt), [], set()
                slots = None if raw is None else np.frombuffer(raw, np.uint8).astype(np.uint16)
                if not member:
                    leaders.append((cid, side, n, slots))
                    continue
                hit = [i for i, (c, _, m, y) in enumerate(leaders) if c != cid and like(n, slots, m, y)]
                for i in hit:
                    if i not in used:
                        used.add(i)
                        out.append((leaders[i][0], g, salt, 0, leaders[i][1]))
                if hit:
                    out.append((cid, g, salt, 1, side))
            if out:
                c, g, x, m, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(g, pa.int64()), pa.array(x, pa.int32()), pa.array(m, pa.int32()), pa.array(d, pa.int64())], names=columns)

    met = roles.join(classes.select("cid", "n", "slots"), "cid").select(*columns, "n", "slots")
    return met.repartition("g", "salt").sortWithinPartitions("g", "salt", "member").mapInArrow(run, "cid long, g long, salt int, member int, side long")


POSTED = "token long, gid long, kind int, n int, rest int, odd int"
RARE, FREQUENT, MEMBER = 0, 1, 2  # kinds of rows: postings of n-grams, and a class (token) as a member of its group


def _postings(docs: DataFrame, heavy: list[tuple[np.ndarray, SketchSpec]], partitions: int, spec: JoinSpec) -> DataFrame:
    """POSTED: of each group its prefix grams that another group has too, and all frequent ones; and the classes of each group.

    n: the group's set size, rest: its grams from this one on, odd: thousandths of its set that aren't frequent."""
    bits, blooms = docs.sparkSession.sparkContext.broadcast([b for b, _ in heavy]), [x for _, x in heavy]
    names = [c.split()[0] for c in POSTED.split(", ")]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: set[int] = set()
        groups: set[int] = set()
        for batch in batches:
            data, off = utf8(batch.column(1))
            for _, _, s, at in gram_sets(data, off, spec):
                size = np.diff(at).tolist()
                cid = _digest(s, at, 1).view(np.int64)
                step = np.zeros(len(s), np.int8)
                for bitmap, bloom in zip(bits.value, blooms, strict=True):
                    step += passes(bitmap, s, bloom)
                late = step > 0
                before = np.concatenate([[0], np.cumsum(late)]).tolist()
                cuts = at.tolist()
                tokens, kinds, rest, owner, gids, odd, found = [], [], [], [], [], [], []
                for i, (n, c) in enumerate(zip(size, cid.tolist(), strict=True)):
                    if not n or c in classes:
                        continue
                    classes.add(c)
                    own, flag = s[cuts[i] : cuts[i + 1]], late[cuts[i] : cuts[i + 1]]
                    p = n + (-spec.num * n // spec.den) + 1
                    if before[cuts[i + 1]] > before[cuts[i]]:
                        order = np.argsort(step[cuts[i] : cuts[i + 1]], kind="stable")
                        own, flag = own[order], flag[order]
                    own = own[:p]
                    gid = int(mix(mix(own).sum(keepdims=True) + np.uint64(n)).view(np.int64)[0])
                    found.append((c, gid, n))
                    if gid in groups:
                        continue
                    groups.add(gid)
                    tokens.append(own)
                    kinds.append(flag[:p])
                    rest.append(np.arange(n, n - p, -1, dtype=np.int32))
                    owner += [i] * p
                    gids += [gid] * p
                    odd += [1000 - 1000 * (before[cuts[i + 1]] - before[cuts[i]]) // n] * p
                if tokens:
                    o = np.array(owner)
                    yield pa.RecordBatch.from_arrays([_longs(np.concatenate(tokens)), pa.array(gids, pa.int64()), pa.array(np.concatenate(kinds).astype(np.int32)), pa.array(np.array(size, np.int32)[o]), pa.array(np.concatenate(rest)), pa.array(odd, pa.int32())], names=names)
                if found:
                    c, g, n = (np.array(x, np.int64) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(g), pa.array(np.full(len(c), MEMBER, np.int32)), pa.array(n.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.zeros(len(c), np.int32))], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        columns = [np.asarray(t.column(c)) for c in names]
        order = np.lexsort((columns[1], columns[0], columns[2]))
        token, gid, kind, n, rest, odd = (x[order] for x in columns)
        other = np.concatenate([[True], (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])])
        first = np.flatnonzero(other | np.concatenate([[True], gid[1:] != gid[:-1]]))
        token, gid, kind, n, rest, odd, other = (x[first] for x in (token, gid, kind, n, rest, odd, other))
        begin = np.flatnonzero(other)
        many = np.diff(np.append(begin, len(token)))
        keep = (kind != RARE) | np.repeat(many > 1, many)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, gid, kind, n, rest, odd)], names=names)

    place = F.when(F.col("kind") == FREQUENT, F.xxhash64("token", "gid")).otherwise(F.col("token"))
    return docs.mapInArrow(post, POSTED).repartition(partitions, place).mapInArrow(meet, POSTED)


def _alike(n: str, rest: str, m: str, left: str, spec: JoinSpec) -> Column:
    """Whether sets of sizes n and m, with so many grams from a shared one on, can be similar: from the first gram on that two
    sets share, either has as many grams left as they share, t / (1 + t) of both sizes at least."""
    fit = F.least(n, m) * spec.den >= F.greatest(n, m) * spec.num
    return fit & (F.least(rest, left) * (spec.num + spec.den) >= (F.col(n) + F.col(m)) * spec.num)


def _salted(pairs: DataFrame, spec: JoinSpec) -> DataFrame:
    """Roles of pairs (lead, cid): the members of a star are dealt into parts, each with its leader."""
    none = F.lit(None).cast("long").alias("side")
    salts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / spec.salt_rows).cast("int").alias("salts"))
    leaders = salts.select(F.col("lead").alias("cid"), F.col("lead").alias("g"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), none)
    members = pairs.join(salts, "lead").select("cid", F.col("lead").alias("g"), F.pmod(F.xxhash64("cid"), "salts").cast("int").alias("salt"), F.lit(1).alias("member"), none)
    return members.unionByName(leaders)


def _star_roles(posted: DataFrame, members: DataFrame, spec: JoinSpec, scratch: Scratch) -> DataFrame:
    """Roles by which each group meets a few of those of about its size that share an n-gram, and a group's classes its first one.

    These few are, of the groups of an n-gram, the one with the least share of rare n-grams, since an unedited text
    has fewest, and spec.leaders more by hashes of their names.
    """
    prefix = F.col("n") - F.ceil(F.col("n") * spec.num / spec.den) + 1
    some = F.pmod(F.xxhash64("token"), F.greatest(F.lit(1), F.floor(prefix / spec.star_grams))) == 0
    rows = posted.filter(F.col("kind") != MEMBER).filter(some)
    rows = rows.select("token", "gid", "n", "rest", "odd", F.floor(F.log("n") / math.log(spec.den / spec.num)).alias("about"))
    firsts = [F.min_by(F.struct(F.col("gid").alias("lead"), F.col("n").alias("m"), F.col("rest").alias("left")), order) for order in (F.struct("odd", "gid"), *(F.xxhash64("gid", F.lit(j)) for j in range(spec.leaders)))]
    lead = rows.groupBy("token", "about").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.array_distinct(F.array(*firsts)).alias("l")).filter("lo < hi")
    lead = lead.select("token", "about", F.inline("l"))
    pairs = rows.join(lead, ["token", "about"]).filter((F.col("gid") != F.col("lead")) & _alike("n", "rest", "m", "left", spec)).select("lead", "gid").distinct()
    heads = members.groupBy("gid").agg(F.min("cid").alias("head"), F.max("cid").alias("last"))
    found = pairs.join(heads.select(F.col("gid").alias("lead"), "head"), "lead").select("gid", F.col("head").alias("lead")).join(members, "gid").select("lead", "cid")
    inner = members.join(heads.filter("head < last"), "gid").filter("cid <> head").select(F.col("head").alias("lead"), "cid")
    return scratch.keep(_salted(scratch.keep(found.unionByName(inner).distinct()), spec))


def _frequent(profile: DataFrame, spec: JoinSpec, scratch: Scratch) -> list[tuple[np.ndarray, SketchSpec]]:
    """Bloom filters of the grams that are ordered last: of those that met themselves within a partition, the spec.frequent
    with most documents, and of these those in ever more of them."""
    counts = scratch.keep(profile.filter("n = -1").groupBy("d1").agg(F.sum("d2").alias("c")))
    kept = []
    for r in counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect():  # at most 100,000 rows
        if sum(k for _, k in kept) + r["k"] > spec.frequent:
            break
        kept.append((r["c"], r["k"]))
    out = []
    for least in [kept[-1][0], *(c for c in spec.steps if c > kept[-1][0])] if kept else []:
        n = sum(k for c, k in kept if c >= least)
        if n:
            bloom = bloom_for(n, spec)
            out.append((key_bitmap(counts.filter(F.col("c") >= least), "d1", bloom), bloom))
    scratch.forget(counts)
    return out


def _cluster_roles(posted: DataFrame, members: DataFrame, spec: JoinSpec, scratch: Scratch) -> DataFrame:
    """Roles by which the members of clusters meet that share a prefix gram or a group. members: (cid, gid, comp, n).

    For clusters, the most grams that are left in a group from the shared one on, and the least and
    greatest sizes are taken, so no pair of their members is lost.
    """
    own = members.groupBy("gid", "comp").agg(F.max("n").alias("n"))
    several = own.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("gid")
    inner = own.join(several, "gid").select(F.col("gid").alias("token"), "comp", "n", F.col("n").alias("rest"))
    live = posted.filter(F.col("kind") != MEMBER).join(own.select("gid", "comp"), "gid").select("token", "comp", "n", "rest")
    live = live.groupBy("token", "comp").agg(F.min("n").alias("n"), F.max("rest").alias("rest")).unionByName(inner)
    both = live.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).filter("x <> y")
    both = both.select("token", F.ceil(F.col("c") / spec.salt_rows).cast("int").alias("salts"))
    sizes = members.groupBy("comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k"))
    live = scratch.keep(live.join(both, "token").join(sizes, "comp"))
    left, right = (live.select("token", "salts", *(F.col(c).alias(c + x) for c in ("comp", "n", "rest", "lo", "hi", "k"))) for x in "ab")
    left = left.withColumn("salt", F.pmod(F.xxhash64("compa"), "salts").cast("int")).drop("salts")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    enough = F.least("resta", "restb") * (spec.num + spec.den) >= (F.col("na") + F.col("nb")) * spec.num
    fit = (F.col("hia") * spec.den >= F.col("lob") * spec.num) & (F.col("hib") * spec.den >= F.col("loa") * spec.num)
    pairs = left.join(right, ["token", "salt"]).filter((F.col("compa") < F.col("compb")) & enough & fit)
    pairs = scratch.keep(pairs.select(F.col("compa").alias("ca"), F.col("compb").alias("cb"), "ka", "kb").distinct())
    scratch.forget(live)
    big = (F.col("ka") > F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("ca") < F.col("cb")))
    pairs = pairs.select(F.when(big, F.col("ca")).otherwise(F.col("cb")).alias("big"), F.when(big, F.col("cb")).otherwise(F.col("ca")).alias("small"), F.greatest("ka", "kb").alias("k"), F.least("ka", "kb").alias("ks"))
    # members of a cluster are dealt into parts of salt_rows; whoever joins them goes to every part
    parts = lambda k: F.ceil(F.col(k) / spec.salt_rows).cast("int")
    own = members.select("comp", "cid").join(sizes.select("comp", "k"), "comp").select("comp", "cid", F.pmod(F.xxhash64("cid"), parts("k")).cast("int").alias("salt"))
    every = lambda df, k: df.withColumn("salt", F.explode(F.sequence(F.lit(0), parts(k) - 1)))
    # a cluster of one class bears its name
    leaders = pairs.filter("ks = 1").select("big", "k", F.col("small").alias("side"), F.col("small").alias("cid")).unionByName(
        every(pairs.filter("ks > 1"), "ks").join(own.withColumnRenamed("comp", "small"), ["small", "salt"]).select("big", "k", F.col("small").alias("side"), "cid")
    )
    tiles = leaders.groupBy("big").agg(F.ceil(F.count("*") / spec.tile).alias("tiles"))
    leaders = leaders.join(tiles, "big").withColumn("tile", F.pmod(F.xxhash64("cid"), "tiles"))
    g = F.xxhash64("big", "tile").alias("g")
    lead = every(leaders, "k").select("cid", g, "salt", F.lit(0).alias("member"), "side")
    groups = every(leaders.select("big", "tile", "k").distinct(), "k")
    alone = groups.filter("k = 1").withColumn("cid", F.col("big"))
    rest = alone.unionByName(groups.filter("k > 1").join(own.withColumnRenamed("comp", "big"), ["big", "salt"]).select(alone.columns))
    rest = rest.select("cid", g, "salt", F.lit(1).alias("member"), F.col("big").alias("side"))
    out = scratch.keep(lead.unionByName(rest))
    scratch.forget(pairs)
    return out


def link(docs: DataFrame, spec: JoinSpec, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """profile (doc_id, text_key, n, d1, d2), classes (cid, n, rep), and verified links (a, b) that join all classes that links join."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    profile = scratch.keep(_profile(plain.withColumn("text_key", F.xxhash64("text")), spec))
    own = profile.filter("n > 0")
    classes = scratch.keep(own.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("slots").alias("slots")).withColumnRenamed("d1", "cid"))

    heavy = _frequent(profile, spec, scratch)
    grams_ = own.agg(F.sum("n")).first()[0] or 0
    partitions = max(8, -(-grams_ * (spec.den - spec.num) // spec.den // spec.partition_rows))
    posted = scratch.keep(_postings(plain, heavy, partitions, spec))
    members = scratch.keep(posted.filter(F.col("kind") == MEMBER).select(F.col("token").alias("cid"), "gid", "n"))
    near = verify(plain, classes, _star_roles(posted, members, spec, scratch), spec, scratch)
    clusters = scratch.keep(components(near, scratch))
    joined = scratch.keep(members.join(clusters.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "gid", "n", F.coalesce("comp", "cid").alias("comp")))
    far = verify(plain, classes, _cluster_roles(posted, joined, spec, scratch), spec, scratch)
    scratch.forget(posted, members, clusters, joined)
    return profile.filter("n >= 0"), classes, near.unionByName(far)


def component_ids(docs: DataFrame, spec: JoinSpec, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, text_key (a hash of the text) of every row.

    component_id is the smallest doc_id that links reach. Null or empty text: no n-grams,
    no links, its own id. A text of fewer words than n has one n-gram, all its words.
    Repeated rows are copies of each other and get equal results. Ids that are null are
    passed over for component_id. An empty table gives no rows. Other columns are not read.
    """
    profile, classes, links = link(docs, spec, scratch, id_col, text_col)
    joined = components(links, scratch)
    named = classes.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    first = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    label = named.join(first, "comp").select(F.col("cid").alias("d1"), "d2", "component_id")
    out = profile.join(label, ["d1", "d2"], "left")
    mine = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"), "text_key")


def keep_one(docs: DataFrame, spec: JoinSpec, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not their component's first: of each group the document of smallest id stays.

    A row is known by its id and the hash of its text; rows that repeat the one that stays
    are that document and stay. Of rows without id those stay whose component has no id at
    all. Rows without words stay.
    """
    ids = component_ids(docs, spec, scratch, id_col, text_col)
    later = F.coalesce(F.col("component_id") != F.col("doc_id"), F.col("component_id").isNotNull())
    return join_rows(docs, ids.filter((F.col("n_shingles") > 0) & later), "left_anti", id_col, text_col)
