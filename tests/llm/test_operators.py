import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from winlaw.llm import components, cuckoo, decontam, license_scan, line_dedup, ngram_join, ordinal, packing, sharding, sketch, substring_dedup, wordhash
from winlaw.llm.common import Scratch

from . import brute

P = pytest.importorskip("public_tokenizers")


def by_id(rows, values):
    """Results of rows, as a multiset of (doc_id, text, value)."""
    return collections.Counter((d, *v) for (d, _), v in zip(rows, values, strict=True))


# ---- packing


@pytest.fixture(scope="module")
def pack_spec():
    return packing.PackSpec(P.path("word_bpe_49k.json"))


def test_packing_places_every_id_once(docs, rows, pack_spec):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pack_spec.tokenizer)
    got = packing.pack(docs, pack_spec, with_ids=True).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[(d, np.array(ids, "<u4").tobytes())] += 1
    pieces = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[(r["doc_id"], r["doc_tokens"])].append((r["start"], bytes(r["ids"])))
    back = collections.Counter()
    for (d, n), own in pieces.items():
        whole = sorted(own)
        copies = sum(1 for s, _ in whole if s == 0)
        cover = np.zeros(n, int)
        for s, raw in own:
            cover[s : s + len(raw) // 4] += 1
        assert (cover == copies).all()
        if copies == 1:
            back[(d, b"".join(raw for _, raw in whole))] += 1
    single = {k: v for k, v in want.items() if v == 1 and k[0] is not None}
    assert all(back[k] == 1 for k in single)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(seqs) <= -(-total // 4096) + 3  # one short sequence for each of three partitions


def test_packing_edges(no_docs, pack_spec):
    assert packing.pack(no_docs, pack_spec).count() == 0
    rng = np.random.default_rng(0)
    for lengths in ([], [0, 0], [1], [4096], [4097, 1], [9000], rng.integers(0, 9000, 300)):
        lengths = np.array(lengths, np.int64)
        pieces = packing.assign(lengths, pack_spec)
        assert sum(p[2] for p in pieces) == lengths.sum()
        assert len({p[3] for p in pieces}) == -(-int(lengths.sum()) // 4096) or not len(lengths) or lengths.max() > 4096
        for i, n in enumerate(lengths):
            own = sorted((p[1], p[2]) for p in pieces if p[0] == i)
            assert [s for s, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1]][: len(own)] and sum(k for _, k in own) == n


def test_packing_balances_cost(pack_spec):
    lengths = np.random.default_rng(1).integers(1, 2000, 2000)
    cost = collections.Counter()
    for _, _, n, s, _ in packing.assign(lengths, pack_spec):
        cost[s] += n + n * n / 4096
    first_fit, room, seq = collections.Counter(), 0, 0
    for n in lengths.tolist():
        if room < n:
            seq, room = seq + 1, 4096
        first_fit[seq] += n + n * n / 4096
        room -= n
    spread = lambda c: np.std(list(c.values())) / np.mean(list(c.values()))
    assert spread(cost) < spread(first_fit)


# ---- n-gram join


def test_components_match_brute_force(docs, rows, spark):
    got = ngram_join.component_ids(docs, ngram_join.JoinSpec(), Scratch(spark)).collect()
    want = collections.Counter((d, *v) for (d, _), v in zip(rows, brute.components(rows), strict=True))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("kw", [{"salt_rows": 2, "frequent": 20, "partition_rows": 50, "tile": 3}, {"frequent": 0}, {"star_grams": 1, "bloom_bits": 4, "steps": (2, 3), "leaders": 0}])
def test_join_with_other_orders_and_small_parts(docs, rows, spark, kw):
    got = ngram_join.component_ids(docs, ngram_join.JoinSpec(**kw), Scratch(spark)).collect()
    want = collections.Counter((d, *v) for (d, _), v in zip(rows, brute.components(rows), strict=True))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_links_come_from_groups_of_prefixes(docs, rows, spark):
    """All links are verified pairs of the two steps of the prefix join; there is no other source."""
    scratch = Scratch(spark)
    seen = {}
    old = ngram_join.verify
    try:
        ngram_join.verify = lambda *a: seen.setdefault(len(seen), old(*a))
        ngram_join.link(docs, ngram_join.JoinSpec(), scratch)
    finally:
        ngram_join.verify = old
    assert set(seen) == {0, 1} and sum(links.count() for links in seen.values()) > 0


def test_a_group_holds_the_classes_of_one_prefix(spark):
    """Sets of one size and prefix are one group, are posted once, and are compared within it."""
    spec = ngram_join.JoinSpec()
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 4, 60 + i % 4))) for i in range(8)], "doc_id long, text string").repartition(3)
    posted = ngram_join._postings(docs.select("doc_id", "text"), [], 4, spec)
    members = [r for r in posted.collect() if r["kind"] == ngram_join.MEMBER]
    assert len(members) == 4 and all(r["n"] == 56 for r in members)
    rows = [r for r in posted.collect() if r["kind"] == ngram_join.RARE]
    assert len({(r["token"], r["gid"]) for r in rows}) == len(rows) and {r["gid"] for r in rows} <= {r["gid"] for r in members}


def test_chain_of_links_is_one_component(spark):
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 100 - 4 * i])) for i in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.component_ids(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.JoinSpec(), Scratch(spark)).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(rows, brute.components(rows), strict=True)}
    assert len(set(got.values())) < 12


def test_keep_one(docs, rows, spark):
    kept = ngram_join.keep_one(docs, ngram_join.JoinSpec(), Scratch(spark))
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    comp = brute.components(rows)
    for (d, t), (n, c) in zip(rows, comp, strict=True):
        if d is not None:
            assert (ids[d] > 0) == (n == 0 or c == d), (d, n, c)
    assert ids[5] == sum(d == 5 for d, _ in rows)


def test_join_of_nothing(no_docs, spark):
    assert ngram_join.component_ids(no_docs, ngram_join.JoinSpec(), Scratch(spark)).count() == 0


@pytest.mark.parametrize("one_task", [1000, 0])
def test_connected_components(spark, one_task):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark), one_task=one_task).collect()}
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# ---- ordinal


def _graded(spark, n=900):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        g = i % 3
        w = [f"w{x}" for x in rng.integers(0, 300, rng.integers(20, 120))]
        if g == 0:
            w[rng.integers(len(w))] = ["vile", "awful"][rng.integers(2)]
        if g == 1:
            w = [f"{x}%%%" for x in w]
        rows.append((i, " ".join(w), g))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_ordinal_held_out(spark):
    data, spec = _graded(spark), ordinal.OrdinalSpec(bits=14)
    model = ordinal.fit(data.filter("doc_id % 4 <> 0"), data.select("doc_id", "grade"), spec)
    assert (np.diff(model.thresholds) >= 0).all()
    out = ordinal.score(data.filter("doc_id % 4 = 0"), model, spec).toPandas()
    assert ((out["grade"] >= 2) == out["keep"]).mean() > 0.95
    means = out.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]


def test_ordinal_is_reproducible_and_bounded(spark):
    data, spec = _graded(spark, 300), ordinal.OrdinalSpec(bits=12, rows_per_grade=40)
    a, b = (ordinal.fit(data.repartition(n), data.select("doc_id", "grade"), spec) for n in (2, 5))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)


def test_ordinal_likelihood_and_slopes():
    """Against the likelihood written out grade by grade, and its slopes by differences."""
    import math

    rng = np.random.default_rng(7)
    z, t, y, w = rng.normal(0, 2, 40), np.array([-1.0, 0.3, 1.1]), rng.integers(0, 4, 40), rng.uniform(0.5, 2, 40)

    def loss(z, t):
        total = 0.0
        for v, g, k in zip(z, y, w, strict=True):
            at_least = [1.0, *(1 / (1 + math.exp(-(v - e))) for e in t), 0.0]
            total -= k * math.log(at_least[g] - at_least[g + 1])
        return total

    terms, gz, gt = ordinal.gradient(z, t, y, w)
    assert abs(terms.sum() - loss(z, t)) < 1e-9
    h = 1e-6
    for i in range(40):
        e = np.eye(40)[i] * h
        assert abs(gz[i] - (loss(z + e, t) - loss(z - e, t)) / (2 * h)) < 1e-5
    for j in range(3):
        e = np.eye(3)[j] * h
        assert abs(gt[j] - (loss(z, t + e) - loss(z, t - e)) / (2 * h)) < 1e-4


def test_ordinal_scores_match_brute_force(spark):
    """Features, score and probabilities of each text from its own words, one by one."""
    import math

    spec = ordinal.OrdinalSpec(bits=12)
    texts = ["", "One two two THREE", "one!! two?? 3 Ünï", "x " * 500 + "Y", None, "a b c d"]
    rng = np.random.default_rng(1)
    model = ordinal.OrdinalModel(rng.normal(0, 0.3, 1 << 12).astype(np.float32), np.array([-0.4, 0.7]))
    got = ordinal.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, spec).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        found = set()
        for kind in ("alnum", "marks"):
            h, _, _, _ = wordhash.hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), True, kind)
            found |= {int(x) >> 52 for x in h}
        words = brute.re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
        marks = brute.re.findall(rb"[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", raw)
        n, m = len(words), max(len(words), 1)
        distinct = len({int(x) >> 52 for x in wordhash.hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), True, "alnum")[0]})
        share = lambda x: min(math.ceil(20 * x / m), 40)
        capitals = sum(65 <= c <= 90 for c in raw)
        for j, x in enumerate([int(math.log2(n + 1)) * 64 + share(distinct), share(len(marks)), share(capitals)]):
            found.add(int(wordhash.mix(np.array([x + (j << 32)], np.uint64) + np.uint64(0x5851F42D4C957F2D))[0]) >> 52)
        z = sum(float(model.weights[f]) for f in found)
        tail = [1 / (1 + math.exp(-(z - e))) for e in model.thresholds]
        assert abs(r["expected_grade"] - sum(tail)) < 1e-6 and abs(r["tail_probability"] - tail[1]) < 1e-6 and r["keep"] == (tail[1] >= 0.5)


def test_ordinal_edges(docs, no_docs, spark):
    spec = ordinal.OrdinalSpec(bits=10)
    none = spark.createDataFrame([(None, 1), (1, None), (2, 9)], "doc_id long, grade int")
    model = ordinal.fit(docs, none, spec)
    assert not model.weights.any()
    out = ordinal.score(docs, model, spec)
    assert out.count() == docs.count() and out.filter("tail_probability IS NULL").count() == 0
    assert dict(out.dtypes)["keep"] == "boolean"
    assert ordinal.score(no_docs, model, spec).count() == 0


# ---- repeated passages


@pytest.mark.parametrize("kw", [{}, {"hot": 1}, {"hot": 2, "hot_keys": 3}, {"sketch": sketch.SketchSpec(rows=1, bits=6)}, {"sketch": sketch.SketchSpec(rows=1, bits=3), "hot": 3}, {"partition_windows": 100, "max_bits": 4}])
def test_repeats_match_brute_force(docs, rows, spark, kw):
    got = substring_dedup.remove_repeats(docs, substring_dedup.SubstringSpec(**kw), Scratch(spark)).collect()
    want = by_id(rows, brute.without_repeats([t for _, t in rows]))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept_text"])) for r in got) == want


def test_only_windows_estimated_repeated_are_grouped(docs, rows, spark, monkeypatch):
    """What is written are spans from the first to the last window that the sketches let pass; full sketches let all pass."""
    sizes = {}
    old = substring_dedup._places

    def places(*a):
        out = old(*a)
        sizes[len(sizes)] = out.agg(F.sum(F.length("windows") / 8)).first()[0]
        return out

    monkeypatch.setattr(substring_dedup, "_places", places)
    for kw in ({}, {"sketch": sketch.SketchSpec(rows=1, bits=3)}):
        substring_dedup.remove_repeats(docs, substring_dedup.SubstringSpec(**kw), Scratch(spark))
    split = [brute.words(t) for _, t in rows]
    windows = [tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34)]
    count = collections.Counter(windows)
    repeated = sum(n for n in count.values() if n > 1)
    assert repeated <= sizes[0] < 1.1 * repeated and sizes[1] == len(windows)


def test_repeats_of_nothing(no_docs, spark):
    assert substring_dedup.remove_repeats(no_docs, substring_dedup.SubstringSpec(), Scratch(spark)).count() == 0


def test_sketch_never_underestimates():
    spec = sketch.SketchSpec(rows=2, bits=10)
    keys = wordhash.mix(np.random.default_rng(0).integers(0, 2000, 5000).astype(np.uint64))
    part = sketch.PartialSketch(spec, held=1500)
    total = np.zeros((2, 1 << 10), int)
    for lo in range(0, 5000, 700):
        list(part.add(keys[lo : lo + 700]))
    for r in range(2):
        np.add.at(total[r], sketch.cells(keys, r, spec), 1)
    bitmap = np.stack([np.packbits(t >= 2, bitorder="little") for t in total])
    u, n = np.unique(keys, return_counts=True)
    assert sketch.passes(bitmap, u[n >= 2], spec).all()


# ---- decontamination


ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, "Short item here"), (3, None), (4, ""), (5, "word"), (None, "no id at all")]


def test_contamination_matches_brute_force(spark, docs, rows):
    extra = [(80, "x THE quick brown fox jumps over the lazy dog near the old river bank today y"), (81, "short, item... here! and short item here"), (82, "a word"), (83, "we have no id at all"), (84, "fox jumps over")]
    every = spark.createDataFrame(extra, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(every)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.scan(both, items, decontam.DecontamSpec(), Scratch(spark))
    want = by_id([*rows, *extra], [(n, h, tuple(i), h > 0 and 20 * h >= n) for n, h, i in brute.contamination([t for _, t in [*rows, *extra]], ITEMS)])
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()) == want
    joined = decontam.scan(both, items, decontam.DecontamSpec(broadcast_rows=0), Scratch(spark))
    assert collections.Counter((r["doc_id"], r["n_hit"]) for r in joined.collect()) == collections.Counter((r["doc_id"], r["n_hit"]) for r in got.collect())
    left = decontam.remove_documents(every, got)
    assert [r["doc_id"] for r in left.orderBy("doc_id").collect()] == [84]
    clean = {r["doc_id"]: r["clean_words"] for r in decontam.remove_spans(every, got).collect()}
    assert clean[81] == ["and"] and clean[80] == ["x", "y"] and clean[84] == ["fox", "jumps", "over"]


def test_contamination_of_nothing(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.scan(no_docs, items, decontam.DecontamSpec(), Scratch(spark)).count() == 0
    assert decontam.scan(docs, items.filter("1 = 0"), decontam.DecontamSpec(), Scratch(spark)).filter("n_hit > 0").count() == 0


# ---- lines


@pytest.mark.parametrize("kw", [{}, {"broadcast_keys": 0}, {"min_docs": 2, "shard_keys": 3}, {"min_docs": 2, "shard_keys": 2, "broadcast_keys": 4, "shard_lines": 5}])
def test_lines_match_brute_force(docs, rows, spark, kw):
    spec, scratch = line_dedup.LineSpec(**kw), Scratch(spark)
    got = line_dedup.drop_lines(docs, line_dedup.build(docs, spec, scratch), spec, scratch).collect()
    want = by_id(rows, brute.without_lines([t for _, t in rows], spec.min_docs, [d for d, _ in rows]))
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == want


def test_lines_count_documents_not_rows(spark):
    """A line in twelve rows of three documents, and in ten rows without id."""
    rows = [(i % 3, f"same line\nown {i}") for i in range(12)] + [(None, "other line")] * 10
    spec, scratch = line_dedup.LineSpec(), Scratch(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_lines(df, line_dedup.build(df, spec, scratch), spec, scratch)
    assert sorted(r["n_dropped"] for r in got.collect()) == [0] * 12 + [1] * 10


def test_filters_stay_in_the_plan_beyond_the_broadcast(docs, spark, monkeypatch):
    """However many keys there are, lines pass a cuckoo filter before they meet the counts."""
    asked = []
    old = line_dedup._by_filters
    monkeypatch.setattr(line_dedup, "_by_filters", lambda *a: asked.append(1) or old(*a))
    spec, scratch = line_dedup.LineSpec(min_docs=2, broadcast_keys=1, shard_keys=2), Scratch(spark)
    state = line_dedup.build(docs, spec, scratch)
    assert state.shards > 1 and state.filters.count() > 1
    line_dedup.drop_lines(docs, state, spec, scratch).count()
    assert asked
    # a filter that holds nothing lets no line through
    empty = state.filters.withColumn("filter", F.lit(bytes(512)))
    tag = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = docs.select(tag.alias("tag"), "text")
    whole = old(texts, state, line_dedup.to_drop(state.counts, spec), scratch, spec)
    none = old(texts, line_dedup.LineState(state.counts, empty, state.shards), line_dedup.to_drop(state.counts, spec), scratch, spec)
    assert whole.count() > 0 and none.count() == 0


def test_line_state_is_reversible(docs, no_docs, spark):
    spec, scratch = line_dedup.LineSpec(min_docs=3, shard_keys=2), Scratch(spark)
    some, more = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    before = line_dedup.build(some, spec, scratch)
    both = line_dedup.update(before, spec, scratch, inserted=more)
    after = line_dedup.update(both, spec, scratch, deleted=more)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(after.counts) == rows(before.counts)
    assert rows(both.counts) == rows(line_dedup.count_lines(docs.filter("doc_id IS NOT NULL"), scratch))
    keys = [r["h1"] for r in before.counts.filter("docs >= 3").collect()]
    filters = {r["shard"]: cuckoo.CuckooFilter.from_bytes(bytes(r["filter"])) for r in after.filters.collect()}
    assert keys and all(filters[h % after.shards].contains(np.array([h]))[0] for h in keys)
    a, b = (line_dedup.drop_lines(some, s, spec, scratch).select("doc_id", "kept_text") for s in (before, after))
    assert rows(a.fillna(-1)) == rows(b.fillna(-1))
    none = line_dedup.update(before, spec, scratch, inserted=no_docs)
    assert rows(none.counts) == rows(before.counts)
    assert line_dedup.drop_lines(no_docs, before, spec, scratch).count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    f = cuckoo.CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63, 5000)
    assert f.contains(others).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.02
    assert cuckoo.CuckooFilter.from_bytes(f.to_bytes()).contains(keys[2500:]).all()
    full = cuckoo.CuckooFilter(64)
    assert not full.insert(keys)
    tight = cuckoo.CuckooFilter(2048)
    assert tight.insert(keys) and tight.contains(keys).all() and 0.55 < (tight.table > 0).mean() < 0.62
    twice = cuckoo.CuckooFilter.sized(8)
    same = np.array([7, 7, 7, 9])
    assert twice.insert(same)
    twice.delete(np.array([7, 7]))
    assert twice.contains(same).all()
    twice.delete(np.array([7]))
    assert not twice.contains(np.array([7]))[0] and twice.contains(np.array([9]))[0]


# ---- licences


def test_licences(spark, docs, rows, no_docs):
    spec = license_scan.LicenseSpec()
    extra = [
        (90, "x\nLicensed under the Apache License, Version 2.0. cc by nc"), (91, "Under the MIT license; under the mit LICENSE"), (92, "This work is licensed under the GNU General Public License, version 3."),
        (93, "public license general gnu version"), (94, "under the mit licenses"), (95, "All rights reserved. Copyright"), (96, "Copyright all rights reserved"), (97, "under the\nmit\tlicense"),
    ]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = license_scan.scan(both, spec, Scratch(spark)).collect()
    want = collections.Counter()
    for d, t in [*rows, *extra]:
        w = brute.ALPHA.findall(brute.lower(t or ""))
        at = sorted((i, label) for p, label in spec.base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        want[(d, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[90] == ("apache-2,cc-by-nc", 1.0) and labels[91][0] == "mit" and labels[92] == ("gpl-3", 1.0) and labels[93] == ("", 0.0)
    assert labels[94] == ("", 0.0) and labels[96] == ("all-rights-reserved", 1.0) and labels[97][0] == "mit"
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan(no_docs, spec, Scratch(spark)).count() == 0


@pytest.mark.parametrize("every", [3, 1])
def test_licences_that_many_rows_carry(spark, every):
    """A third of the rows, or all of them, carry the same notice."""
    spec = license_scan.LicenseSpec()
    for label, notice in [(x, t) for x, t, _ in spec.templates if x in ("gpl-3", "bsd", "all-rights-reserved")]:
        texts = [(i, f"row {i} {notice} end" if i % every == 0 else f"row {i} of prose") for i in range(12)]
        got = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), spec, Scratch(spark)).collect()
        assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == {i: (label, 1.0) if i % every == 0 else ("", 0.0) for i, _ in texts}


def test_licences_next_to_each_other(spark):
    """Notices in pairs, one after many rarer licence words, and with words changed, against a plain comparison at every place."""
    spec = license_scan.LicenseSpec()
    notices = [t for _, t, _ in spec.templates]
    scattered = " ".join(f"{w} x{i}" for i, w in enumerate(license_scan.vocabulary(spec)))
    texts = [f"{a} and {b}" for a in notices for b in notices if a != b]
    texts += [f"{' '.join(f'w{i}' for i in range(20000))} {scattered} {a}" for a in notices[::3]]
    texts += [" ".join("x" if i == j else w for i, w in enumerate(a.split())) for a in notices for j in range(len(a.split()))]
    texts += ["license " * 300, scattered, notices[0] * 2]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spec, Scratch(spark)).collect()

    def found(words):
        out = {}
        for label, notice, phrases in spec.templates:
            want = notice.split()
            keys = {notice[: notice.index(p)].count(" ") + j for p in phrases for j in range(len(p.split()))}
            for at in range(len(words) - max(keys)):
                if words[at + max(keys)] == want[max(keys)] and all(words[at + i] == want[i] for i in keys):
                    n = sum(words[at + i] == w for i, w in enumerate(want) if at + i < len(words))
                    if n >= spec.coverage * len(want):
                        out[label] = max(out.get(label, 0), n / len(want))
        return out

    base = {r["doc_id"]: set(filter(None, r["base_labels"].split(","))) for r in got}
    want = {i: found(t.split()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["labels"] for r in got} == {i: ",".join(sorted(base[i] | set(w))) for i, w in want.items()}
    assert {r["doc_id"]: r["score"] for r in got} == {i: 1.0 if base[i] else max(w.values(), default=0.0) for i, w in want.items()}


@pytest.mark.parametrize("phrases", [[], ["b"], ["d e"], ["c d e"]])
def test_licence_anchors_lose_nothing(phrases):
    """Whichever words may be missing, as many anchors stand as are asked for."""
    import itertools

    spec, words = license_scan.LicenseSpec(), list("abcdefg")
    keys = license_scan._key_places(words, phrases)
    own, need = license_scan.anchors(words, keys, {w: i % 3 for i, w in enumerate(words)}, spec)
    assert need == spec.min_votes
    for gone in itertools.combinations(sorted(set(range(7)) - keys), 2):  # 5 of 7 is the least share beyond 70 %
        assert len(set(own) - set(gone)) >= need


# ---- shards


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 1000, 99991])
def test_permutation(n):
    got = sharding.permute(np.arange(n, dtype=np.uint64), n, 9)
    assert sorted(got.tolist()) == list(range(n))
    assert (sharding.invert(got.astype(np.uint64), n, 9) == np.arange(n)).all()
    if n > 100:
        assert (got != sharding.permute(np.arange(n, dtype=np.uint64), n, 10)).mean() > 0.9


def test_shards(docs, rows, no_docs, spark):
    got = sharding.shard(docs, 24, Scratch(spark)).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1
    place = sharding.permute(np.array([r["row_number"] for r in got], np.uint64), len(rows), 9)
    assert all(r["shard"] == p % 24 and r["slot"] == p // 24 for r, p in zip(got, place.tolist(), strict=True))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["shard"], r["slot"])
    again = sharding.shard(docs.repartition(7), 24, Scratch(spark)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shard(no_docs, 24, Scratch(spark)).count() == 0


def test_write_shards(spark, docs, rows, no_docs, tmp_path):
    placed = sharding.shard(docs, 4, Scratch(spark))
    sharding.write_shards(docs, placed, str(tmp_path / "out"), rows_per_file=5)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect()) == collections.Counter(rows)
    want = collections.Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in placed.collect())
    assert collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, r["shard"], r["slot"]) for r in got.collect()) == want
    assert set(docs.columns) - {"shard"} <= set(got.columns)
    sharding.write_shards(no_docs, sharding.shard(no_docs, 4, Scratch(spark)), str(tmp_path / "none"))


# ---- hashes


def test_word_hashes():
    texts = [b"one two  three", b"", b"one", b" TWO\tthree \xc3\xa9t\xc3\xa9", b"x" * 100]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, first, start, end = wordhash.hash_words(data, off, True)
    found = [[bytes(data[a:b]) for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert found == [t.split() for t in texts]
    flat = [w.lower() for t in texts for w in t.split()]
    assert len(set(h.tolist())) == len(set(flat)) and h[flat.index(b"one")] == h[3]
    long = wordhash.long_grams(np.tile(h, 6), 7)
    assert (long[: len(h)] == long[len(h) : 2 * len(h)]).all() and len(set(long[: len(h)].tolist())) == len(h)


def test_scratch_without_a_shared_folder_on_a_cluster():
    from unittest.mock import MagicMock

    from winlaw.llm.common import shared_dir

    far = MagicMock()
    far.sparkContext.getConf().get.return_value = None
    far.sparkContext.getCheckpointDir.return_value = None
    far.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError):
        shared_dir(far)


def test_forgotten_tables_are_gone(spark):
    s = Scratch(spark)
    a, b = s.keep(spark.range(3)), s.keep(spark.range(4))
    s.forget(a, spark.range(2))
    import os

    assert len([x for x in os.listdir(s.root.removeprefix("file:"))]) == 1 and b.count() == 4


def test_scratch_is_in_the_shared_folder(spark):
    s = Scratch(spark)
    kept = s.keep(spark.range(5).withColumn("x", F.lit(1)))
    assert kept.count() == 5 and s.root.startswith((spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()).rstrip("/"))
