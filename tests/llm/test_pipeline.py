import random

import pytest

import corpus_pipeline
from winlaw.llm import ordinal
from winlaw.llm.common import table

from . import brute
from .conftest import prose

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, where = random.Random(8), str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    item = prose(rng, 40)
    line = "Share this page with your friends"
    for i in range(260):
        w = prose(rng, rng.randrange(40, 120)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = "vile"
        text = " ".join(w)
        if i % 7 == 1:
            text += f"\n{line}\n" + prose(rng, 20)
        if i % 11 == 2:
            text += " " + item
        docs.append((i, text, "en", "s"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    for i in range(260, 280):
        docs.append((i, docs[i - 257][1] + " end", "en", "s"))
    docs += [(300, None, None, None), (301, "", "en", "s"), (None, docs[3][1], "en", "s"), (7, docs[7][1], "en", "s")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows.selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars").repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    columns, out = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = sorted((tuple(r) for r in docs.collect()), key=str)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == columns
    kept = [(r[0], r[1]) for r in out["quality_classifier"]]
    assert {d for d, _ in kept if d is not None} & {i for i in range(0, 260, 5)} == set()
    clean = [i for i in range(260) if i % 5]
    assert len({d for d, _ in kept} & set(clean)) > 0.9 * len(clean)

    lines = brute.without_lines([t for _, t in kept], ids=[d for d, _ in kept])
    deduped = [(d, k if t is not None else None) for (d, t), (_, _, k) in zip(kept, lines, strict=True)]
    assert sorted(((r[0], r[1]) for r in out["line_dedup"]), key=str) == sorted(deduped, key=str)
    assert all(r[4] == len(r[1]) for r in out["line_dedup"] if r[1] is not None)

    comp = brute.components(deduped)
    single = [(d, t) for (d, t), (n, c) in zip(deduped, comp, strict=True) if not n or c == d or c is None]
    assert sorted(((r[0], r[1]) for r in out["ngram_jaccard_join"]), key=str) == sorted(single, key=str)

    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    hits = brute.contamination([t for _, t in single], items)
    left = [(d, t) for (d, t), (n, h, _) in zip(single, hits, strict=True) if not (h and 20 * h >= n)]
    assert sorted(((r[0], r[1]) for r in out["benchmark_decontamination"]), key=str) == sorted(left, key=str)
    assert len(left) < len(single) < len(deduped)
    ids = sorted({r[0] for r in out["packing"]}, key=str)
    assert ids == sorted({d for d, _ in left}, key=str)


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_columns_that_clash(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("*", "'own' AS keep", "1 AS kept_text", "2 AS n_lines", "'x' AS tail_probability")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_empty_documents(spark, folder):
    docs = table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_grades(spark):
    rows = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in ordinal.grades_of(rows).collect()} == {1: 0, 2: 1, 3: 2, 4: None}
