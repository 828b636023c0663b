"""Documents to training sequences: quality, line dedup, near duplicates, decontamination, packing.

Each stage is (name, function of (spark, docs, sf_dir)) and gets what the one before kept,
read again from Parquet. All but the last return the columns that docs has, documents' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winlaw.llm import decontam, line_dedup, ngram_join, ordinal, packing
from winlaw.llm.common import Scratch, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, grades as good; a document without text isn't."""
    small_batches(spark)
    spec = ordinal.OrdinalSpec()
    model = ordinal.fit(docs, ordinal.grades_of(table(spark, sf_dir, "labels")), spec)
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # own columns of any name stay beside the model's
    scored = ordinal.score(own, model, spec, text_col=f"c{docs.columns.index('text')}").filter("keep")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten or more of them; n_chars follows the text. One left without lines stays, empty."""
    spec, scratch = line_dedup.LineSpec(), Scratch(spark)
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("text")
    state = line_dedup.build(own, spec, scratch, f"c{at}", f"c{docs.columns.index('doc_id')}")
    kept = line_dedup.drop_lines(own, state, spec, scratch, f"c{at}")

    def column(i: int, name: str):
        if i == at:
            return F.when(F.col(f"c{i}").isNotNull(), F.col("kept_text")).alias(name)
        if name == "n_chars":
            changed = F.col("n_dropped") > 0
            return F.when(changed, F.length("kept_text").cast(docs.schema[name].dataType)).otherwise(F.col(f"c{i}")).alias(name)
        return F.col(f"c{i}").alias(name)

    return kept.select(*[column(i, c) for i, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that similarity links. Null or empty texts and texts without words
    stay; rows that repeat the one that stays stay too; of rows without id those stay whose group has no id; no rows give none."""
    return ngram_join.keep_one(docs, ngram_join.JoinSpec(), Scratch(spark))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in passages of the benchmark. Null or empty texts stay, as they have no
    words; repeated rows share their fate; an empty benchmark takes none away."""
    scanned = decontam.scan(docs, table(spark, sf_dir, "benchmark"), decontam.DecontamSpec(), Scratch(spark))
    return decontam.remove_documents(docs, scanned)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 4096 tokens. A null or empty text is its end mark alone, a long one
    is cut; repeated rows are packed each; no documents give no pieces."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, packing.PackSpec(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the model nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
