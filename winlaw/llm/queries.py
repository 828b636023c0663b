"""The corpus operators as registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, license_scan, line_dedup, media, ngram_join, ordinal, packing, sharding, substring_dedup
from .common import Scratch, small_batches, table
from .sql import ORACLES


def op1_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackSpec(public_tokenizers.path("word_bpe_49k.json")))


def op2_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold the template's own marks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    small_batches(spark)
    marks = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn int, role string, text string")
    return chat.format_digests(rows.unionByName(own))


def op3_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents"), ngram_join.JoinSpec(), Scratch(spark))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their grade; keep is false for those that a corpus should do without."""
    docs, spec = table(spark, sf_dir, "documents").select("doc_id", "text"), ordinal.OrdinalSpec()
    small_batches(spark)
    model = ordinal.fit(docs, ordinal.grades_of(table(spark, sf_dir, "labels")), spec)
    return ordinal.score(docs, model, spec).drop("text")


def op5_sketched_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), substring_dedup.SubstringSpec(), Scratch(spark))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), decontam.DecontamSpec(), Scratch(spark))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spec, scratch = table(spark, sf_dir, "documents").select("doc_id", "text"), line_dedup.LineSpec(), Scratch(spark)
    out = line_dedup.drop_lines(docs, line_dedup.build(docs, spec, scratch), spec, scratch)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.LicenseSpec(), Scratch(spark))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24, Scratch(spark))


def op10_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return media.store(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cost_packing": op1_cost_packing,
    "op2_chat_template": op2_chat_template,
    "op3_grouped_prefix_join": op3_grouped_prefix_join,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_sketched_substrings": op5_sketched_substrings,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_feistel_shards": op9_feistel_shards,
    "op10_lossless_webp": op10_lossless_webp,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
