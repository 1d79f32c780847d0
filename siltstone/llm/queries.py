"""The registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import decontam, hamming, infill, lines, mixing, near_dup, negatives, pii, quality, secrets, sharding, substring, toxicity
from siltstone.llm.common import held_out, settle, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.label(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    items = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), drop_text=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As quality.classify, but the statistics, small beside the texts, are written once for fit and scores."""
    known = settle(quality.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True), "statistics")
    labels = quality.training_labels(table(spark, sf_dir, "labels"), "quality")
    model = quality.fit(known.join(labels, "doc_id"), "quality")
    scored = known.withColumn("score", model.score(F.col("statistics")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    base = F.filter("secrets", lambda s: s["layers"] == "")
    count = lambda kind: F.size(F.filter("secrets", lambda s: (s["layers"] == "") & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    hidden = F.size(F.filter("secrets", lambda s: s["layers"] != "")).cast("bigint").alias("n_hidden")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("secrets")).alias("spans"), hidden)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True, digests=True)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_top_k,
        op3_pii,
        op4_mix_sources,
        op5_near_dup,
        op6_decontaminate,
        op7_toxicity,
        op8_shard,
        op9_substring_dedup,
        op10_quality,
        op11_secrets,
        op12_fill_in_middle,
        op13_hard_negatives,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op1_line_dedup": lines.SQL,
    "op2_top_k": hamming.SQL,
    "op4_mix_sources": mixing.SQL,
    "op6_decontaminate": decontam.SQL,
    "op8_shard": sharding.sql(),
    "op9_substring_dedup": substring.SQL,
    "op12_fill_in_middle": infill.SQL,
    "op13_hard_negatives": negatives.SQL,
}
