"""The corpus pipeline: toxicity, quality rules, near-duplicates, benchmark decontamination, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ibidem.llm import decontaminate, packing, quality, simhash, toxicity
from ibidem.llm.common import materialize, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay. The field learns from labelled documents among docs."""
    found = toxicity.train(docs, table(spark, sf_dir, "labels"))
    others = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col("text"))
    kept = toxicity.tag(inner, found).where(F.col("score") < toxicity.THRESHOLD)
    return kept.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source stay."""
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least doc_id."""
    return simhash.deduplicate(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", remove_toxic), ("quality", quality_rules), ("near_dedup", near_dedup), ("decontamination", remove_leaks), ("packing", pack)]

#: Fingerprints, fitted models and token ids aren't expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
