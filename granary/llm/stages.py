"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage passes on all columns of its input as they are, extra ones too; the last adds each row's place in the mix. Empty
tables give empty tables; null texts and ids are kept unless a stage's operator says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import shared_dir, table
from granary.llm.decontaminate import decontaminate
from granary.llm.mixing import mix
from granary.llm.near import keep_one
from granary.llm.quality import fit_quality, score_quality
from granary.llm.substrings import dedup_substrings
from granary.sources.shared import delete, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores at 0.3 or more."""
    ship_package(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, "_quality").where("_quality >= 0.3").drop("_quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with 5-word Jaccard similarity 0.8 or more."""
    ship_package(spark)
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; n_chars follows the text, and texts cut to nothing go."""
    ship_package(spark)
    kept = dedup_substrings(docs, details=("_words", "_removed", "_sha")).where("NOT (_removed > 0 AND _removed = _words)")
    return kept.selectExpr(*["CASE WHEN _removed > 0 THEN length(text) ELSE n_chars END AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words are in benchmark windows."""
    ship_package(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, texts and all, with its place in the mix (source_row, block, slot, position)."""
    return mix(docs, keep=True)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", benchmark_free),
    ("mixing", mixed),
]

#: A trained classifier and hash orders stand in these stages: SQL can't express them; the tests check each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """The last stage's rows. Stages are written below ``out`` (else a new folder below the shared one); a stage's folder goes
    once the next one is written, so the last one's is what stays."""
    docs = table(spark, sf_dir, "documents")
    top, old = out or shared_dir(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if old:
            delete(spark, old)
        old = f"{top}/{name}"
    return docs
