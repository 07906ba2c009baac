"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm import chosenpath, decontam, langid, packing, surrogates
from lumenark.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those in which no language reaches a probability of 0.4."""
    return langid.keep_known(docs, langid.train(langid.training_rows(docs)), min_score=0.4)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents joined by five-word shingles at a Jaccard similarity of 0.8 or more, the one of least id stays."""
    return chosenpath.first_of_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark windows in a twentieth of their words."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def surrogate_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; ``n_chars`` follows the text."""
    out = surrogates.pseudonymise(docs, key="documents-2024")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", decontaminate),
    ("pii_surrogates", surrogate_pii),
    ("best_fit_packing", pack),
]

#: Model training, similarity joins and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and reread."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
