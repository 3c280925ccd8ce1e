"""From raw documents to encoded training text: rules, classifier, near duplicates, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltgrain.llm.factorisation import keep_good
from voltgrain.llm.line_quality import keep_clean
from voltgrain.llm.mixing import mixed_documents
from voltgrain.llm.queries import MODEL
from voltgrain.llm.sentencepiece_codec import encode_documents
from voltgrain.llm.simhash_pivots import keep_one
from voltgrain.llm.store import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that fail the base figures or lose over half their words go."""
    return keep_clean(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.3 go. The machine learns from the labelled documents as they were before the rules, which leave hardly a bad one."""
    return keep_good(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mixture takes it."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, with the digests of ids and decoded text."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(MODEL), ids=False)


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("simhash near-dedup", near_dedup), ("mixing", mix_sources), ("sentencepiece", encode)]
#: SQL has no factorisation machine and no SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
