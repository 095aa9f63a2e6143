"""A training corpus from documents: toxic texts go, near copies go, repeated passages go, sources are mixed, sequences packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard, mixing, packing, substring, toxicity
from loomwork.llm._common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer does not reject; null and empty texts and null ids are scored and kept like others,
    repeated rows each, extra columns pass, no rows give none."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep_text=True)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest doc_id (a null id only where no other is); of
    repeated rows one. Texts without words are groups of their own; extra columns pass, no rows give none."""
    return jaccard.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that start in an earlier document; others keep their texts as they are, as
    do null ids and null or empty texts. Rows with one id never cut each other; extra columns pass, no rows give none."""
    done = substring.dedup(docs, respace=False)
    done = done.withColumn("text", F.col("kept_text"))
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; a null source is a source, texts without words have size 0, repeated rows
    are taken each, extra columns pass, no rows give none."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens; null and empty texts are the closing id alone,
    repeated rows and null ids are packed like others, extra columns go, no rows give none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained scores and tokenizers are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
