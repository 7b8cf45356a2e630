"""The corpus pipeline: five stages from documents to token ids on disk.

STAGES lists (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame; each stage is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.llm import decontam, jaccard, langid, mixing, tokens
from laminar.llm.common import scratch_path, table, written
from laminar.llm.queries import vocabulary
from laminar.ship import shipped

#: Near duplicates of the stage: words of a shingle, and the least similarity in percent.
WORDS, SIMILAR = 5, 80


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    told = langid.judged(docs)
    return told.where(F.col(f"{told.columns[-1]}.accepted")).select(*docs.columns)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return jaccard.one_of_each(docs, WORDS, SIMILAR)


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@shipped
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their target shares."""
    return mixing.sampled(docs)


@shipped
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the written files, how many there are, and their checksum."""
    path = scratch_path(spark, "pipeline-ids")
    tokens.write_orc(docs, path, vocabulary())
    return tokens.read_orc(spark, path)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_ids", token_ids),
]

#: Language models, similarity classes and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", F.col("start"), "n_tokens", "ids_crc32")
