"""The ten corpus queries over the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.llm import caps, decontam, jaccard, langid, lines, mixing, quality, substring, tokens
from laminar.llm.common import scratch_path, table
from laminar.ship import shipped

QUERIES: dict = {}
ORACLES: dict = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files lie on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = shipped(f)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary())


@query("op8_token_ids_orc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    tokens.write_orc(table(spark, sf_dir, "documents"), path, vocabulary())
    return tokens.read_orc(spark, path)


@query("op2_mix_by_raking", mixing.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.drawn(table(spark, sf_dir, "documents"))
    mix = found.columns[-1]
    parts = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")]
    numbers = [F.round(f"{mix}.{c}", 6).alias(c) for c in ("weight", "probability", "repeats")]
    return found.select("doc_id", *parts, F.col(f"{mix}.topic").alias("topic"), F.col(f"{mix}.tokens").alias("n_tokens"), *numbers, F.col(f"{mix}.kept").alias("kept"))


@query("op5_quality_cotraining")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_verdict(found))


@query("op6_pages_language")
def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over raw pages, where markup declares the language and the address gives host and suffix."""
    found = langid.judged(langid.of_pages(table(spark, sf_dir, "pages")))
    return found.select("page_id", F.col("lang").alias("declared"), *_verdict(found))


def _verdict(found: DataFrame) -> list:
    said = {"language": "lang", "posterior": "posterior", "n_grams": "grams", "kept": "accepted"}
    return [F.col(f"{found.columns[-1]}.{field}").alias(name) for name, field in said.items()]


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_line_dedup", lines.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_ngram_jaccard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


@query("op4_embedding_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.linked(table(spark, sf_dir, "embeddings"))
