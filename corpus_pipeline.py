"""Raw documents to training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.  Null and empty texts pass every stage but the
near-duplicate one, which keeps one of them; rows with a null id are never
duplicates; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.llm import bpe, decontam, nearcopies, secrets, toxicity
from cellmill.llm.queries import VOCABULARY, held_out, table
from cellmill.llm.scratch import new_dir, written


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.7."""
    model = toxicity.fitted(docs.where(~held_out("doc_id", 3, 1)), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, into="__toxicity").where("__toxicity.score < 0.7").drop("__toxicity")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: those
    that share four fifths of their five-word shingles."""
    return nearcopies.representatives(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item overlaps."""
    return docs.where(~decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by its kind."""
    return docs.withColumn("text", secrets.redacted(F.col("text"))).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every document, and the text decoded from the ids."""
    done = bpe.tokenised(docs.select("doc_id", "text"), VOCABULARY)
    return done.select("doc_id", "tokens.ids", F.size("tokens.ids").cast("long").alias("n_tokens"), "tokens.decoded")


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", free_of_benchmarks),
    ("secrets", without_secrets),
    ("token_ids", token_ids),
]

#: Learned models and iterated links have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", new_dir(spark, f"stage-{name}"))
    return docs
