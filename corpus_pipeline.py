"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Every stage takes the columns of ``documents``; all but the last give them back. Rows with a null or
empty text are dropped by the quality rules (they have no words). Equal and repeated rows go as one
near-duplicate group, whatever their ids are; null and repeated ids name nothing. Very long texts are
scored, judged, masked and packed whole. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm import bpe, packing, pii, rules, simhash, toxicity
from digestry.llm.common import fresh, save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity model scores below its threshold. Null and empty texts have
    no words and are scored as such; without labels of both classes all documents score alike."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "_toxicity")
    scored = toxicity.score(docs, "text", model, name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules; null and empty texts do not."""
    name = fresh(docs, "_quality")
    return rules.judge(docs, "text", name).where(F.col(f"{name}.kept")).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: that of the least id, null ids last. Documents
    without words are one group."""
    return simhash.keep_first(docs, "doc_id", "text")


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of each personal span in its place; a null text stays null."""
    masked = pii.redact(docs, "text")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, as pieces of documents."""
    vocabulary = bpe.share_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(docs, "doc_id", "text", vocabulary)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("simhash", drop_near_copies),
    ("pii", mask_personal),
    ("packing", pack),
]

#: The toxicity model and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
