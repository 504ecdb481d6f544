"""Cleaning a corpus for training: toxic documents, near duplicates, benchmark passages and personal data go, then texts become token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import bpe, decontaminate, jaccard, pii, toxicity
from lineloom.llm.common import shared_dir, table
from lineloom.llm.queries import KEY, tokenizer

#: The columns that all stages but the last hand on.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model is learned from the labelled rows of docs that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs.select(*COLUMNS), model, score_col="__score").filter("__score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more of five-word shingles the one with the smallest id stays."""
    return jaccard.deduplicate(docs.select(*COLUMNS), width=5, num=8, den=10)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items or more go; from others every passage of an item goes."""
    kept = decontaminate.remove(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(docs.select(*COLUMNS), KEY).withColumn("n_chars", F.length("text").cast("long"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids: the text as token ids."""
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, offsets_col=None)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_texts),
    ("personal_data", replace_personal_data),
    ("byte_bpe", encode_texts),
]
#: A learned score and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
