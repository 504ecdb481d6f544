"""Queries of the training-data operators over their whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cotrain, decontaminate, jaccard, pii, rans, topk, toxicity, warc
from .common import table


#: The secret of the surrogates; a production run passes its own.
KEY = "example-key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(table(spark, sf_dir, "documents"), KEY, count_col="mentions")
    return done.select("doc_id", "text", *[F.col("mentions")[t].alias(f"n_{t}") for t in pii.TYPES])


def op2_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    scored = cotrain.co_train(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text_odds", "meta_odds", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the pages' archive against a replica that is damaged by rule."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = warc.audit(warc.tree(pages, "one"), warc.tree(warc.damaged(pages), "two"))
    return found.withColumnRenamed("id", "page_id")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies, on the driver and on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def joined_sha256(ids: str) -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, offsets_col=None).drop("text")
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined_sha256("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "class_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat.rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["stop"] - m["start"])
    return shown.select(F.col("conv").alias("conv_id"), "perspective", "segment", F.coalesce("part.turn", F.lit(-1).cast("long")).alias("part_turn"), F.col("part.bucket").alias("part_bucket"), "n_turns", F.sha2("text", 256).alias("text_sha256"), F.sha2(F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["stop"])), ","), 256).alias("mask_sha256"), F.size("mask").cast("long").alias("n_masks"), masked.alias("masked_chars"))


def op10_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = rans.new_folder(spark)
    rans.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), folder)
    return rans.checksums(spark, folder).withColumnRenamed("doc", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op5_merkle_audit": warc.ORACLE_SQL, "op9_perspective_rotation": chat.ORACLE_SQL, "op3_exact_top_k": topk.ORACLE_SQL, "op4_decontaminate": decontaminate.ORACLE_SQL}
