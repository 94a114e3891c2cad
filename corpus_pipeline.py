"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing
to target weights, packing. Each stage's result is written as Parquet in the
shared folder and read again by the next one; what a stage wrote beside it is
removed then.

Defined results: each stage's operator states how it treats nulls, empty and
long texts, ties, repeated rows and empty tables. Language ID keeps the
columns of its input, writes the predicted language into lang and drops documents
without letters and those that fit the languages learned clearly worse than the
model, and the documents with a lang, let expect; exact dedup keeps
one row of equal texts; of each group of near duplicates the document with the
smallest doc_id stays (rows without doc_id are never dropped there); mixing
repeats, drops or cuts documents to reach its targets; packing gives pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarix.llm import common, exact_dedup, language_id, mixing, ngram_join, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned stay, with it as their lang."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    name, fit = common.fresh(docs, "lang_pred"), common.fresh(docs, "lang_fit")
    found = common.landed(language_id.predict(docs, model, fit_out=fit), "language-fits")
    limit = language_id.worst_fit(found.filter("lang IS NOT NULL"), fit, model)
    stays = (F.col(name) != "und") & (F.col(fit) >= limit)
    return found.filter(stays).select(*[(F.col(name) if c == "lang" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.ExactDedup(docs).kept_documents()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.NgramJaccardJoin(docs).components()
    dropped = found.filter("id <> component").select(F.col("id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mixture(docs, whole=True).documents()


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).withColumnRenamed("document_id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: Language ID is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, mark = docs, common.marked()
        docs = common.landed_alone(stage(spark, before, sf_dir), f"pipeline-{name}", mark)
        common.discard(before)
    return docs
