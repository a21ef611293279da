"""The corpus pipeline: quality, toxicity, line dedup, near-dedup, packing; each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlane.llm import line_dedup, near_dedup, packing, passage_dedup, quality, toxicity
from paperlane.llm.graph import alone, removed, shared_dir, stored
from paperlane.llm.queries import table, tokenizer_path

#: The similarity, in percent, from which the near-duplicate stage links two texts.
NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier doesn't reject, unchanged.

    Null and empty texts have the score of the model's bias. Each of several equal rows is judged on its own, alike; rows without an id too.
    """
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity classifier doesn't reject, unchanged; nulls, empties and repeated rows as in keep_good."""
    return toxicity.keep_clean(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_clean_and_classed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of keep_clean() with copy_of: the document of their class that stays, for those that near_copies() has, else null.

    What links documents runs in Python, so the next stage, which is of DataFrame operations only, finds the classes in the table that this one writes.
    """
    clean = stored(keep_clean(spark, docs, sf_dir))
    return clean.join(alone(spark, lambda: near_copies(clean)).withColumnRenamed("of", "copy_of"), "doc_id", "left").select(*clean.columns, "copy_of")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that stand earlier in the corpus, inside lines or across them, and without the chunks of lines of op6_line_dedup.

    Passages come first: of a run of lines, op6's chunks leave the ends, which alone would be too short for a passage.
    The classes that the next stage will link are known first, from copy_of, which is taken off, or found here: what a class shares is left
    to that stage, what others had before is cut from all of the class alike. Null and empty texts and rows without an id stay as they are; rows with the same id and text are cut
    alike; a text all of which stands earlier becomes empty.
    """
    if "copy_of" in docs.columns:
        copies = docs.where("copy_of is not null").select("doc_id", F.col("copy_of").alias("of")).distinct()
        docs = docs.drop("copy_of")
    else:
        copies = alone(spark, lambda: near_copies(docs))
    cut = alone(spark, lambda: passage_dedup.dedup_passages(docs, copies=copies))
    return line_dedup.dedup_lines(cut, copies=copies).select(docs.columns)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, of): the documents that near-duplicate detection drops, and the one of their class that stays.

    Rows without an id take no part. Rows that share an id are one document, which goes if the text of each of them does.
    """
    classes = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT).where("doc_id is not null").groupBy("doc_id")
    return classes.agg(F.max("component_id").alias("of"), F.bool_or("kept").alias("kept")).where("not kept").select("doc_id", "of")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a similarity of 0.8 or more: that with the smallest id.

    Rows without an id stay. Rows that share an id are one document, and stay if the text of any of them does.
    """
    return docs.join(alone(spark, lambda: near_copies(docs)), "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: every row's, null and empty texts being the end id alone, rows without an id with a null doc_id."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False, with_crc=True)


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_clean_and_classed),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Learned scores and a public tokenizer's merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is a Parquet table in the shared folder, so a lost executor costs a stage's tasks only.

    A stage's table is deleted when the next one's is written; the last one's, which the result reads, stays.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs
