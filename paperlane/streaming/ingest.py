"""Continuous ingest: a stream of text files, tidied and cut to passages; a table holds the last version of each document, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.passages import passages
from ..operators.storage import read_documents, replace_documents
from ..sources.readers import decode_text, sniff, text_parts

PASSAGES = "doc_id string, passage_idx int, number int, label string, text string"


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (doc_id, added, text) of the text files that appear in folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("added"), "content")
    return named.where(sniff(F.col("name"), F.col("content")) == "text").select(F.substring(F.sha2("name", 256), 1, 16).alias("doc_id"), "added", decode_text(F.col("content")).alias("text"))


def put_documents(batch: DataFrame, epoch: int, table: str, buckets: int = 64) -> None:
    """Puts a batch of documents (doc_id, added, text) in for what table holds of them: an upsert of the buckets that they are in.

    Of a document that comes twice the last added counts. The epoch again, after a failure or after it was done, gives the same table.
    """
    newest = batch.groupBy("doc_id").agg(F.max_by("text", F.struct("added", "text")).alias("text"))
    rows = passages(text_parts(newest)).selectExpr("doc_id", "passage_idx", "cast(number AS int) AS number", "label", "text")
    replace_documents(batch.sparkSession, table, rows, newest.select("doc_id"), buckets, f"epoch-{epoch}")


def ingest(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps table, the passages of the last version of each document, up to date with a stream of documents (doc_id, added, text).

    The table is partitioned by a hash of the document; a batch rewrites the buckets of its documents, so a read is a plain read.
    """
    return stream.writeStream.foreachBatch(lambda batch, epoch: put_documents(batch, epoch, table, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The passages of each document's last version in an ingested table."""
    return read_documents(spark, table, PASSAGES)
