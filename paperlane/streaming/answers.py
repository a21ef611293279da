"""Answers as streams of pieces: an append stream into a table that takes a repeated batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import pieces_of, whole_answers

PIECES = "stream_id string, seq long, text string, last boolean"


def put_pieces(batch: DataFrame, epoch: int, table: str) -> None:
    """Writes a batch of pieces as the partition of its epoch: the same epoch again replaces it, whole."""
    rows = batch.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in PIECES.split(", ")]).withColumn("epoch", F.lit(epoch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(table)


def write_pieces(lines: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the pieces of a stream of lines (stream_id, seq, line) to table, as they come; a batch that is repeated after a failure replaces its own."""
    return pieces_of(lines).writeStream.foreachBatch(lambda batch, epoch: put_pieces(batch, epoch, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_answers(spark: SparkSession, table: str) -> DataFrame:
    """(stream_id, text, ended): the answers so far. A line that came in two batches counts once."""
    return whole_answers(spark.read.schema(f"{PIECES}, epoch long").parquet(table).drop("epoch"))
