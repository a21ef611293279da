"""What the two classifiers share: the bounded sample of labelled texts, and scoring as a Spark job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytetext import chunks
from .subword import Model

#: A classifier is fitted to so many labelled rows at most, chosen by a hash of their id, and to so many characters of text.
TRAIN_ROWS, TRAIN_CHARS = 4_000, 20_000_000


def held_out(folds: int, fold: int):
    """True for the rows whose crc32(doc_id as text) mod folds is fold; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, labels) of at most TRAIN_ROWS labelled rows that aren't held out.

    Of several labels of an id the largest counts; null labels are left out; of several texts of an id the least. A text that
    doesn't fit into what is left of TRAIN_CHARS, in order of the hash, is passed over. The bound keeps the sample
    a few tens of MB at any size of the corpus, so the driver can hold it.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(~held_out(folds, fold)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    # which texts fit is found from their sizes; the texts themselves come only then
    sizes = texts.select("doc_id", "h", "y", F.length("text").alias("n"), F.xxhash64("text").alias("v")).groupBy("doc_id", "h", "y").agg(F.min(F.struct("n", "v")).alias("t"))
    fit, left = [], TRAIN_CHARS
    for r in sizes.select("doc_id", "y", "t.*").orderBy("h", "doc_id").collect():  # TRAIN_ROWS rows at most
        if r.n <= left:
            fit.append((r.doc_id, r.n, r.v, len(fit), r.y))
            left -= r.n
    wanted = docs.sparkSession.createDataFrame(fit, "doc_id long, n int, v long, place int, y int")
    rows = texts.select("doc_id", "text", F.length("text").alias("n"), F.xxhash64("text").alias("v")).join(F.broadcast(wanted), ["doc_id", "n", "v"]).dropDuplicates(["doc_id"]).select("place", "text", "y").toPandas().sort_values("place")
    encoded = [t.encode() for t in rows["text"]]
    at = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
    return np.frombuffer(b"".join(encoded), np.uint8), at, rows["y"].to_numpy(np.int64)


def slices(raw: np.ndarray, at: np.ndarray, size: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """The sample in slices of about size bytes (bytes, offsets, numbers of its texts), to hold only one slice's words at a time."""
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield raw[at[i] : at[j]], at[i : j + 1] - at[i], slice(i, j)
        i = j


def score(docs: DataFrame, model: Model, score_chunk: Callable, folds: int, fold: int, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; the model goes to the tasks as a broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in chunks(batches):
            logits = score_chunk(shared.value, raw, at)
            p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, score_chunk: Callable, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, whose probability is wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in chunks(batches):
            p = 1 / (1 + np.exp(-np.clip(score_chunk(shared.value, raw, at), -500, 500)))
            yield rows.filter(pa.array(wanted(p)))

    return docs.mapInArrow(run, docs.schema)
