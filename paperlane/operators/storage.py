"""Tables of documents in hash buckets: a change rewrites the buckets of the documents that change, and nothing else."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.hash(doc_id.cast("string")), F.lit(buckets)).cast("int")


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return bool(files.exists(place))


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, by name; nothing, if there is none."""
    files, place = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def move(spark: SparkSession, path: str, to: str) -> None:
    """Puts a folder in the place of another one, if that is there."""
    files, place = _at(spark, path)
    target = _at(spark, to)[1]
    files.delete(target, True)
    files.mkdirs(target.getParent())
    if not files.rename(place, target):
        raise OSError(f"{path} could not be moved to {to}")


def touch(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.create(place, True).close()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's own checkpoint folder; a temporary one for local sessions alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and found.isDefined():
        return found.get()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def staged(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows as a table at path; if a whole one is there, from an earlier try, that one."""
    if not exists(spark, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def replace_documents(spark: SparkSession, table: str, rows: DataFrame, changed: DataFrame, buckets: int = 64, step: str | None = None) -> None:
    """Puts rows (doc_id, …) in for all that the Parquet table in a folder holds of the documents in changed (doc_id).

    The table is partitioned by bucket, a hash of doc_id; the buckets of changed documents are written anew, the others aren't read. Documents in
    changed without rows are gone afterwards. What the buckets will hold is first staged whole beside the table; a try that is
    repeated with the same step after a failure finds it there and only puts it in place, so nothing is read from a bucket that is
    half replaced. A step that is repeated after it was done gives the same table.
    """
    changed = changed.select("doc_id").distinct()
    touched = [r[0] for r in changed.select(bucket_of(F.col("doc_id"), buckets).alias("b")).distinct().collect()]  # buckets at most
    fresh = rows.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    if exists(spark, table):
        held = spark.read.schema(fresh.schema).parquet(table).where(F.col("bucket").isin(touched))
        fresh = fresh.unionByName(held.join(changed, "doc_id", "left_anti").select(fresh.columns))
    stage = f"{table.rstrip('/')}-staged/{step or uuid.uuid4().hex}"
    ready = staged(spark, stage, fresh)
    left = {r[0] for r in ready.select("bucket").distinct().collect()}
    ready.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    for b in set(touched) - left:
        remove(spark, f"{table}/bucket={b}")
    remove(spark, stage)


def read_documents(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of a table that replace_documents() writes; schema without bucket. None before the first write."""
    if not exists(spark, table):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, bucket int").parquet(table).drop("bucket")
