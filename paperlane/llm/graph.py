"""Shared tables, joins on hot keys, and connected components, as Spark jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key is hot if it has more rows than this, and more than one in HOT_KEYS of all; so there are at most HOT_KEYS hot keys, whatever the data.
HOT_ROWS, HOT_KEYS = 64, 10_000

#: What settle() and stored() have written, for each alone() that is at work.
_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's own checkpoint folder.

    Where neither is set a temporary folder serves a local session, as in tests; on a cluster it would be another one on
    every machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    if _written:
        file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            _written[-1].append(file.get())
    return out


def stored(df: DataFrame) -> DataFrame:
    """As settle(), but as a Parquet table: compact, and read by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """stored(make()); the tables that make() has put into the shared folder on its way are deleted, whether it succeeds or not."""
    made: list[str] = []
    _written.append(made)
    try:
        df = make()
        _written.pop()
        return stored(df)
    finally:
        if _written and _written[-1] is made:
            _written.pop()
        for path in made:
            removed(spark, path)


def join_counted(many: DataFrame, one: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """many joined (inner or left) with one, which has a row for each of keys and in _n how many rows of many have it, of total.

    The adaptive plan doesn't split a hot key where an aggregate stands below the join. So the few hot keys, whose number is bounded
    whatever the data, are joined by broadcast where many's rows are; all other keys have a bounded share of the rows.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(one.where(F.col("_n") > bound))
    names = hot.select(*keys)
    some = many.join(hot.drop("_n"), keys)
    rest = many.join(F.broadcast(names), keys, "left_anti").join(one.where(F.col("_n") <= bound).drop("_n"), keys, how)
    return some.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long): root is the smallest node reachable.

    Alternating large and small stars: each round links a node's larger neighbours, then its
    smaller ones, to the least of its neighbours, until the links are stars. A round costs two
    aggregations, partial before the shuffle, and joins on the links, of which there are never more than at first.
    """
    links = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while True:
        total = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == was or not total[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        was = tuple(total)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("_n"))
        large = join_counted(both.where("b > a"), least, ["a"], total[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        small = join_counted(large, least, ["a"], total[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        links = settle(small.where("a <> b").distinct())
