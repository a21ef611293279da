"""Approximate nearest neighbours by a permutation index.

Pivots stand around the mean of the vectors, at both ends of the axes of random orthonormal frames. A vector is
represented by the order of its nearest pivots, half of all. A block of vectors posts each vector in the inverted
file of each of these pivots, with what the pivot's place in its order is worth; as half of the vectors are in a file,
it is stored by row, absent ones as 0. A query adds up, over the files of its own nearest pivots, what each posting
saves of the footrule distance between the two orders. As nearness is the inner product, whatever the lengths, what a
vector saves beyond the block's mean counts by its length. The vectors first by that are ranked by their exact inner product.

Frames are exact in one respect in which single vectors aren't: the products with a frame's axes hold all of a vector, so
the orders lose only what ranks lose. Hence a few hundred pivots and a rerank of few vectors do.

Equal vectors are one in the index, with the least ids that a result can hold. Every vector is indexed. Vectors are dealt
into blocks by their hash and the queries, a stated set, into blocks of their own; a task has one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bytetext import group_starts, groups
from .graph import stored
from .metric_join import _rows, _unit, usable

#: There are at least so many pivots; in high dimensions as many as one frame has.
PIVOTS = 240
#: Vectors whose mean is the middle of the pivots, drawn by a hash.
SAMPLE = 2000
#: Of a block, this share and so many for each result are ranked exactly.
SHARE, EACH = 0.03, 2
BLOCK, QUERY_BLOCK = 8192, 8192
#: Parts in which the ids of one vector are first cut to the least, so that no task reads all of them.
PARTS = 64


def frames(dim: int, pivots: int = PIVOTS, seed: int = 5) -> np.ndarray:
    """Unit axes, each with its opposite, of as many random orthonormal frames as make so many pivots."""
    r = np.random.default_rng(seed)
    axes = [np.linalg.qr(r.normal(size=(dim, dim)))[0].T for _ in range(-(-pivots // (2 * dim)))]
    return np.concatenate([x for a in axes for x in (a, -a)])


def files(products: np.ndarray) -> np.ndarray:
    """By pivot, what each row's posting is worth: the number of the order's places from its own on; 0 for the farther half of the pivots."""
    n, pivots = products.shape
    length = pivots // 2
    worth = np.zeros((pivots, n), np.int16)
    order = np.argsort(-products, axis=1, kind="stable")[:, :length]
    worth[order, np.arange(n)[:, None]] = np.arange(length, 0, -1, dtype=np.int16)
    return worth


def candidates(posted: np.ndarray, lengths: np.ndarray, asked: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """For each asked query the rows first by what they save of the footrule beyond the mean, times their length; ties go to the earlier row."""
    pivots, n = posted.shape
    # what all places together are worth fits
    sums = np.int16 if pivots // 2 <= 255 else np.int32
    saved, one = np.empty(n, sums), np.empty(n, np.int16)
    for own in asked.T:
        if count >= n:
            yield np.arange(n)
            continue
        saved[:] = 0
        for pivot in np.flatnonzero(own):
            np.add(saved, np.minimum(posted[pivot], own[pivot], out=one), out=saved)
        key = (saved - saved.mean()) * lengths
        cut = np.partition(key, n - count)[n - count]
        above = np.flatnonzero(key > cut)
        yield np.union1d(above, np.flatnonzero(key == cut)[: count - len(above)])


def _searcher(middle: np.ndarray, k: int, share: float, each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["block", "query_block"]
        axes = frames(len(middle))
        for table in groups(batches, keys):
            starts = group_starts(table, keys)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(a, b - a).combine_chunks()
                asks = part.column("asks").to_numpy()
                ids, rows = part.column("vec_id").to_numpy(), _rows(part.column("vector"))
                qi, vi = np.flatnonzero(asks), np.flatnonzero(~asks)
                if not len(qi) or not len(vi):
                    continue
                vi = vi[np.argsort(ids[vi], kind="stable")]
                vectors, least = np.ascontiguousarray(rows[vi]), ids[vi]
                held = part.column("held").take(pa.array(vi)).combine_chunks()
                held_at = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
                held = held.flatten()
                held_id, held_n = held.field("vec_id").to_numpy(), np.minimum(held.field("n").to_numpy(), k)
                away = vectors - middle
                posted, asked = files(away @ axes.T), files(_unit(rows[qi]) @ axes.T)
                count = int(np.ceil(share * len(vi))) + each * k
                query = part.column("node").to_numpy()
                out_q, out_n, out_v, out_s = [], [], [], []
                for q, best in zip(qi, candidates(posted, np.linalg.norm(away, axis=1), asked, count), strict=True):
                    exact = (vectors[best] * rows[q]).sum(1)
                    # one more than k: a vector may have the query's own id alone
                    top = _top(exact, least[best], k + 1)
                    near, score = best[top], exact[top]
                    size = held_at[near + 1] - held_at[near]
                    at = np.repeat(held_at[near] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    times = np.where(held_id[at] == ids[q], 0, held_n[at])
                    found, score = np.repeat(held_id[at], times), np.repeat(np.repeat(score, size), times)
                    top = np.lexsort((found, -score))[:k]
                    out_q.append(np.full(len(top), ids[q]))
                    out_n.append(np.full(len(top), query[q]))
                    out_v.append(found[top])
                    out_s.append(score[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_n, out_v, out_s)], ["query_id", "query", "vec_id", "score"])

    return run


def _top(exact: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k first by falling score, ties by id."""
    some = np.arange(len(exact)) if len(exact) <= k else np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k])
    return some[np.lexsort((ids[some], -exact[some]))[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE, each: int = EACH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors found with the largest inner product.

    Both have (vec_id, embedding); other columns are ignored. Equal rows of queries are one query, and rows with one id and several vectors
    several queries, each with its own ranks. Rows with the query's own vec_id are no candidates.
    Vectors that are null or zero or hold null or non-finite components, and rows without an id, take no part, nor do those
    whose number of components isn't that of most vectors (of equals the smaller one). Ties go to the smaller vec_id;
    repeated rows are candidates each. Empty tables give an empty result.
    """
    fine, asked = usable(vectors), usable(queries)
    dim = fine.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dim is None:
        return asked.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    fine, asked = (x.where(F.size("vector") == dim.d).withColumn("node", F.xxhash64("vector")) for x in (fine, asked))
    asked = asked.dropDuplicates(["vec_id", "node"])
    # of each distinct vector the k + 1 least ids, with their numbers of rows: cut in parts, then together
    ids = fine.groupBy("node", "vec_id").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)))
    for keys in (["node", "part"], ["node"]):
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    held = ids.groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.collect_list(F.struct("vec_id", "n")).alias("held"))
    nodes = stored(fine.groupBy("node").agg(F.first("vector").alias("vector")).join(held, "node"))
    sample = nodes.withColumn("h", F.hash("node")).orderBy("h", "node").limit(SAMPLE).select("vector").toPandas()["vector"]
    middle = np.array([list(v) for v in sample]).mean(0)
    blocks, query_blocks = max(1, -(-nodes.count() // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    own = nodes.select("vec_id", "node", "held", "vector", F.lit(False).alias("asks"), F.pmod("node", F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    none = F.lit(None).cast(own.schema["held"].dataType).alias("held")
    ask = asked.select("vec_id", "node", none, "vector", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"))
    dealt = own.unionByName(ask.select(own.columns)).repartition("block", "query_block").sortWithinPartitions("block", "query_block")
    found = dealt.mapInArrow(_searcher(middle, k, share, each), "query_id long, query long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
