"""Exact metric range join of embeddings: pivots partition the vectors, the triangle inequality replicates.

Every vector belongs to the cell of its nearest pivot. On the unit sphere, with angles as the metric, a vector
within the angle r of one of a cell's own vectors lies within r of the cell's border, and of the shell around the
pivot that holds the cell's own vectors; only vectors for which both hold may have a partner in the cell. So each
cell meets all partners of its own vectors, and the cells join independently. Of two cells the later one's vectors
visit the earlier one, so every pair meets once.

The pivots' number grows with the square root of the vectors'. Neighbouring cells make parts of a bounded number of
own vectors, which are the tasks: a vector goes to a part once, with the list of its cells there that it visits, so it
is copied at most as often as there are parts, not cells. Visitors of a part are dealt into blocks of a bounded number,
and the own vectors of a cell that is itself too large for a part into blocks too.

Equal vectors are one from the start. A task never returns pairs: it counts partners, and returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytetext import forest, group_starts, groups
from .graph import components, settle, stored

#: Pivots are as many as the square root of the vectors' number, drawn by a hash, but no more than hold so many bytes: more would
#: only spare comparisons.
PIVOT_BYTES = 32_000_000
#: Own vectors of a part, and visitors that one task compares with them.
OWN_BLOCK, VISITOR_BLOCK = 16_384, 65_536
#: Slack for rounding in the bounds; the links themselves are decided on products in double precision alone.
SLACK = 1e-6


FINE = "coalesce(vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0), false)"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>) of the vectors that take part: not null or zero, all components finite; no negative zeros."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(cast(embedding AS array<double>), x -> x + 0D)").alias("vector"))
    return v.where(FINE)


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _assigner(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(_rows(batch.column("vector"))) @ pivots.T
                home = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(home)), home], -1, 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "copies", "vector")), pa.array(home.astype(np.int32)), pa.array(angle)], ["node", "copies", "vector", "home", "angle"])

    return run


def make_parts(pivots: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The part of each cell: neighbouring cells with at most size own vectors together, or one cell. Halved across the widest direction, again and again."""
    part, todo, n = np.zeros(len(pivots), np.int64), [np.arange(len(pivots))], 0
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or counts[cells].sum() <= size:
            part[cells], n = n, n + 1
            continue
        away = pivots[cells] - pivots[cells].mean(0)
        _, vectors = np.linalg.eigh(away.T @ away)
        order = cells[np.argsort(away @ vectors[:, -1], kind="stable")]
        half = np.clip(np.searchsorted(np.cumsum(counts[order]), counts[cells].sum() / 2) + 1, 1, len(order) - 1)
        todo += [order[:half], order[half:]]
    return part


class Plan:
    """Which cells a vector visits, and where the tasks are."""

    def __init__(self, pivots: np.ndarray, least: np.ndarray, most: np.ndarray, counts: np.ndarray, cosine: float):
        self.pivots, self.r = pivots, np.arccos(cosine) + SLACK
        self.least, self.most = least - self.r, most + self.r
        self.part = make_parts(pivots, counts, OWN_BLOCK)
        self.own_blocks = np.maximum(1, -(-np.bincount(self.part, counts).astype(np.int64) // OWN_BLOCK))
        self.visitor_blocks = np.ones(len(self.own_blocks), np.int64)

    def visits(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits: to the row's own cell, and to the earlier ones that may hold a partner."""
        near = unit @ self.pivots.T
        own = near[np.arange(len(home)), home]
        gap = np.sqrt(np.maximum(0, 2 - 2 * self.pivots[home] @ self.pivots.T))
        angle = np.arccos(np.clip(near, -1, 1))
        inside = (own[:, None] - near <= np.sin(self.r) * gap + SLACK) & (angle <= self.most) & (angle >= self.least)
        inside &= np.arange(len(self.pivots)) < home[:, None]
        inside[np.arange(len(home)), home] = True
        return np.nonzero(inside)


def _visit_counts(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plan.own_blocks), np.int64)
        for batch in batches:
            for p in range(0, batch.num_rows, 2048):
                part = batch.slice(p, 2048)
                i, cell = plan.visits(_unit(_rows(part.column("vector"))), part.column("home").to_numpy())
                total += np.bincount(np.unique(i * len(total) + plan.part[cell]) % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["part", "n"])

    return run


def _dealer(plan: Plan):
    """Sends each vector to the tasks of its own part, and to a block of visitors of each part that it visits, with the cells visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for p in range(0, whole.num_rows, 2048):
                batch = whole.slice(p, 2048)
                home, node = batch.column("home").to_numpy(), batch.column("node").to_numpy()
                i, cell = plan.visits(_unit(_rows(batch.column("vector"))), home)
                order = np.lexsort((cell, plan.part[cell], i))
                i, cell = i[order], cell[order]
                part = plan.part[cell]
                first = np.flatnonzero(np.diff(i, prepend=-1) | np.diff(part, prepend=-1))
                mixed = (node.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                # as a visitor: its block of the visitors, to every block of own vectors
                row, to = i[first], part[first]
                n = plan.own_blocks[to]
                k = np.repeat(np.arange(len(row)), n)
                visit = (row[k], to[k], np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n), (mixed[row] % plan.visitor_blocks[to].astype(np.uint64)).astype(np.int64)[k], k)
                # as an own vector: its block of those, to every block of visitors
                mine = plan.part[home]
                n = plan.visitor_blocks[mine]
                k = np.repeat(np.arange(len(home)), n)
                own = (k, mine[k], (mixed % plan.own_blocks[mine].astype(np.uint64)).astype(np.int64)[k], np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n), np.full(len(k), -1))
                take, to, bi, bj, which = (np.concatenate(x) for x in zip(visit, own, strict=True))
                ends = np.append(first[1:], len(cell))
                size = np.where(which >= 0, (ends - first)[which], 0)
                at = np.concatenate([[0], np.cumsum(size)])
                flat = np.repeat(np.where(which >= 0, first[which], 0) - at[:-1], size) + np.arange(at[-1])
                visited = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(cell[flat].astype(np.int32)))
                rows = batch.select(["node", "copies", "vector"]).take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (to, bi, bj)), pa.array(which < 0), pa.array(home[take]), visited, *rows.columns], ["part", "bi", "bj", "own", "home", "visits", "node", "copies", "vector"])

    return run


def _joiner(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, n_links, root) of the vectors with partners here: how many, and a node they are linked to, through others of the task if need be."""
        keys = ["part", "bi", "bj"]
        for table in groups(batches, keys):
            starts = group_starts(table, keys)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                rows = table.slice(a, b - a).combine_chunks()
                home, node, copies = (rows.column(c).to_numpy() for c in ("home", "node", "copies"))
                unit = _unit(_rows(rows.column("vector")))
                narrow = unit.astype(np.float32)
                # products of single precision are off by less; those that reach so far are computed anew in double
                near_enough = np.float32(cosine - (unit.shape[1] + 8) * 1.2e-7)
                visited = rows.column("visits").combine_chunks()
                cell, visitor = visited.flatten().to_numpy(), np.repeat(np.arange(len(rows)), visited.value_lengths().to_numpy())
                order = np.argsort(cell, kind="stable")
                cell, visitor = cell[order], visitor[order]
                own_order = np.flatnonzero(rows.column("own").to_numpy())
                own_order = own_order[np.argsort(home[own_order], kind="stable")]
                links, left, right = np.zeros(len(rows), np.int64), [], []
                for c in np.unique(home[own_order]):
                    own = own_order[slice(*np.searchsorted(home[own_order], [c, c + 1]))]
                    guests = visitor[slice(*np.searchsorted(cell, [c, c + 1]))]
                    for p in range(0, len(own), 1024):
                        some = own[p : p + 1024]
                        for q in range(0, len(guests), 8192):
                            others = guests[q : q + 8192]
                            i, j = np.nonzero(narrow[some] @ narrow[others].T >= near_enough)
                            i, j = some[i], others[j]
                            for s in range(0, len(i), 500_000):
                                x, y = i[s : s + 500_000], j[s : s + 500_000]
                                good = (node[x] != node[y]) & ((unit[x] * unit[y]).sum(1) >= cosine)
                                # two vectors of one cell meet in both roles: once is enough
                                good &= (home[y] != c) | (node[x] < node[y])
                                x, y = x[good], y[good]
                                np.add.at(links, x, copies[y])
                                np.add.at(links, y, copies[x])
                                # a spanning forest of these links, so that what is held stays in proportion to the vectors
                                root = forest(x, y, len(rows))
                                z = np.unique(np.concatenate([x, y]))
                                left.append(z)
                                right.append(root[z])
                if left:
                    root = forest(np.concatenate(left), np.concatenate(right), len(rows))
                    x = np.flatnonzero((links > 0) | (root != np.arange(len(rows))))
                    yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(links[x]), pa.array(node[root[x]])], ["node", "n_links", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding; other columns are ignored).

    Two rows are linked if the cosine of their vectors, in double precision, is at least cosine. Vectors that
    are null or zero or hold null or non-finite components, rows whose vec_id is null, and vectors whose number of components
    isn't that of most (of equals the smaller one) have no link. Rows with equal vectors are linked with each other, whatever
    their ids. pivots overrides the number of pivots, which changes the work alone. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(cast(embedding AS array<double>), x -> x + 0D)").alias("vector"))
    dim = rows.where(FINE).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dim is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    fits = f"{FINE} and size(vector) = {dim.d}"
    hashes = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("again"), "vector").alias("h2")]
    fine = rows.where(fits).select("vec_id", "vector", *hashes)
    # equal vectors are one node, numbered in the stored table; rows that share an id as well are counted as copies
    nodes = stored(fine.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("h1").alias("h1"), F.first("h2").alias("h2")).withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    wanted = pivots or min(max(1, round(total**0.5)), max(1, PIVOT_BYTES // (8 * dim.d)))
    centres = nodes.orderBy("h1", "h2").limit(wanted).select("vector").toPandas()["vector"]
    points = _unit(np.array([list(v) for v in centres]))
    homes = stored(nodes.select("node", "copies", "vector").mapInArrow(_assigner(points), "node long, copies long, vector array<double>, home int, angle double"))
    least, most, counts = np.full(len(points), np.pi), np.zeros(len(points)), np.zeros(len(points), np.int64)
    for home, low, high, n in homes.groupBy("home").agg(F.min("angle"), F.max("angle"), F.count("*")).collect():  # a row for each pivot
        least[home], most[home], counts[home] = low, high, n
    plan = Plan(points, least, most, counts, cosine)
    for part, n in homes.mapInArrow(_visit_counts(plan), "part int, n long").groupBy("part").agg(F.sum("n")).collect():  # a row for each part
        plan.visitor_blocks[part] = max(1, -(-n // VISITOR_BLOCK))
    dealt = homes.mapInArrow(_dealer(plan), "part int, bi int, bj int, own boolean, home int, visits array<int>, node long, copies long, vector array<double>")
    joined = settle(dealt.repartition("part", "bi", "bj").sortWithinPartitions("part", "bi", "bj").mapInArrow(_joiner(cosine), "node long, n_links long, root long"))
    linked = joined.groupBy("node").agg(F.sum("n_links").alias("n"))
    roots = components(joined.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "root")
    known = nodes.select("node", "least", "copies", "h1", "h2").join(linked, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = known.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = settle(known.join(best, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    good = fine.select("vec_id", "h1", "h2").join(ids, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(f"not ({fits})").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
