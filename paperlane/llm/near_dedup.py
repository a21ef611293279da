"""MinHash near-duplicate classes by a multi-index Hamming join of b-bit signatures.

Every text becomes a set of word shingles and a signature of SYMBOLS minima, each cut to 16 bits.
A signature is split into CHUNKS chunks. By the pigeonhole principle two signatures that differ in
at most 2 * CHUNKS - 1 symbols have a chunk with at most one wrong symbol, so posting each chunk
once for every single symbol left out (the allowed chunk errors) brings every such pair into a
common bucket. In the buckets the whole signatures are compared; near pairs make candidate groups,
whose links are then confirmed on the full shingle sets.

Texts with equal sets are one class from the start, so that exact copies cost nothing more. Links
are never expanded: a bucket or a candidate group returns a spanning forest of its links. In a
candidate group too large for one task every text is first compared with the group's root, in blocks; only
those not linked with it are then compared with all, in pairs of blocks. So a group of copies of one
text costs as much as it has texts, and no link is lost: two texts both linked with the root need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytetext import Words, chunks, forest, group_starts, groups, mix
from .graph import components, join_counted, settle, stored

SYMBOLS, CHUNKS = 32, 8
WIDTH = SYMBOLS // CHUNKS
#: Signatures that differ in so many symbols at most are certain to meet, and are then candidates.
MAX_ERRORS = 2 * CHUNKS - 1
#: Signatures of a bucket that one task compares at once.
BUCKET_BLOCK = 2048
#: Texts, and shingles, of a candidate group that one task compares at once.
GROUP_BLOCK, GROUP_SHINGLES = 768, 1_500_000

_random = np.random.default_rng(7)
_MULTIPLY = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2)
_PLACE = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each text its distinct shingles of size words, sorted; a shorter text is one shingle."""
    words = Words(raw, at)
    wh, lo, hi = words.hashes, words.at[:-1], words.at[1:]
    counts = hi - lo
    full = np.maximum(counts - size + 1, 0)
    n = np.where((counts > 0) & (counts < size), 1, full)
    out_at = np.concatenate([[0], np.cumsum(n)])
    hashes = np.empty(out_at[-1], np.uint64)
    first = np.repeat(lo - out_at[:-1], n) + np.arange(out_at[-1])
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total += wh[np.minimum(first + k, len(wh) - 1)] * _PLACE[k] if len(wh) else 0
    hashes[:] = mix(total)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = wh[lo[i] : hi[i]]
        hashes[out_at[i]] = mix((own * _PLACE[: len(own)]).sum(keepdims=True, dtype=np.uint64) + _PLACE[32 + len(own)])[0]
    for a, b in zip(out_at[:-1], out_at[1:], strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[out_at[:-1][n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], kept[out_at]


def fingerprints(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which do not depend on the order; 0 for an empty set."""
    out = np.zeros((2, len(at) - 1), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[0, some] = np.add.reduceat(mix(sets ^ _PLACE[40]), at[some])
        out[1, some] = np.add.reduceat(mix(sets ^ _PLACE[41]), at[some])
    return out[0].view(np.int64), out[1].view(np.int64)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at) - 1, SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], at[some])
            out[some, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary()) if len(rows) else pa.array([], pa.binary())


def _summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in chunks(batches):
            sets, sat = shingle_sets(raw, at, size)
            f1, f2 = fingerprints(sets, sat)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(sat)), pa.array(f1), pa.array(f2), _binary(signatures(sets, sat))], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature under every chunk with every one symbol left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
        weighed = (sig + np.uint64(1)) * _PLACE[:SYMBOLS]
        whole = weighed.reshape(-1, CHUNKS, WIDTH).sum(2, dtype=np.uint64)
        keys = mix(np.repeat(whole, WIDTH, axis=1) - weighed + _PLACE[32 : 32 + SYMBOLS][np.arange(SYMBOLS)])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column("cls").to_numpy(), SYMBOLS))], ["key", "cls"])


def _near(sig: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of the pairs within each group, which starts delimit, that differ in MAX_ERRORS symbols at most."""
    end = np.repeat(starts[1:], np.diff(starts))
    left, right, i = [], [], np.arange(len(sig))
    for d in range(1, int(np.diff(starts).max(initial=1))):
        i = i[i + d < end[i]]
        for part in np.array_split(i, 1 + len(i) // 100_000):
            near = part[(sig[part] != sig[part + d]).sum(1) <= MAX_ERRORS]
            left.append(near)
            right.append(near + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (i, i)


def _with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, key): links in each block of a bucket; b is null for a signature that isn't near its bucket's hub, where the bucket has more blocks.

    All of a block is compared with the hub, which stands in every block of its bucket, and what isn't near it with the rest of the block:
    two that are near the hub need no comparison. Where a bucket is one block, the rest is compared with all here.
    """
    keys = ["key", "block"]
    for table in groups(batches, keys):
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        cls, key, starts = table.column("cls").to_numpy(), table.column("key").to_numpy(), group_starts(table, keys)
        whole, hub = table.column("nb").to_numpy() == 1, table.column("hub").to_numpy()
        sizes = np.diff(starts)
        is_hub = np.flatnonzero(cls == hub)
        of = np.repeat(is_hub, sizes)  # every block holds its hub once
        near = (sig != sig[of]).sum(1) <= MAX_ERRORS
        linked, far = np.flatnonzero(near & (cls != hub)), np.flatnonzero(~near)
        yield pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(hub[linked]), pa.array(key[linked])], ["a", "b", "key"])
        open_ = far[~whole[far]]
        yield pa.RecordBatch.from_arrays([pa.array(cls[open_]), pa.nulls(len(open_), pa.int64()), pa.array(key[open_])], ["a", "b", "key"])
        # blocks that are a whole bucket and have any that is far from the hub
        left, right, group = [], [], np.repeat(np.arange(len(sizes)), sizes)
        for g in np.unique(group[far[whole[far]]]).tolist():
            rows, rest = np.arange(starts[g], starts[g + 1]), np.flatnonzero(~near[starts[g] : starts[g + 1]]) + starts[g]
            for x in rest.tolist():
                found = rows[(sig[rows] != sig[x]).sum(1) <= MAX_ERRORS]
                found = found[found != x]
                left.append(np.full(len(found), x))
                right.append(found)
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            root = forest(i, j, len(sig))
            own = np.flatnonzero(root != np.arange(len(sig)))
            yield pa.RecordBatch.from_arrays([pa.array(cls[own]), pa.array(cls[root[own]]), pa.array(key[own])], ["a", "b", "key"])


def _near_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the near pairs of each pair of blocks: of signatures far from their hub, and of all of the bucket."""
    keys = ["key", "bi", "bj"]
    for table in groups(batches, keys):
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        cls = table.column("cls").to_numpy()
        a, b = _near(sig, group_starts(table, keys))
        root = forest(a, b, len(sig))
        x, y = cls, cls[root]
        yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], ["a", "b"])


def _candidates(classes: DataFrame, total: int) -> DataFrame:
    """(a, b): near pairs of signatures, enough to connect all that are near, from the buckets of classes (cls, sig), total rows.

    Of a bucket of many blocks each is first compared with one hub; only those far from it are compared with all of the bucket.
    """
    posted = classes.select("cls", "sig").mapInArrow(_post, "key long, cls long")
    several = posted.groupBy("key").agg(F.count("*").alias("_n"), F.min("cls").alias("hub")).where("_n > 1").withColumn("nb", F.ceil(F.col("_n") / BUCKET_BLOCK).cast("int"))
    met = join_counted(posted, several, ["key"], total * SYMBOLS).join(classes.select("cls", "sig"), "cls")
    every, own = F.sequence(F.lit(0), F.col("nb") - 1), F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")
    dealt = met.select("key", F.explode(F.when(F.col("cls") == F.col("hub"), every).otherwise(F.array(own))).alias("block"), "nb", "hub", "cls", "sig")
    first = settle(dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_with_hub, "a long, b long, key long"))
    links, far = first.where("b is not null").select("a", "b").where("a <> b"), first.where("b is null").select(F.col("a").alias("cls"), "key")
    rest = settle(far.groupBy("key").agg(F.count("*").alias("_n")).withColumn("rb", F.ceil(F.col("_n") / BUCKET_BLOCK).cast("int")))
    if rest.isEmpty():
        return links
    again = met.join(rest.select("key", "rb"), "key")
    bi = F.pmod(F.xxhash64("cls"), F.col("rb")).cast("int")
    some = again.join(far, ["cls", "key"], "left_semi").select("key", bi.alias("bi"), F.explode(every).alias("bj"), "cls", "sig")
    full = again.select("key", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("bi"), own.alias("bj"), "cls", "sig")
    pairs = some.unionByName(full).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return links.unionByName(pairs.mapInArrow(_near_in_buckets, "a long, b long"))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingle set of each candidate; rows that share its id but not its set are left out."""
        for rows, raw, at in chunks(batches):
            sets, sat = shingle_sets(raw, at, size)
            h1, h2 = fingerprints(sets, sat)
            own = np.flatnonzero((h1 == rows.column("h1").to_numpy()) & (h2 == rows.column("h2").to_numpy()))
            for p in range(0, len(own), 512):
                some = own[p : p + 512]
                taken = rows.select(["root", "nb", "cls"]).take(pa.array(some))
                packed = pa.array([sets[sat[i] : sat[i + 1]].tobytes() for i in some.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*taken.columns, packed], ["root", "nb", "cls", "shingles"])

    return run


def _with_root(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cls, root, linked) of a block of a group's texts: whether each is linked with the root, whose set is in every block."""
        keys = ["root", "block"]
        for table in groups(batches, keys):
            starts, cls, root = group_starts(table, keys), table.column("cls").to_numpy(), table.column("root").to_numpy()
            packed, hub = table.column("shingles"), table.column("hub").to_numpy(zero_copy_only=False)
            linked = np.zeros(len(cls), bool)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                first = np.frombuffer(packed[a + int(hub[a:b].argmax())].as_py(), np.uint64)
                for i in range(a, b):
                    own = np.frombuffer(packed[i].as_py(), np.uint64)
                    if 100 * min(len(own), len(first)) >= percent * max(len(own), len(first)):
                        both = len(np.intersect1d(own, first, assume_unique=True))
                        linked[i] = 100 * both >= percent * (len(own) + len(first) - both)
            yield pa.RecordBatch.from_arrays([pa.array(x[~hub]) for x in (cls, root, linked)], ["cls", "root", "linked"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links in each group of full sets."""
        keys = ["root", "bi", "bj"]
        for table in groups(batches, keys):
            starts, cls = group_starts(table, keys), table.column("cls").to_numpy()
            packed = table.column("shingles")
            xs, ys = [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(s.as_py(), np.uint64) for s in packed[a:b]]
                i, j = np.nonzero(_linked(sets, percent))
                root = forest(i, j, b - a)
                own = cls[a:b]
                xs.append(own[root != np.arange(b - a)])
                ys.append(own[root[root != np.arange(b - a)]])
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["a", "b"])

    return run


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets i < j have 100 * intersection >= percent * union."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]], np.int64)
    else:
        every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        _, column, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        renumber = np.cumsum(count > 1) - 1
        column, owner = renumber[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        total, slab = np.zeros((n, n), np.float32), max(256, 4_000_000 // n)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, slab):
            p, q = np.searchsorted(column, [low, low + slab])
            dense = np.zeros((n, slab), np.float32)
            dense[owner[p:q], column[p:q] - low] = 1
            total += dense @ dense.T
        both = total.astype(np.int64)
    return np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the candidate groups in sets (root, nb, cls, shingles), enough to connect all that are linked."""
    blocks = ["root", "bi", "bj"]
    one = sets.where("nb = 1").select("root", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "cls", "shingles")
    # large groups: with the root first
    large = sets.where("nb > 1")
    block = F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")
    hubs = large.where("cls = root").select("root", "cls", "shingles", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.lit(True).alias("hub"))
    beside = large.where("cls <> root").select("root", "cls", "shingles", block.alias("block"), F.lit(False).alias("hub")).unionByName(hubs)
    known = settle(beside.repartition("root", "block").sortWithinPartitions("root", "block").mapInArrow(_with_root(percent), "cls long, root long, linked boolean"))
    # the rest with all of their group
    left = known.where("not linked").select("cls", "root")
    rest_blocks = left.groupBy("root").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("rb"))
    again = large.join(rest_blocks, "root")
    bi = F.pmod(F.xxhash64("cls"), F.col("rb")).cast("int")
    rest = again.join(left, ["cls", "root"], "left_semi").select("root", bi.alias("bi"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bj"), "cls", "shingles")
    every = again.select("root", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("bi"), block.alias("bj"), "cls", "shingles")
    dealt = one.unionByName(rest).unionByName(every)
    found = dealt.repartition(*blocks).sortWithinPartitions(*blocks).mapInArrow(_confirm(percent), "a long, b long")
    return found.unionByName(known.where("linked").select(F.col("cls").alias("a"), F.col("root").alias("b")))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; other columns are ignored).

    Two texts are linked if their shingle sets have 100 * intersection >= percent * union. Texts that
    are null, empty or without a word have an empty set and no link. Rows with equal ids are separate
    rows that share an id. A row whose doc_id is null is returned with component_id null and kept true, and
    takes no part. An empty table gives an empty result. MAX_ERRORS of SYMBOLS symbols cover a similarity of 0.85 but for
    about 4 pairs in a million; below 0.8 more chunks would be needed, so a lower percent is refused.
    """
    if percent < 80:
        raise ValueError("below a similarity of 0.8 the signatures miss too many links")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.mapInArrow(_summaries(shingle_words), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"))
    # texts with equal sets are one class, told apart by 128 bits and the size, and numbered in the stored table
    name = ["h1", "h2", "n_shingles"]
    classes = stored(rows.where("n_shingles > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")).withColumn("cls", F.monotonically_increasing_id()))
    total = classes.count()
    near = _candidates(classes, total)
    members = components(near)
    size = settle(members.join(classes.select(F.col("cls").alias("node"), "doc_id", *name), "node"))
    sizes = size.groupBy("root").agg(F.count("*").alias("_n"), F.ceil(F.greatest(F.count("*") / GROUP_BLOCK, F.sum("n_shingles") / GROUP_SHINGLES)).cast("int").alias("nb"))
    chosen = settle(join_counted(size, sizes, ["root"], total).select("doc_id", F.col("node").alias("cls"), "root", "nb", "h1", "h2"))
    sets = stored(docs.join(chosen, "doc_id").mapInArrow(_sets(shingle_words), "root long, nb int, cls long, shingles binary"))
    found = components(_links(sets, percent)).select(F.col("node").alias("cls"), "root")
    known = settle(classes.select("cls", *name, F.col("doc_id").alias("least")).join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    best = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    ids = settle(join_counted(known, best, ["root"], total).select(*name, "component_id"))
    out = rows.join(ids, name, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
