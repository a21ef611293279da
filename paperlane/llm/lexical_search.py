"""Ranked lexical search by per-term geometric blocking.

A stated set of queries is searched in blocks of a bounded number of terms. Documents are read once for a block of queries and
kept as the counts of its terms; from these come the corpus statistics and the terms' weights. A task then takes
its documents shard by shard and inverts each shard. A term's posting list is clustered by document similarity: some of its
documents, taken at even steps, are centres, every other joins the centre with the largest product of sketches, and clusters are cut to
blocks. A block stores the coordinatewise maximum of its documents' vectors. A list that holds much of the shard is cut by
clusters of the whole shard instead, whose maxima are then shared by all such lists.

A query goes through its terms' lists, those first that can give most. A document in no list so far holds only terms still to
come, so a block counts by the sum of its maxima over those; it is skipped only if that sum is below the score of the
query's last result so far, and the query ends when all lists to come can't reach that score together. All else is scored exactly, so
the results are those of scoring every document. A task's results go from shard to shard, so its later shards skip most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bytetext import PUNCTUATION, Words, chunks
from .graph import stored

#: A block of queries ends when its terms are so many.
QUERY_TERMS = 500_000
#: A shard ends when it has so many documents, or so many counts of terms.
SHARD_DOCS, SHARD_COUNTS = 16_384, 4_000_000
#: Documents of a block, and the length of their sketches.
BLOCK, SKETCH = 64, 32
#: A list with more than this share of a shard's documents is cut by the shard's own clusters.
LONG = 1 / 16
_LAST = np.iinfo(np.int64).max


def _counts(words: Words, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, terms, tf) of the texts: the distinct terms of each, as places in the sorted vocabulary, or as hashes without one."""
    text = words.texts()
    if vocabulary is None:
        order = np.lexsort((words.hashes, text))
        text, term = text[order], words.hashes[order]
    else:
        place = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[place] == words.hashes)
        key = np.sort(text[known] * len(vocabulary) + place[known])
        text, term = key // len(vocabulary), key % len(vocabulary)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return np.searchsorted(text[first], np.arange(len(words.at))), term[first], np.diff(np.append(first, len(text)))


def _lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, at in chunks(batches):
        where, terms, tf = _counts(Words(raw, at, PUNCTUATION), None)
        yield pa.RecordBatch.from_arrays([rows.column("item_id"), _lists(where, terms.view(np.int64), pa.int64()), _lists(where, tf, pa.int64())], ["item_id", "terms", "times"])


def _forward(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in chunks(batches):
            words = Words(raw, at, PUNCTUATION)
            where, terms, tf = _counts(words, vocabulary)
            out = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(words.at), pa.int64()), _lists(where, terms, pa.int32()), _lists(where, tf, pa.int32())], ["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(np.diff(words.at) > 0))

    return run


def _slices(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places at[k] … at[k + 1] - 1 of each k in which, joined, and their numbers."""
    size = at[which + 1] - at[which]
    return np.repeat(at[which] - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


class _Blocks:
    """Documents cut to blocks of similar ones, with the maximum of each term in each block."""

    def __init__(self, shard: Shard, docs: np.ndarray):
        many = -(-len(docs) // BLOCK)
        cluster = np.zeros(len(docs), np.int64)
        if many > 1:
            centres = shard.sketches[docs[np.arange(many) * len(docs) // many]].T.copy()
            cluster = np.concatenate([(shard.sketches[docs[i : i + 8192]] @ centres).argmax(1) for i in range(0, len(docs), 8192)])
        order = np.argsort(cluster, kind="stable")
        cluster = cluster[order]
        first = np.flatnonzero(np.diff(cluster, prepend=-1))
        place = np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs))))
        self.at = np.append(np.flatnonzero(place % BLOCK == 0), len(docs))
        self.docs, self.n = docs[order], len(self.at) - 1
        where, size = _slices(shard.at, self.docs)
        block = np.repeat(np.repeat(np.arange(self.n), np.diff(self.at)), size)
        key = shard.terms[where].astype(np.int64) * self.n + block
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        # by term, and of a term by block
        self.key, self.most = key[first], np.maximum.reduceat(shard.gains[where][order], first)
        self.block = self.key % self.n

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each block what a document in it can get at most from these terms."""
        lo, hi = np.searchsorted(self.key, terms * self.n), np.searchsorted(self.key, (terms + 1) * self.n)
        where, size = _slices(np.stack([lo, hi], 1).ravel(), np.arange(len(terms)) * 2)
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.block[where], np.repeat(weights, size) * self.most[where])
        return out


class Shard:
    """Some documents as vectors of gains, inverted; lists are cut to blocks when a query first reads them."""

    def __init__(self, doc: np.ndarray, at: np.ndarray, terms: np.ndarray, gains: np.ndarray, weights: np.ndarray):
        self.doc, self.at, self.terms, self.gains = doc, at, terms, gains
        order = np.argsort(terms, kind="stable")
        self.list_docs = np.repeat(np.arange(len(doc)), np.diff(at))[order]
        self.list_at = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(np.diff(self.list_at))
        if len(some):
            self.most[some] = np.maximum.reduceat(gains[order], self.list_at[some])
        self.weights, self.cut, self._sketches, self._whole = weights, {}, None, None

    @property
    def sketches(self) -> np.ndarray:
        """Random projections of the documents' vectors, of length 1."""
        if self._sketches is None:
            axes = np.random.default_rng(11).normal(size=(len(self.weights), SKETCH)).astype(np.float32)
            out = np.zeros((len(self.doc), SKETCH), np.float32)
            some = np.flatnonzero(np.diff(self.at))
            value = (self.gains * self.weights[self.terms] * 1e-9).astype(np.float32)
            for i in range(0, len(some), 1024):
                part = some[i : i + 1024]
                s = slice(self.at[part[0]], self.at[part[-1] + 1])
                out[part] = np.add.reduceat(axes[self.terms[s]] * value[s, None], self.at[part] - self.at[part[0]])
            self._sketches = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return self._sketches

    def blocks(self, term: int) -> tuple[_Blocks, np.ndarray | None]:
        """The blocks of a term's list; of a long list those of the whole shard, with a mask of the list's documents."""
        if term not in self.cut:
            docs = self.list_docs[self.list_at[term] : self.list_at[term + 1]]
            if len(docs) > max(BLOCK, LONG * len(self.doc)):
                self._whole = self._whole or _Blocks(self, np.arange(len(self.doc)))
                mask = np.zeros(len(self.doc), bool)
                mask[docs] = True
                self.cut[term] = self._whole, mask
            else:
                self.cut[term] = _Blocks(self, docs), None
        return self.cut[term]

    def score(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """The exact scores of documents, each of which has a term."""
        where, size = _slices(self.at, docs)
        return np.add.reduceat(weight_of[self.terms[where]] * self.gains[where], np.cumsum(size) - size)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """best (scores, ids) with this shard's documents for a query; weight_of is the query's weights by term."""
        bound = weights * self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        terms, weights, rest = terms[order], weights[order], np.cumsum(bound[order][::-1])[::-1]
        seen = np.zeros(len(self.doc), bool)
        scores, ids = best
        for i, term in enumerate(terms.tolist()):
            least = max(1, int(scores[-1])) if len(scores) == k else 1
            if rest[i] < least:
                break
            blocks, mask = self.blocks(term)
            open_ = np.flatnonzero(blocks.bounds(terms[i:], weights[i:]) >= least)
            docs = blocks.docs if len(open_) == blocks.n else blocks.docs[_slices(blocks.at, open_)[0]]
            docs = docs[~seen[docs]] if mask is None else docs[mask[docs] & ~seen[docs]]
            # a document in a block that is skipped stays unseen: in a later list its bound is lower still
            if not len(docs):
                continue
            seen[docs] = True
            found = self.score(docs, weight_of)
            some = np.flatnonzero(found >= least)
            scores, ids = np.concatenate([scores, found[some]]), np.concatenate([ids, self.doc[docs[some]]])
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
        return scores, ids


def _searcher(items: list, at: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, total: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        weight_of = np.zeros(len(weights), np.int64)
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lists, tf = (table.column(c).chunk(0) for c in ("terms", "tf"))
            n, tf = table.column("n").to_numpy(), tf.flatten().to_numpy().astype(np.int64)
            where = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            m = 25 + 75 * n * total // length
            gains = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(where)))
            shard = Shard(table.column("doc_id").fill_null(_LAST).to_numpy(), where, lists.flatten().to_numpy(), gains, weights)
            for q in range(len(items)):
                own = terms[at[q] : at[q + 1]]
                weight = weights[own] * times[at[q] : at[q + 1]]
                weight_of[own] = weight
                best[q] = shard.search(own, weight, best[q], k, weight_of)
                weight_of[own] = 0

        docs = counts = 0
        for batch in batches:
            ends, i = np.cumsum(batch.column("terms").value_lengths().to_numpy()), 0
            while i < batch.num_rows:
                done = int(ends[i - 1]) if i else 0
                j = max(i + 1, min(i + SHARD_DOCS - docs, int(np.searchsorted(ends, done + SHARD_COUNTS - counts, "right"))))
                held.append(batch.slice(i, j - i))
                docs, counts, i = docs + j - i, counts + int(ends[j - 1]) - done, j
                if docs >= SHARD_DOCS or counts >= SHARD_COUNTS:
                    flush()
                    held, docs, counts = [], 0, 0
        if held:
            flush()
        size = [len(s) for s, _ in best]
        number = np.repeat(np.arange(len(items)), size)
        ids = np.concatenate([i for _, i in best])
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([items[q] for q in number.tolist()], pa.int64()), pa.array(ids, mask=ids == _LAST), pa.array(np.concatenate([s for s, _ in best]), pa.int64())], ["query", "item_id", "doc_id", "score"])

    return run


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(items, at, terms, times, vocabulary) of the queries with terms, block by block; rows with equal ids and texts are one query."""
    rows = queries.select(queries["item_id"].cast("long").alias("item_id"), "text").distinct().mapInArrow(_query_terms, "item_id long, terms array<long>, times array<long>")
    items, held, times, size = [], [], [], 0

    def block() -> tuple:
        every = np.concatenate(held).view(np.uint64)
        vocabulary, terms = np.unique(every, return_inverse=True)
        return items, np.concatenate([[0], np.cumsum([len(h) for h in held])]), terms.astype(np.int64), np.concatenate(times), vocabulary

    for r in rows.where(F.size("terms") > 0).toLocalIterator():
        items.append(r.item_id)
        held.append(np.array(r.terms, np.int64))
        times.append(np.array(r.times, np.int64))
        size += len(r.terms)
        if size >= QUERY_TERMS:
            yield block()
            items, held, times, size = [], [], [], 0
    if items:
        yield block()


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring of docs (doc_id, text) for each of queries (item_id, text), scores over 0.

    Terms are the stretches of letters, digits and characters beyond ASCII, of which A-Z alone are lower-cased. Equal scores are ranked by
    doc_id. Each row of docs is a document of its own, repeated rows too; one without an id comes last of equal scores. Null and
    empty texts have no terms and don't count; a query without terms has no results; queries with equal ids and texts are one. Other
    columns are ignored; an empty table gives an empty result. Terms are told apart by 64-bit hashes.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    schema = "query int, item_id long, doc_id long, score long"
    found = None
    for items, at, terms, times, vocabulary in _query_blocks(queries):
        forward = stored(ids.mapInArrow(_forward(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>"))
        total, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in forward.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        part = forward.mapInArrow(_searcher(items, at, terms, times, weights, total, length, k), schema)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
