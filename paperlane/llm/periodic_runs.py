"""Periodic runs of words, by an enhanced suffix array and the branching-tandem test.

The texts of a chunk are one array of word numbers, a mark of its own after each text, so that nothing is common across
texts. Ranks of all stretches of 1, 2, 4, … words are made by prefix doubling, in which only stretches that still have an equal
take part; they give the suffix array, its inverse and, by comparing neighbours from the longest stretch down, the LCP array.
An LCP interval of depth d is found from the nearest smaller values around a place of the LCP array; for each suffix i of its
children, but for the largest child, it is asked whether i + d or i - d stands in the interval outside that child: then
a square of period d begins at i, or at i - d, that can't be rotated to the right. Each is rotated to the left as far as it goes,
again by the ranks, and squares that end in one run are merged into it. There are no tree nodes, and every step is a few numpy passes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import Words, chunks, mix

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Suffixes of small children that are tested at once.
TESTED = 2_000_000
_IDENTITY = np.arange(256, dtype=np.uint8)


def _ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, …: the rank of each stretch of 2**k symbols; equal stretches have one rank, and ranks are in the order of stretches.

    Stops when all differ. The symbols must tell texts apart and end each text with one of its own.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    # the rank is where the group of equals begins, so that it stays when a group falls apart
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    levels, step = [rank], 1
    size = np.diff(np.append(first, n))
    same = order[np.repeat(size > 1, size)]  # by rank
    while len(same):
        # a stretch that reaches the end of its text has no equal, so none of these does
        key = rank[same].astype(np.int64) << 32 | rank[np.minimum(same + step, n - 1)]
        by = np.argsort(key)
        same, key = same[by], key[by]
        new = np.ones(len(same), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(same)))
        group = key >> 32
        head = np.flatnonzero(np.diff(group, prepend=-1))
        base = np.repeat(head, np.diff(np.append(head, len(same))))
        rank = rank.copy()
        rank[same] = np.repeat(first, size) - base + group
        levels.append(rank)
        same, step = same[np.repeat(size > 1, size)], step * 2
    return levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols are equal from a and from b on."""
    out, n = np.zeros(len(a), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        out += (levels[k][x] == levels[k][y]).astype(np.int64) << k
    return out


def _common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols are equal right before a and right before b."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        ok = (x >= 0) & (y >= 0)
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        out += ok.astype(np.int64) << k
    return out


def _nearest(values: np.ndarray, strict: bool) -> np.ndarray:
    """For each place with a value over 0 the nearest place before it with a smaller value (strict), or one at most as large; values[0] is below all."""
    place = np.arange(len(values)) - 1
    open_ = np.flatnonzero(values > 0)
    while len(open_):
        before = values[place[open_]]
        open_ = open_[before >= values[open_] if strict else before > values[open_]]
        # all between a place and what it points to is too large, so what that one points to can be asked next
        place[open_] = place[place[open_]]
    return place


def _children(lcp: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, l, r, depth): the suffixes [a, b) of every child but the largest of each interval [l, r) of the LCP array; close are its places over 0."""
    n = len(lcp) - 1
    # places with a common word, and those right before and behind them, are enough
    kept = np.unique(np.concatenate([[0, n], close - 1, close, close + 1]))
    low = lcp[kept]
    turn = lambda strict: (len(low) - 1 - _nearest(low[::-1], strict))[::-1]
    inner = np.flatnonzero(low > 0)
    left, left_same, right, right_same = (kept[x[inner]] for x in (_nearest(low, True), _nearest(low, False), turn(True), turn(False)))
    j, depth = kept[inner], low[inner]
    # one child ends before each place; behind the last place of an interval there is one more
    last = lcp[right_same] < depth
    a, b = np.concatenate([left_same, j[last]]), np.concatenate([j, right_same[last]])
    l, r, d = (np.concatenate([x, x[last]]) for x in (left, right, depth))
    order = np.lexsort((a - b, d, l))
    a, b, l, r, d = (x[order] for x in (a, b, l, r, d))
    largest = np.ones(len(l), bool)
    largest[1:] = (l[1:] != l[:-1]) | (d[1:] != d[:-1])
    return tuple(x[~largest] for x in (a, b, l, r, d))


def _squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that can't be rotated to the right."""
    n = len(levels[0])
    where = levels[-1].astype(np.int64)  # the inverse suffix array
    suffixes = np.empty(n, np.int64)
    suffixes[where] = np.arange(n)
    # lcp[j] is that of suffixes j - 1 and j
    close = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    if not len(close):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lcp = np.zeros(n + 1, np.int64)
    lcp[close] = _common(levels, suffixes[close - 1], suffixes[close])
    lcp[[0, n]] = -1
    child_a, child_b, l, r, d = _children(lcp, close)
    size = child_b - child_a
    ends = np.cumsum(size)
    starts, periods, at = [], [], 0
    while at < len(size):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + TESTED, "right")))
        s = slice(at, to)
        rep = np.repeat(np.arange(at, to), size[s])
        i = suffixes[child_a[rep] + np.arange(len(rep)) - (ends[rep] - size[rep] - done)]
        lo, hi, a, b, step = l[rep], r[rep], child_a[rep], child_b[rep], d[rep]
        for sign in (1, -1):
            other = i + sign * step
            ok = (other >= 0) & (other < n)
            p = where[np.clip(other, 0, n - 1)]
            ok &= (p >= lo) & (p < hi) & ((p < a) | (p >= b))
            starts.append(np.minimum(i, other)[ok])
            periods.append(step[ok])
        at = to
    pair = np.unique(np.concatenate(starts) << 32 | np.concatenate(periods))
    return pair >> 32, pair & 0xFFFFFFFF


def runs_of(symbols: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of symbols, by start and period; see find_runs() for what a run is.

    A symbol that ends a text must stand nowhere else.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < least:
        return none, none, none
    levels = _ranks(symbols)
    start, period = _squares(levels)
    end = start + 2 * period
    start = start - _common_before(levels, start, start + period)
    kept = end - start >= np.maximum(least, periods * period)
    start, end, period = start[kept], end[kept], period[kept]
    # the multiples of a period show the same run again
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _symbols(hashes: np.ndarray, words_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, where each text's begin) of words by their 64-bit hashes: alike only within one text, with a mark of its own after each text."""
    n = len(words_at) - 1
    at = words_at + np.arange(n + 1)
    out, real = np.empty(at[-1], np.uint64), np.ones(at[-1], bool)
    real[at[1:] - 1] = False
    number = np.arange(1, n + 1, dtype=np.uint64)
    out[real] = hashes ^ np.repeat(mix(number), np.diff(words_at))
    out[~real] = mix(number + np.uint64(1 << 40))
    return out, at


def _digester(change: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in chunks(batches):
            words = Words(raw, at, lower=_IDENTITY)
            doc = rows.column("doc_id").to_pylist()
            count = np.diff(words.at)
            first = np.concatenate([[0], np.cumsum(count)])
            take = np.arange(len(words))
            for k, x in enumerate(doc):
                n = int(count[k])
                h = zlib.crc32(str(x).encode()) if change and x is not None else 1
                if h % 10 == 0 and n:
                    g = h // 10
                    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
                    take[first[k] + a : first[k] + n] = first[k] + a + np.arange(n - a) % p
            symbols, begin = _symbols(words.hashes[take], words.at)
            start, end, period = runs_of(symbols)
            text = np.searchsorted(begin, start, "right") - 1
            start, end = start - begin[text], end - begin[text]
            # what stands in a run after its first period goes
            gone = np.zeros(len(words) + 1, np.int32)
            np.add.at(gone, first[text] + start + period, 1)
            np.add.at(gone, first[text] + end, -1)
            keep = np.cumsum(gone[:-1]) == 0
            cut = np.searchsorted(text, np.arange(len(doc) + 1))
            data = raw.tobytes()
            a, b = words.starts[take].tolist(), words.ends[take].tolist()
            out = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for k in range(len(doc)):
                s, e, q = (x[cut[k] : cut[k + 1]] for x in (start, end, period))
                out["n_runs"].append(len(s))
                best = np.lexsort((q, s, s - e))[0] if len(s) else None
                length = None if best is None else int(e[best] - s[best])
                out["start"].append(None if best is None else int(s[best]))
                out["length"].append(length)
                out["period"].append(None if best is None else int(q[best]))
                out["exponent_milli"].append(None if best is None else 1000 * length // int(q[best]))
                listed = "".join(f"{x},{y - x},{z}\n" for x, y, z in zip(s.tolist(), e.tolist(), q.tolist(), strict=True))
                out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                left = (np.flatnonzero(keep[first[k] : first[k + 1]]) + first[k]).tolist()
                out["collapsed_sha256"].append(hashlib.sha256(b" ".join([data[a[i] : b[i]] for i in left])).hexdigest())
            kinds = {c: pa.string() if c.endswith("sha256") else pa.int64() for c in out}
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(v, kinds[c]) for c, v in out.items())], ["doc_id", *out])

    return run


def _finder(least: int, periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in chunks(batches):
            words = Words(raw, at, lower=_IDENTITY)
            symbols, begin = _symbols(words.hashes, words.at)
            start, end, period = runs_of(symbols, least, periods)
            text = np.searchsorted(begin, start, "right") - 1
            # where the run stands in the text, in bytes
            lo, hi = words.starts[start - text], words.ends[end - text - 1]
            data = raw.tobytes()
            unit = [data[x:y].decode("utf-8", "replace") for x, y in zip(lo.tolist(), words.ends[start - text + period - 1].tolist(), strict=True)]
            columns = (start - begin[text], end - start, period, lo - at[text], hi - at[text])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(text)), *(pa.array(c, pa.int64()) for c in columns), pa.array(unit, pa.string())], ["doc_id", "start", "length", "period", "first_byte", "end_byte", "unit"])

    return run


def find_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, start, length, period, first_byte, end_byte, unit): the runs of words in the texts of docs (doc_id, text).

    A run is a stretch of words, cut at ASCII white space, in which words a period apart are equal, of the smallest such
    period, that no neighbouring word extends, with at least so many words (least) and periods (2 at least). start counts words from
    0, the bytes those of the UTF-8 text; unit is the text of the first period. A null or empty text has no runs; each of
    repeated rows has its own; a null doc_id stays null. Other columns are ignored; an empty table gives an empty result. Nothing is
    shuffled: a text is whole in the task that reads it, and is held there with some 200 bytes for each of its words.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(_finder(least, max(2, periods)), "doc_id long, start long, length long, period long, first_byte long, end_byte long, unit string")


def run_digests(docs: DataFrame, planted: bool = True) -> DataFrame:
    """A row for each of docs (doc_id, text): the number of runs, the longest, and digests of all runs and of the text without what repeats.

    With planted, a tenth of the texts, by the hash of their ids, is first made to repeat itself; a text without an id stays as it is.
    The columns are doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256. A null or empty text has
    no runs, and four nulls; repeated rows have a row each. Nothing is shuffled.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(_digester(planted), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
