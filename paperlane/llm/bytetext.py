"""Vectorised word and n-gram hashing over the UTF-8 bytes of an Arrow string column.

A prefix sum of ``table[byte] * R**position`` (modulo 2**64, R odd and so invertible) gives the
hash of any byte span in constant time, hence whole Arrow batches are tokenised and hashed by a
few numpy passes, without a Python object for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 1_000_000

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes mapped to lower case (A-Z only).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Separators of plain words: every ASCII byte that is neither letter nor digit.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n."""
    if len(_powers["p"]) < n:
        size = max(n, CHUNK_BYTES + 65_536)
        for key, base in (("p", _R), ("q", _R_INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts in it); a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most size bytes of column ``text`` (one row at least), with bytes and offsets."""
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


class Words:
    """The words of a chunk of texts: byte spans, hashes, and which text each stands in."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES, lower: np.ndarray = LOWER, breaks: np.ndarray | None = None):
        n = len(raw)
        solid = ~separators[raw]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
        inner = at[(at > 0) & (at < n)]
        if n:
            before[0] = after[-1] = True
            before[inner], after[inner - 1] = True, True
        if breaks is not None:  # a word also begins where breaks is true
            before |= breaks
            after[:-1] |= breaks[1:]
        self.starts = np.flatnonzero(solid & before)
        self.ends = np.flatnonzero(solid & after) + 1
        #: offsets of each text's words among all words
        self.at = np.searchsorted(self.starts, at)
        pw, qw = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[lower[raw]] * pw[:n], out=self.prefix[1:])
        self.inverse = qw
        self.hashes = mix((self.prefix[self.ends] - self.prefix[self.starts]) * qw[self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def subset(self, which: np.ndarray) -> Words:
        """The words with these ascending numbers."""
        out = object.__new__(Words)
        out.starts, out.ends, out.hashes, out.prefix, out.inverse = self.starts[which], self.ends[which], self.hashes[which], self.prefix, self.inverse
        out.at = np.searchsorted(which, self.at)
        return out

    def unrepeated(self) -> Words:
        """Without the words that equal one of the two before them in the text."""
        new, text = np.ones(len(self), bool), self.texts()
        for back in (1, 2):
            new[back:] &= (self.hashes[back:] != self.hashes[:-back]) | (text[back:] != text[:-back])
        return self.subset(np.flatnonzero(new))

    def texts(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the byte spans of one length from these starts."""
        return mix((self.prefix[starts + length] - self.prefix[starts]) * self.inverse[starts] + np.uint64(length))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node number that each of n nodes can reach over the links a[i]-b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        label = new[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys, each of about one batch's rows or one group's."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and held[-1].column(k)[-1].as_py() != v[0]
        cut = np.flatnonzero(change)
        if not len(cut):
            held.append(batch)
            continue
        last = int(cut[-1])
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Offsets of the groups in a table sorted by keys, with the end."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
