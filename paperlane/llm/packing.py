"""Token packing by Karmarkar-Karp multiway differencing.

Texts are tokenised in the task that reads them, and packed there block by block, so packing needs
no shuffle and a task holds one block of tokens. Of each document full windows are cut off; the
remainders of a block are dealt into near-equal windows: every remainder begins as a partial
partition of its own, and the two partial partitions with the widest imbalance are merged, the
heavy windows of one with the light windows of the other, until one partition is left. If its
heaviest window is beyond the capacity, the number of windows rises and the merging is repeated.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bytetext import SPACES, Words, chunks, text_buffer

WINDOW = 4096
#: A block is packed when its remainders have so many tokens, or so many tokens are held at all; a document has at least its end id.
BLOCK_TOKENS, HELD_TOKENS = 600_000, 4_000_000
#: Remainders are dealt in bundles: neighbours of a block are joined until they have so many tokens, so a block has a bounded number of items.
BUNDLE = 64
#: Distinct words whose ids a task remembers.
MEMORY_WORDS = 1_500_000
#: New words that are encoded at once.
LINE_WORDS = 500

#: Characters for which str.lower() and str.split() do what the tokenizer's normaliser does: printable ASCII, tab, line feed, carriage return, Latin-1 and Latin Extended-A letters but the dotted capital I.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]*")


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _endings(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a lone comma or full stop ends a word: it is a pretoken of its own, so the word is the same with it and without."""
    out = np.zeros(len(raw), bool)
    if len(raw) > 1:
        last = np.zeros(len(raw), bool)
        last[at[at > 0] - 1] = True
        last[:-1] |= SPACES[raw[1:]]
        out[1:] = ((raw[1:] == 44) | (raw[1:] == 46)) & last[1:] & _LETTER[raw[:-1]]
        out[at[at < len(raw)]] = False
    return out


#: Pretokens of a word that isn't letters alone.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


#: A Python worker's tokenizers, which outlive its tasks.
_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of texts by a tokenizers file whose words never span white space; remembers the ids of words.

    Words are told apart by 64-bit hashes; those not met before are encoded together, and cut apart at
    the ids that end a pretoken. When more than MEMORY_WORDS are known, the memory starts anew. A text
    with characters outside _PLAIN, or that holds the content of an added token, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        parts = np.array([1 if w.isalpha() else len(_PARTS.findall(w.lower())) for w in words], np.int64)
        # few at a time: what the tokenizer returns takes a hundred times as much memory as the ids, and a worker doesn't give it back
        ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([" ".join(words[i : i + LINE_WORDS])], add_special_tokens=False)[0].ids, np.uint32) for i in range(0, len(words), LINE_WORDS)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != parts.sum():
            raise ValueError("the tokenizer doesn't end each part of a word with an id of its own")
        self.at = np.concatenate([self.at, self.at[-1] + ends[np.cumsum(parts) - 1]])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets), each text followed by the id end."""
        texts = column.to_pylist()
        odd = [i for i, t in enumerate(texts) if t and (_PLAIN.fullmatch(t) is None or any(a in t for a in self.added))]
        if odd:
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            column = pc.if_else(pa.array(mask), "", column)
        raw, at = text_buffer(column)
        words = Words(raw, at, breaks=_endings(raw, at))
        hashes, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > MEMORY_WORDS:
            self.forget()
        place = np.searchsorted(self.known, hashes)
        there = np.minimum(place, max(len(self.known) - 1, 0))
        code = np.where(self.known[there] == hashes, self.code[there], -1) if len(self.known) else np.full(len(hashes), -1)
        new = np.flatnonzero(code < 0)
        if len(new):
            data, a, b = raw.tobytes(), words.starts[first[new]].tolist(), words.ends[first[new]].tolist()
            n = len(self.known)
            self.learn([data[x:y].decode() for x, y in zip(a, b, strict=True)])
            code[new] = np.arange(n, n + len(new))
            self.known, self.code = np.insert(self.known, place[new], hashes[new]), np.insert(self.code, place[new], code[new])
        size, start = (self.at[code + 1] - self.at[code])[inverse], self.at[code][inverse]
        ends = np.concatenate([[0], np.cumsum(size)])
        lengths = ends[words.at[1:]] - ends[words.at[:-1]]
        rest = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in odd}
        for i, x in rest.items():
            lengths[i] = len(x)
        out_at = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.full(out_at[-1], end, np.uint32)
        owner = np.repeat(out_at[:-1] - ends[words.at[:-1]], np.diff(words.at))  # where a text's ids begin, less where they begin in ends
        shift = np.repeat(start - ends[:-1], size)
        ramp = np.arange(ends[-1])
        out[np.repeat(owner, size) + ramp] = self.ids[shift + ramp]
        for i, x in rest.items():
            out[out_at[i] : out_at[i] + len(x)] = x
        return out, out_at


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item: Karmarkar-Karp multiway differencing into so many windows."""
    n = len(lengths)
    left, right, node = [-1] * n, [-1] * n, n
    heap = []
    for i, length in enumerate(lengths):
        sums, who = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], who[-1] = length, i
        heap.append((-int(length), i, sums, who))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, key, s1, w1 = heapq.heappop(heap)
        _, _, s2, w2 = heapq.heappop(heap)
        sums, a, b = s1 + s2[::-1], w1, w2[::-1]
        who = np.where(a < 0, b, a)
        for j in np.flatnonzero((a >= 0) & (b >= 0)):
            left.append(int(a[j]))
            right.append(int(b[j]))
            who[j] = node
            node += 1
        order = np.argsort(sums, kind="stable")
        sums, who = sums[order], who[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), key, sums, who))
    out = np.zeros(n, np.int64)
    for w, top in enumerate(heap[0][3]):
        stack = [int(top)] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = w
            else:
                stack += [left[x], right[x]]
    return out


def bundles(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bundle of each item: runs of items shorter than size are joined until they reach it, so that there are few bundles of less."""
    short = lengths < size
    before = np.cumsum(np.where(short, lengths, 0)) - np.where(short, lengths, 0)
    key = np.where(short, before // size, len(lengths) + np.cumsum(~short))
    return np.unique(key, return_inverse=True)[1]


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for items of at most capacity each, as few and as equal as differencing finds."""
    bundle = bundles(lengths, min(BUNDLE, max(1, capacity // 2)))
    sizes = np.bincount(bundle, lengths).astype(np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        out = differencing(sizes, windows)
        if np.bincount(out, sizes, windows).max() <= capacity:
            return out[bundle]
        windows += max(1, windows // 120)


def _packer(path: str, capacity: int, end: int, with_ids: bool, with_crc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, ids of the document)
        loose = total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            sizes = np.array([len(ids) for _, ids in held], np.int64)
            full, rest = sizes // capacity, sizes % capacity
            pieces = np.repeat(np.arange(len(held)), full)
            start = (np.arange(len(pieces)) - np.repeat(np.cumsum(full) - full, full)) * capacity
            seq, length = sequence + np.arange(len(pieces)), np.full(len(pieces), capacity)
            offset = np.zeros(len(pieces), np.int64)
            some = np.flatnonzero(rest)
            if len(some):
                window = pack(rest[some], capacity)
                _, window = np.unique(window, return_inverse=True)
                order = np.argsort(window, kind="stable")
                ends = np.cumsum(rest[some][order])
                before = ends - rest[some][order]
                first = np.flatnonzero(np.diff(window[order], prepend=-1))
                place = np.empty(len(some), np.int64)
                place[order] = before - np.repeat(before[first], np.diff(np.append(first, len(some))))
                pieces, start = np.append(pieces, some), np.append(start, full[some] * capacity)
                seq, length, offset = np.append(seq, sequence + len(seq) + window), np.append(length, rest[some]), np.append(offset, place)
            sequence = int(seq.max()) + 1
            cut = [held[p][1][s : s + n] for p, s, n in zip(pieces.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = {"doc_id": pa.array([held[p][0] for p in pieces.tolist()], pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64())}
            if with_crc:
                columns["ids_crc32"] = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64())
            columns |= {"doc_tokens": pa.array(sizes[pieces], pa.int64()), "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offset, pa.int64())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), pa.array(np.concatenate(cut).astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

        for rows, _, _ in chunks(batches):
            ids, at = tokenizer.encode(rows.column("text"), end)
            for doc, a, b in zip(rows.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                held.append((doc, ids[a:b]))
                loose, total = loose + (b - a) % capacity, total + b - a
                if loose >= BLOCK_TOKENS or total >= HELD_TOKENS:
                    yield from flush()
                    held, loose, total = [], 0, 0
        if held:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = WINDOW, end: int = 2, with_ids: bool = True, with_crc: bool = False) -> DataFrame:
    """Pieces of all documents of docs (doc_id, text), packed into sequences of at most capacity tokens.

    Ids are those of the tokenizer's file as it is, so the content of an added token in a text is that token's id.
    Every row is packed, rows with equal ids or texts each on their own; a null or empty text is the
    end id alone; a null doc_id stays null. Every id of a row lies in exactly one piece. sequence_id is
    unique over all tasks; offset begins at 0 and has no gap. ids (array<int>) and ids_crc32 are optional.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    schema = "doc_id long, start long, length long" + ", ids_crc32 long" * with_crc + ", doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_packer(tokenizer, capacity, end, with_ids, with_crc), schema)
