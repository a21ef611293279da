"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut into words at their spaces, and between characters that stand together in no piece; each distinct
word is encoded once. Words of about equal length, padded to one length, advance together. The hashes of all their
substrings, by prefix sums, are looked up in the sorted hashes of the pieces beforehand; then, a character at a time, all
pieces that end here are tried together, and a vectorised maximum stores score and backpointer. For a unigram model that is all. A BPE model's encoding is the only
path on which every two neighbouring pieces would also be split so on their own; there, a step to a
piece that isn't compatible with the last piece of its prefix is barred.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import Words, chunks, mix, powers, text_buffer

SPACE = "▁"
#: Distinct words whose ids a worker remembers.
MEMORY_WORDS = 1_500_000
#: Bytes of text handled at once: the more, the fewer words are looked up again.
CHUNK = 4_000_000
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[32] = True
_IDENTITY = np.arange(256, dtype=np.uint8)
_PREFIXED = np.uint64(0x5851F42D4C957F2D)
_UNKNOWN = -2
#: Words up to so many characters advance with those of their own length alone.
SHORT = 24


def _span_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of one size of rows of characters, each as of the substring alone."""
    p, q = powers(chars.shape[1] + 1)
    prefix = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    np.cumsum(mix(chars + np.uint64(1)) * p[:-1], axis=1, out=prefix[:, 1:])
    starts = np.arange(chars.shape[1] - size + 1)
    return mix((prefix[:, starts + size] - prefix[:, starts]) * q[starts] + np.uint64(size))


class Codec:
    """A SentencePiece model's pieces with encoder and decoder (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, path: str, bpe: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, model.unk_id(), np.int64)
        normal, self.bytes_of = {}, []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                normal[piece] = i
        self.ids, self.bpe = normal, bpe
        # two characters that stand together in no piece are never joined, so a word can be cut between them
        self.joins = np.array(sorted({ord(a) << 32 | ord(b) for piece in normal for a, b in zip(piece, piece[1:])}), np.int64)
        self.joins_ascii = np.zeros((256, 256), bool)
        some = self.joins[((self.joins >> 32) < 128) & ((self.joins & 0xFFFFFFFF) < 128)]
        self.joins_ascii[some >> 32, some & 0xFFFFFFFF] = True
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.longest = max(map(len, normal))
        keys = {}
        for piece, i in normal.items():
            keys[int(_span_hashes(np.array([[ord(c) for c in piece]], np.uint64), len(piece))[0, 0])] = i
        if len(keys) < len(normal):
            raise ValueError("two pieces have the same hash")
        order = sorted(keys)
        self.piece_keys, self.piece_ids = np.array(order, np.uint64), np.array([keys[k] for k in order])
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.alone = np.array([i in self.byte_ids or self._merged(p) == [p] for i, p in enumerate(self.pieces)]) if bpe else np.ones(n, bool)
        self.piece_at = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _merged(self, word: str) -> list[str]:
        """A string by merging, best score first, the leftmost of equals first."""
        parts, n = list(word), len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple] = []

        def offer(k: int) -> None:
            if 0 <= k and right[k] < n and (made := parts[k] + parts[right[k]]) in self.ids:
                heapq.heappush(heap, (-self.scores[self.ids[made]], k, made))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, made = heapq.heappop(heap)
            other = right[k]
            if not parts[k] or other >= n or parts[k] + parts[other] != made:
                continue
            parts[k], parts[other], right[k] = made, "", right[other]
            if right[k] < n:
                left[right[k]] = k
            offer(left[k])
            offer(k)
        return [x for x in parts if x]

    def _fits(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each two pieces stay apart when their strings are encoded together."""
        out = self.alone[piece]
        check = np.flatnonzero(out & (last >= 0))
        keys, inverse = np.unique(last[check].astype(np.int64) << 32 | piece[check], return_inverse=True)
        place = np.searchsorted(self.pair_keys, keys)
        there = np.minimum(place, max(len(self.pair_keys) - 1, 0))
        new = np.flatnonzero(self.pair_keys[there] != keys) if len(self.pair_keys) else np.arange(len(keys))
        if len(new):
            fits = [self._merged((a := self.pieces[k >> 32]) + (b := self.pieces[k & 0xFFFFFFFF])) == [a, b] for k in keys[new].tolist()]
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, place[new], keys[new]), np.insert(self.pair_fits, place[new], fits)
        out[check] = self.pair_fits[np.searchsorted(self.pair_keys, keys)][inverse]
        return out

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words; characters without a piece become bytes."""
        out: list[list[int]] = [[] for _ in words]
        # lengths up to SHORT on their own, longer ones with those at most an eighth longer
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            by_length.setdefault(n if n <= SHORT else SHORT + int(np.log(n / SHORT) / np.log(1.125)) + 1, []).append(k)
        for which in by_length.values():
            step = max(1, 1_000_000 // (max(len(words[k]) for k in which) + 1))
            for p in range(0, len(which), step):
                some = which[p : p + step]
                for k, ids in zip(some, self._together([words[k] for k in some]), strict=True):
                    out[k] = ids
        return out

    def _probe(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, word, size, piece) of every substring that is a piece, and of every single character, sorted by end."""
        found = []
        for size in range(1, min(chars.shape[1], self.longest) + 1):
            h = _span_hashes(chars, size)
            place = np.minimum(np.searchsorted(self.piece_keys, h), len(self.piece_keys) - 1)
            piece = np.where(self.piece_keys[place] == h, self.piece_ids[place], _UNKNOWN if size == 1 else -1)
            word, start = np.nonzero((piece != -1) & (np.arange(h.shape[1]) + size <= length[:, None]))
            found.append((start + size, word, np.full(len(word), size), piece[word, start]))
        end, word, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((size, word, end))
        return end[order], word[order], size[order], piece[order]

    def _together(self, words: list[str]) -> list[list[int]]:
        n, length = len(words), np.array([len(w) for w in words], np.int64)
        longest = int(length.max())
        chars = np.frombuffer("".join(w.ljust(longest, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(n, longest).astype(np.uint64)
        ends, rows_, sizes, pieces = self._probe(chars, length)
        at = np.searchsorted(ends, np.arange(longest + 2))
        gain = np.where(pieces >= 0, self.scores[np.maximum(pieces, 0)], -1e6)
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        last, back = np.full((longest + 1, n), -1, np.int64), np.zeros((longest + 1, n), np.int16)
        for end in range(1, longest + 1):
            s = slice(at[end], at[end + 1])
            row, size, piece = rows_[s], sizes[s], pieces[s]
            value = best[end - size, row] + gain[s]
            ok = np.isfinite(value)
            if self.bpe:
                real = np.flatnonzero(ok & (piece >= 0))
                ok[real] = self._fits(last[end - size[real], row[real]], piece[real])
            row, size, piece, value = row[ok], size[ok], piece[ok], value[ok]
            if not len(row):
                continue
            # the first of the best of each word: sorted by word, and of one word by size
            first = np.flatnonzero(np.diff(row, prepend=-1))
            top = np.maximum.reduceat(value, first)
            k = np.flatnonzero(value == np.repeat(top, np.diff(np.append(first, len(row)))))
            k = k[np.diff(row[k], prepend=-1) != 0]
            best[end, row[k]], last[end, row[k]], back[end, row[k]] = value[k], piece[k], size[k]
        out = []
        for k in range(n):
            ids, end = [], int(length[k])
            if not np.isfinite(best[end, k]):  # no path of compatible pieces
                ids = [i for x in self._merged(words[k]) for i in ([self.ids[x]] if x in self.ids else self._as_bytes(x))]
            else:
                while end:
                    piece = int(last[end, k])
                    ids += [piece] if piece >= 0 else self._as_bytes(words[k][end - 1])[::-1]
                    end -= int(back[end, k])
                ids.reverse()
            out.append(ids)
        return out

    def _as_bytes(self, text: str) -> list[int]:
        return [int(self.byte_ids[b]) for b in text.encode()]

    def _learn(self, keys: np.ndarray, place: np.ndarray, words: list[str]) -> np.ndarray:
        found = self.viterbi(words)
        lengths, n = np.array([len(x) for x in found], np.int64), len(self.at) - 1
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        code = np.arange(n, n + len(words))
        self.known, self.code = np.insert(self.known, place, keys), np.insert(self.code, place, code)
        return code

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts; an empty or null text has none."""
        raw, at = text_buffer(column)
        newline = raw == 10
        breaks = newline.copy()
        breaks[1:] |= newline[:-1]
        breaks[1:] |= (raw[:-1] < 128) & (raw[1:] < 128) & ~self.joins_ascii[raw[:-1], raw[1:]]
        if (raw >= 128).any():
            starts = np.flatnonzero((raw & 0xC0) != 0x80)
            chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
            wide = np.flatnonzero((chars[:-1] >= 128) | (chars[1:] >= 128))
            pair = chars[wide] << 32 | chars[wide + 1]
            there = self.joins[np.minimum(np.searchsorted(self.joins, pair), len(self.joins) - 1)] == pair
            breaks[starts[wide[~there] + 1]] = True
        words = Words(raw, at, _ONLY_SPACE, _IDENTITY, breaks)
        n, text = len(words), words.texts()
        gap = words.starts - np.concatenate([[0], words.ends[:-1]]) if n else np.zeros(0, np.int64)
        first = words.at[:-1][np.diff(words.at) > 0]
        gap[first] = words.starts[first] - at[text[first]] + 1  # with the dummy prefix
        tail = np.diff(at) + (np.diff(at) > 0)  # spaces after the last word; without a word, all and the prefix
        some = np.flatnonzero(np.diff(words.at))
        tail[some] = at[some + 1] - words.ends[words.at[some + 1] - 1]
        keys = np.where(gap > 0, mix(words.hashes ^ _PREFIXED), words.hashes)
        if len(self.known) > MEMORY_WORDS:
            self.forget()
        unique, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        there = np.minimum(place, max(len(self.known) - 1, 0))
        code = np.where(self.known[there] == unique, self.code[there], -1) if len(self.known) else np.full(len(unique), -1)
        new = np.flatnonzero(code < 0)
        if len(new):
            data, at_new = raw.tobytes(), where[new]
            spelled = [(SPACE if g > 0 else "") + data[a:b].decode() for a, b, g in zip(words.starts[at_new].tolist(), words.ends[at_new].tolist(), gap[at_new].tolist(), strict=True)]
            code[new] = self._learn(unique[new], place[new], spelled)
        size = (self.at[code + 1] - self.at[code])[inverse]
        start = self.at[code][inverse]
        # runs of spaces before a word (all but the last, which is the word's own unless it joins nothing there), and at the end of a text
        bare = (gap > 1) & (self.flat[start] == self.ids[SPACE]) if n else np.zeros(0, bool)
        runs = np.where(gap > 1, gap - 1 + bare, 0)
        size, start = size - bare, start + bare
        run_ids = {int(k): np.array([self.ids[x] for x in self._merged(SPACE * int(k))], np.int32) for k in np.unique(np.concatenate([runs, tail])) if k}
        run_size = np.array([len(run_ids[k]) if k else 0 for k in runs.tolist()], np.int64)
        tail_size = np.array([len(run_ids[k]) if k else 0 for k in tail.tolist()], np.int64)
        ends = np.concatenate([[0], np.cumsum(size + run_size)])
        out_at = np.concatenate([[0], np.cumsum(ends[words.at[1:]] - ends[words.at[:-1]] + tail_size)])
        begin = ends[:-1] + (out_at[:-1] - ends[words.at[:-1]])[text] if n else np.zeros(0, np.int64)
        out = np.zeros(out_at[-1], np.int32)
        total = np.concatenate([[0], np.cumsum(size)])
        ramp = np.arange(total[-1])
        out[np.repeat(begin + run_size - total[:-1], size) + ramp] = self.flat[np.repeat(start - total[:-1], size) + ramp]
        for k in np.flatnonzero(runs):
            out[begin[k] : begin[k] + run_size[k]] = run_ids[int(runs[k])]
        for k in np.flatnonzero(tail):
            out[out_at[k + 1] - tail_size[k] : out_at[k + 1]] = run_ids[int(tail[k])]
        return out, out_at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of lists of ids; the dummy prefix goes. Bytes that are no UTF-8 become U+FFFD."""
        size = self.piece_at[ids + 1] - self.piece_at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_bytes[np.repeat(self.piece_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        bounds = ends[at].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.array([t[1:] if t[:1] == " " else t for t in texts], pa.string())


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, bpe: bool = True) -> Codec:
    """A worker's codec for a model; it outlives the task, with what it has learned."""
    if (path, bpe) not in _codecs:
        _codecs[path, bpe] = Codec(path, bpe)
    return _codecs[path, bpe]


def encode(docs: DataFrame, model: str, bpe: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text; other columns are ignored).

    A null text has null ids, an empty one none. Repeated rows and null ids of documents are encoded as any other.
    An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in chunks(batches, CHUNK):
            ids, at = codec(model, bpe).encode(rows.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids), mask=rows.column("text").is_null())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) for every row of encoded (doc_id, ids); null ids give a null text, no ids an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("ids")
            filled = lists.fill_null([]) if lists.null_count else lists
            at = np.concatenate([[0], np.cumsum(filled.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = codec(model).decode(filled.flatten().to_numpy(zero_copy_only=False), at)
            if lists.null_count:
                texts = pa.array([t if ok else None for t, ok in zip(texts.to_pylist(), lists.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, bpe: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_crc32, same) for every row: of encode()'s ids, and of the text that decode() makes of them.

    A null text counts as an empty one. Repeated rows and rows without an id have a row each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in chunks(batches, CHUNK):
            c = codec(model, bpe)
            ids, at = c.encode(rows.column("text"))
            texts = c.decode(ids, at).to_pylist()
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            same = [t == (w or "") for t, w in zip(texts, rows.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "text_crc32", "same"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, same boolean")
