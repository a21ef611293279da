"""Byte-level BPE by a table of distinct words.

Spark splits texts into words (a regular expression in the JVM). A task turns the words of its rows, block by block,
into codes into the block's own list of distinct words, so that a word is shuffled once for a block and not for each of its
places. The lists, dealt by the words' hashes, are the table of distinct words: all blocks' copies of a word meet in one bucket,
where the tokenizers library encodes it once and its ids go back to each block. Then a block's rows meet its list again, and
ids take the places of codes. Decoding is the same with ids for codes: a block's distinct ids are joined to the table of
pieces, and the pieces take the places of the ids.

What is shuffled is packed: many words, or the codes of many rows, are one compressed value, with small numbers in few bytes.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bytetext import groups, text_buffer

#: A block ends when it has so many words; one row's are never parted.
BLOCK_WORDS = 4_000_000
#: Buckets of the table of distinct words for each part of the input, and at least; a part has some hundred thousand distinct words.
BUCKETS, LEAST_BUCKETS = 4, 64
#: Words of a list in one row.
LISTED_WORDS = 500_000
#: Words whose ids are put in their places at once; one row's are never parted.
ASSEMBLED = 200_000

# White space, and how byte-level tokenizers cut a text to words.
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: What a row of a block is; a block's lists come before its documents.
LISTED, PIECE, DOCUMENT = 0, 1, 2
_BLOCK = "block long, kind int, key int, value binary"

#: A Python worker's tokenizers, which outlive its tasks.
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return _loaded[path]


def _added(path: str) -> list[str]:
    """The added tokens, longest first; they must be plain, and the words those of the byte-level expression."""
    import json

    said = json.loads(tokenizer(path).to_str())
    if said["normalizer"] or said["post_processor"] and said["post_processor"]["type"] != "ByteLevel" or said["pre_tokenizer"] != said["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
        raise ValueError("not a plain byte-level tokenizer")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"]):
        raise ValueError("an added token takes more than its own text")
    return sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)


def split_words(text: Column, added: list[str]) -> Column:
    """array<string>: the words that are encoded each on its own; added tokens are words. Joined they are the text.

    A text with a character that the JVM's Unicode version doesn't know is one word, as the tokenizer may know it.
    """
    every = lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    out = every(text)
    if added:
        some = "|".join(re.escape(a) for a in added)
        # an odd place of what is split is an added token
        marked = F.split(F.regexp_replace(text, some, "\u0001$0\u0001"), "\u0001", -1)
        parts = F.flatten(F.transform(marked, lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(every(x))))
        has = text.rlike(some)
        # a text that holds the mark itself goes whole
        out = F.when(has & F.contains(text, F.lit("\u0001")), F.array(text)).when(has, parts).otherwise(out)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(text.rlike(r"\p{Cn}"), F.array(text)).otherwise(out)


def _short(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many for each): numbers under 2**28 in one to four bytes, seven bits in each, all but a number's last marked."""
    n = numbers.astype(np.int64)
    size = 1 + (n >= 1 << 7) + (n >= 1 << 14) + (n >= 1 << 21)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(4):
        some = size > k
        out[at[some] + k] = (n[some] >> 7 * k & 0x7F) | np.where(size[some] > k + 1, 0x80, 0)
    return out, size


def _long(data: np.ndarray) -> np.ndarray:
    """The numbers that _short() wrote."""
    last = np.flatnonzero(data < 0x80)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        some = np.flatnonzero(first + k <= last)
        out[some] |= (data[first[some] + k].astype(np.int64) & 0x7F) << 7 * k
    return out


def _packed(*parts: np.ndarray) -> bytes:
    """Arrays of bytes as one compressed value."""
    raw = np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(p.tobytes() for p in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(value: bytes) -> list[np.ndarray]:
    value = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(value[:4], "little")
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(value, "<u4", n, 4)).astype(int)
    return [np.frombuffer(value, np.uint8, b - a, a) for a, b in zip([4 * (n + 1), *ends[:-1]], ends, strict=True)]


def _pack_words(words: pa.Array, which: np.ndarray) -> list[np.ndarray]:
    """Sizes and bytes of some of the words (large_binary, without nulls)."""
    raw, at = text_buffer(words)
    where, size = _gather(raw, at, which)
    return [_short(size)[0], where]


def _words_of(size: np.ndarray, raw: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(_long(size))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw.tobytes())])


def _pack_documents(doc: pa.Array, codes: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    """The ids and codes of documents, some at once, as values."""
    ids, none = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(at, at[i] + ASSEMBLED, "right")) - 1)
        yield _packed(ids[i:j].view(np.uint8), none[i:j].view(np.uint8), _short(np.diff(at[i : j + 1]))[0], _short(codes[at[i] : at[j]])[0])
        i = j


def _rows(block: int, kind: int, values: list | pa.Array, key: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(values)
    made = [pa.array(np.full(n, block, np.int64)), pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int32()) if key is None else pa.array(key, pa.int32()), pa.array(values, pa.binary())]
    return pa.RecordBatch.from_arrays(made, ["block", "kind", "key", "value"])


def _blocks(batches: Iterator[pa.RecordBatch], words: bool) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, items: words or ids) as blocks: each row's codes, and the block's distinct items.

    Of words the code is the place in the block's list; an id is its own code.
    """
    block, held, total = TaskContext.get().partitionId() << 40, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        lists = [b.column("items") for b in held]
        flat = pa.chunked_array([x.flatten() for x in lists], pa.large_string() if words else pa.int32()).combine_chunks()
        size = np.concatenate([np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for x in lists])
        at = np.concatenate([[0], np.cumsum(size)])
        if words:
            coded = flat.dictionary_encode()
            del flat
            codes, listed = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            # frequent words have small codes
            order = np.argsort(-np.bincount(codes, minlength=len(listed)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            codes = place[codes]
            values = [_packed(*_pack_words(listed, order[i : i + LISTED_WORDS])) for i in range(0, len(order), LISTED_WORDS)]
            yield _rows(block, LISTED, values, np.arange(0, len(order), LISTED_WORDS))
        else:
            codes = flat.to_numpy(zero_copy_only=False)
            found = np.unique(codes)
            yield _rows(block, PIECE, pa.nulls(len(found), pa.binary()), found)
        doc = pa.concat_arrays([b.column("doc_id") for b in held])
        held.clear()
        for value in _pack_documents(doc, codes, at):
            yield _rows(block, DOCUMENT, [value])

    for batch in batches:
        batch = batch.set_column(1, "items", batch.column("items").cast(pa.large_list(pa.large_string() if words else pa.int32())))
        ends = np.cumsum(np.nan_to_num(batch.column("items").value_lengths().to_numpy(zero_copy_only=False)))
        i = 0
        while i < batch.num_rows:
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + BLOCK_WORDS - total, "right")))
            held.append(batch.slice(i, j - i))
            total += int(ends[j - 1] - done)
            i = j
            if total >= BLOCK_WORDS:
                yield from flush()
                block, held, total = block + 1, [], 0
    if held:
        yield from flush()
    pa.default_memory_pool().release_unused()


def _dealer(buckets: int):
    """Blocks with a column deal: a list's words fall into rows by their bucket, documents are spread by numbers of their own, below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in _blocks(batches, True):
            if not batch.num_rows:
                continue
            if batch.column("kind")[0].as_py() == DOCUMENT:
                deal = -1 - number - np.arange(batch.num_rows)
                number += batch.num_rows
                yield _dealt(batch, deal)
                continue
            for block, first, value in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "value")), strict=True):
                words = _words_of(*_unpacked(value))
                bucket = np.array([zlib.crc32(w) % buckets for w in words.cast(pa.large_binary()).to_pylist()])
                order = np.argsort(bucket, kind="stable")
                names, at = np.unique(bucket[order], return_index=True)
                parts = [order[a:b] for a, b in zip(at, [*at[1:], len(order)], strict=True)]
                yield _dealt(_rows(block, LISTED, [_packed(_short(np.diff(which, prepend=-first))[0], *_pack_words(words, which)) for which in parts]), names)

    return run


def _dealt(rows: pa.RecordBatch, deal: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(deal, pa.int64())], [*rows.schema.names, "deal"])


def _encoder(path: str):
    """Buckets of the table of distinct words, sorted by deal: each word is encoded once, and its ids go to every block that has it (value: keys, sizes, ids).

    Before the first row with an id there is one of kind PIECE for it, once in a task. Documents go through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        seen = np.zeros(t.get_vocab_size(with_added_tokens=True), bool)
        for table in groups(batches, ["deal"]):
            documents = table.column("deal").to_numpy() < 0
            if documents.any():
                yield from table.filter(pa.array(documents)).select(["block", "kind", "key", "value"]).to_batches()
                table = table.filter(pa.array(~documents))
            if not table.num_rows:
                continue
            parts = [_unpacked(v) for v in table.column("value").to_pylist()]
            lists = [_words_of(size, raw) for _, size, raw in parts]
            ends = np.cumsum([len(x) for x in lists])
            coded = pa.concat_arrays(lists).dictionary_encode()
            code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            found = []
            for i in range(0, len(words), 20_000):
                found += [np.array(e.ids, "<u4") for e in t.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)]
            at, flat = np.concatenate([[0], np.cumsum([len(x) for x in found])]), np.concatenate(found)
            new = np.unique(flat)
            new = new[~seen[new]]
            seen[new] = True
            yield _rows(-1, PIECE, pa.nulls(len(new), pa.binary()), new)
            for block, (keys, _, _), end, words in zip(table.column("block").to_pylist(), parts, ends, lists, strict=True):
                ids, size = _gather(flat, at, code[end - len(words) : end])
                yield _rows(block, LISTED, [_packed(keys, _short(size)[0], _short(ids)[0])])
    return run


def _binder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with the pieces of their ids (value: keys, sizes, ids, distinct ids, sizes and bytes of their pieces), from the task's rows of kind PIECE before them."""
    known: dict[int, bytes] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.diff(kind)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            if a < b and kind[a] == PIECE:
                known |= {k: v or b"" for k, v in zip(part.column("key").to_pylist(), part.column("value").to_pylist(), strict=True)}
            elif a < b and kind[a] == LISTED:
                bound = []
                for value in part.column("value").to_pylist():
                    keys, size, ids = _unpacked(value)
                    own = np.unique(_long(ids))
                    pieces = [known[i] for i in own.tolist()]
                    bound.append(_packed(keys, size, ids, _short(np.diff(own, prepend=0))[0], _short(np.array([len(x) for x in pieces], np.int64))[0], np.frombuffer(b"".join(pieces), np.uint8)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(bound, pa.binary())], part.schema.names)
            elif a < b:
                yield part


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece binary): the bytes that each id of the tokenizer stands for. As long as its vocabulary, whatever the data."""
    # the printable bytes stand for themselves, the others for the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    rows = [(i, bytearray(byte[c] for c in piece) if all(c in byte for c in piece) else bytearray(piece.encode())) for piece, i in tokenizer(path).get_vocab(with_added_tokens=True).items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[at[k]:at[k + 1]] of each k in which, joined, and their sizes."""
    size = (at[1:] - at[:-1])[which]
    shift = np.repeat(at[:-1][which] - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(len(shift))], size


def _by_key(rows: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    for b in rows:
        key, values = b.column("key").to_numpy(), b.column("value").to_pylist()
        order = np.argsort(key)
        yield key[order].astype(np.int64), [values[i] for i in order.tolist()]


class _Lists:
    """A block's list, from its rows: for each key a slice of one array. A list's rows hold the ids of words, and may hold the pieces of ids."""

    def __init__(self, listed: list[pa.RecordBatch], rows: list[pa.RecordBatch], pieces: bool):
        parts = [_unpacked(v) for b in listed for v in b.column("value").to_pylist()]
        if pieces:
            parts = [x[3:] for x in parts]
            # rows of their own, as decode() has them
            parts += [[_short(np.diff(k, prepend=0))[0], _short(np.array([len(v or b"") for v in values], np.int64))[0], np.frombuffer(b"".join(v or b"" for v in values), np.uint8)] for k, values in _by_key(rows)]
        key = np.concatenate([np.cumsum(_long(x[0])) for x in parts] or [np.zeros(0, np.int64)])
        sizes = np.concatenate([_long(x[1]) for x in parts] or [np.zeros(0, np.int64)])
        flat = np.concatenate([x[2] if pieces else _long(x[2]).astype(np.int32) for x in parts] or [np.zeros(0, np.uint8)])
        # several rows may tell of a piece
        key, order = np.unique(key, return_index=True)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = _gather(flat, ends, order)[0]
        size = np.zeros(int(key[-1]) + 1 if len(key) else 0, np.int64)
        size[key] = sizes[order]
        self.at = np.concatenate([[0], np.cumsum(size)])

    def put(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the keys stand for, joined, and how much each gave; a key that isn't listed gives nothing."""
        known = codes < len(self.at) - 1
        if known.all():
            return _gather(self.flat, self.at, codes)
        size = np.zeros(len(codes), np.int64)
        out, size[known] = _gather(self.flat, self.at, codes[known])
        return out, size


def _assembler(encode: bool, decode: bool, digest: bool):
    """Blocks, sorted by block and kind, back to documents: codes to ids (encode), ids to text (decode), or digests of both."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lists, words, pieces = None, {LISTED: [], PIECE: []}, None, None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if block[a] != current:
                    current, lists, words, pieces = block[a], {LISTED: [], PIECE: []}, None, None
                if kind[a] != DOCUMENT:
                    lists[int(kind[a])].append(part)
                    continue
                if words is None:
                    words, pieces = _Lists(lists[LISTED], [], False) if encode else None, _Lists(lists[LISTED], lists[PIECE], True) if decode else None
                    lists = {LISTED: [], PIECE: []}
                for value in part.column("value").to_pylist():
                    yield documents(*_unpacked(value), words, pieces)

    def documents(doc: np.ndarray, none: np.ndarray, sizes: np.ndarray, codes: np.ndarray, words: _Lists | None, pieces: _Lists | None) -> pa.RecordBatch:
        doc = pa.array(doc.view(np.int64), pa.int64(), mask=none.astype(bool))
        ids, at = _long(codes), np.concatenate([[0], np.cumsum(_long(sizes))])
        if words:
            ids, size = words.put(ids)
            at = np.concatenate([[0], np.cumsum(size)])[at]
        out = {"doc_id": doc}
        if encode and digest:
            out |= {"n_tokens": pa.array(np.diff(at), pa.int64()), "ids_sha256": pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)])}
        elif encode:
            out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
        if decode:
            raw, size = pieces.put(ids)
            at = np.concatenate([[0], np.cumsum(size)])[at]
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            out |= {"decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])} if digest else {"text": pa.array(texts, pa.string())}
        return pa.RecordBatch.from_pydict(out)

    schema = "doc_id long" + (", n_tokens long, ids_sha256 string" if digest else ", ids array<int>") * encode + (", decoded_sha256 string" if digest else ", text string") * decode
    return run, schema


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    """Blocks (block, kind, key, value): lists with the ids of each word, rows of kind PIECE for the ids that a task has, and documents.

    One pass over the texts and one shuffle: lists meet by bucket, documents are dealt evenly beside them.
    """
    items = docs.select(docs["doc_id"].cast("long").alias("doc_id"), split_words(docs["text"].cast("string"), _added(path)).alias("items"))
    buckets = max(LEAST_BUCKETS, BUCKETS * docs.rdd.getNumPartitions())
    dealt = items.mapInArrow(_dealer(buckets), f"{_BLOCK}, deal long").repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(_encoder(path), _BLOCK)


def _with_pieces(rows: DataFrame, path: str) -> DataFrame:
    """Blocks whose rows of kind PIECE have the piece of their id, by a join with the table of pieces, whose size the vocabulary bounds."""
    table = F.broadcast(piece_table(rows.sparkSession, path)).withColumn("kind", F.lit(PIECE)).withColumnRenamed("id", "key")
    return rows.join(table, ["kind", "key"], "left").select("block", "kind", "key", F.coalesce("value", "piece").alias("value"))


def _together(rows: DataFrame, encode: bool, decode: bool, digest: bool) -> DataFrame:
    run, schema = _assembler(encode, decode, digest)
    return rows.select("block", "kind", "key", "value").repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids of the texts of docs (doc_id, text) by the byte-level BPE of a tokenizers file, no special tokens added.

    The text of an added token is that token's id. Every row is encoded on its own, rows with equal ids or texts too; a null
    or empty text has no ids; a null doc_id stays null. Other columns are ignored. An empty table gives an empty result.
    One text is held whole, with some twenty bytes for each of its bytes.
    """
    return _together(_encoded(docs, path).where(f"kind <> {PIECE}"), True, False, False)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the texts of the ids of rows (doc_id, ids array<int>), special tokens kept.

    Null or empty ids give an empty text, ids that the vocabulary hasn't nothing, and bytes that aren't UTF-8 the replacement character.
    """
    items = rows.select(rows["doc_id"].cast("long").alias("doc_id"), F.filter(F.coalesce("ids", F.array().cast("array<int>")), lambda x: x >= 0).alias("items"))
    return _together(_with_pieces(items.mapInArrow(lambda batches: _blocks(batches, False), _BLOCK), path), False, True, False)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs (doc_id, text): encode(), and decode() of its ids, in one pass over the blocks.

    Nulls, empties and repeated rows as in encode().
    """
    return _together(_with_pieces(_encoded(docs, path), path).mapInArrow(_binder, _BLOCK), True, True, True)
