"""Ranked lexical search, periodic runs and byte-level BPE against plain versions."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paperlane.llm import bpe_codec, lexical_search, periodic_runs, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
BPE = queries.tokenizer_path("byte_bpe_50k.json")
AWKWARD = "doc_id long, text string, n string, terms string, items string, block string, query string, rank string"


def awkward(spark, rows):
    """Documents with columns that are named as those inside."""
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], AWKWARD)


# ---- ranked lexical search ----------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return collections.Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))


def plain_search(docs, items, k=10):
    counted = [(i, c) for i, t in docs if (c := terms_of(t))]
    total, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = {}
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 25 + 75 * sum(c.values()) * total // length
            score = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in terms_of(text).items() if t in c)
            found += [(-score, doc is None, doc or 0)] * (score > 0)
        out[item] = [(None if none else doc, -s) for s, none, doc in sorted(found)[:k]]
    return out


def ranked(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.item_id, r.rank)):
        out[r.item_id].append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


def made(n, seed):
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    text = lambda: " ".join(words[min(299, int(r.expovariate(0.03)))] + r.choice(["", ",", "."]) for _ in range(r.randrange(60)))
    docs = [(i, text()) for i in range(n)]
    return docs + [(n + i, docs[i % 40][1]) for i in range(60)], [(i, text()) for i in range(40)]


def test_lexical_search_against_plain_scores(spark):
    docs, items = made(400, 1)
    docs += [(900, None), (901, ""), (902, "?!"), (None, docs[5][1]), (7, docs[7][1]), (903, "w1 " * 100_000)]
    items += [(90, None), (91, "unheard"), (92, "w1 w1 w1"), (93, docs[5][1])]
    got = ranked(lexical_search.search(awkward(spark, docs), spark.createDataFrame([(*i, 1) for i in [*items, items[0]]], "item_id long, text string, doc_id long")).collect())
    want = plain_search(docs, items)
    assert {k: got[k] for k in want} == want


def test_lexical_search_of_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert ranked(queries.op11_lexical(spark, SF).collect()) == want
    assert lexical_search.search(docs.limit(0), items).count() == 0 == lexical_search.search(docs, items.limit(0)).count()


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    """Small shards and blocks in one process: the same results, and fewer documents scored than have a term of the query."""
    for name, value in (("SHARD_DOCS", 500), ("BLOCK", 8), ("LONG", 0.2)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = made(3000, 2)
    items = [(i, docs[17 * i][1]) for i in range(40)]
    scored = []
    monkeypatch.setattr(lexical_search.Shard, "score", lambda self, d, w, f=lexical_search.Shard.score: scored.append(len(d)) or f(self, d, w))
    batch = pa.RecordBatch.from_pydict({"item_id": pa.array([i for i, _ in items]), "text": pa.array([t for _, t in items])})
    asked = next(lexical_search._query_terms([batch]))
    hashes = np.array(asked.column("terms").flatten().to_numpy(), np.int64).view(np.uint64)
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in docs]), "text": pa.array([t for _, t in docs])})
    forward = list(lexical_search._forward(vocabulary)([batch]))
    total, length = sum(b.num_rows for b in forward), sum(sum(b.column("n").to_pylist()) for b in forward)
    df = np.bincount(np.concatenate([b.column("terms").flatten().to_numpy() for b in forward]), minlength=len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()])
    run = lexical_search._searcher([i for i, _ in items], np.concatenate([[0], np.cumsum(asked.column("terms").value_lengths().to_numpy())]), terms, asked.column("times").flatten().to_numpy(), weights, total, length, 10)
    got = collections.defaultdict(list)
    for r in next(run(iter(forward))).to_pylist():
        got[r["item_id"]].append((r["doc_id"], r["score"]))
    assert got == plain_search(docs, items)
    held = [set(terms_of(t)) for _, t in docs]
    assert sum(scored) < 0.75 * sum(not h.isdisjoint(terms_of(t)) for _, t in items for h in held)


# ---- periodic runs ------------------------------------------------------------------------------


def plain_runs(words, least=6, periods=4):
    out, n = {}, len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc, text, planted=True):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(doc).encode())
    if planted and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    listed = "".join("%d,%d,%d\n" % r for r in found)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_plain_search(seed):
    r = random.Random(seed)
    for _ in range(400):
        n, k = r.randrange(70), r.choice([1, 2, 3, 5])
        w = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.6:
            a, p = r.randrange(n), r.randint(1, 9)
            w[a:] = [w[a + i % min(p, n - a)] for i in range(n - a)]
            if r.random() < 0.5:
                w[r.randrange(n)] = 9
        for least, periods in ((6, 4), (2, 2)):
            start, end, period = periodic_runs.runs_of(np.array([*w, 99], np.uint64), least, periods)
            assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == plain_runs(w, least, periods)


def test_long_periodic_text_is_fast():
    import time

    began = time.process_time()
    w = np.arange(200_001, dtype=np.uint64) % np.uint64(7)
    w[-1] = 99
    assert [x.tolist() for x in periodic_runs.runs_of(w)] == [[0], [200_000], [7]]
    # a Fibonacci word has as many squares as a word can have
    a, b = "x", "xy"
    while len(b) < 100_000:
        a, b = b, b + a
    start, end, period = periodic_runs.runs_of(np.array([*b.encode(), 0], np.uint64), 2, 2)
    assert len(start) > 50_000 and (end - start >= 2 * period).all()
    assert time.process_time() - began < 20


def test_run_digests(spark):
    odd = [(1, None), (2, ""), (3, " \n"), (4, "the the the the the the"), (4, "the the the the the the"), (5, "a b " * 9), (None, "x y " * 4), (6, "é\x0bé\x0cé é\té\né ü"), (7, "ha" * 300_000), (8, "w x y z " * 300), (9, "a a " * 6)]
    plain = [(*r, "x") for r in odd]
    got = periodic_runs.run_digests(spark.createDataFrame(plain, "doc_id long, text string, start string")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(((d, *plain_digest(d, t)) for d, t in odd), key=key)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 8000")
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.run_digests(docs).collect()}
    assert got == {r.doc_id: plain_digest(r.doc_id, r.text) for r in docs.collect()}
    assert sum(r[0] for r in got.values()) and periodic_runs.run_digests(docs.limit(0)).count() == 0


def test_found_runs_are_where_they_say(spark):
    texts = [(1, "so é é é é é é  é end"), (2, "a b c d a b c d  a b c d a b c d a b"), (3, None)]
    got = {r.doc_id: r for r in periodic_runs.find_runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for doc, text in texts[:2]:
        r = got[doc]
        assert text.encode()[r.first_byte : r.end_byte].decode().split() == text.split()[r.start : r.start + r.length]
    assert (got[1].unit, got[2].unit, got[2].period) == ("é", "a b c d", 4) and 3 not in got


# ---- byte-level BPE -----------------------------------------------------------------------------


def test_bpe_against_the_library(spark):
    t = bpe_codec.tokenizer(BPE)
    texts = [None, "", "  ", "a <|endoftext|>  b", "x  <|endoftext|>", "<|endoftext|><|endoftext|>", "a\n\n b\t \n", "it's we'll I'D 12'3 !!! é…", "\U0001fae8 new ͸ thing's  ", "\u0001 x<|endoftext|>\u0001", "日本語 テスト　  x", "!" * 50_000, " " * 50_000 + "a", "ab" * 30_000, "é‍\U0001f469‍\U0001f467   \u0085x"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in rows)
    ids = bpe_codec.encode(awkward(spark, rows), BPE)
    assert sorted((str(r.doc_id), list(r.ids)) for r in ids.collect()) == [w[:2] for w in want]
    assert sorted((str(r.doc_id), r.text) for r in bpe_codec.decode(ids, BPE).collect()) == sorted((w[0], w[2]) for w in want)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digests(awkward(spark, rows), BPE).collect())
    assert got == sorted((i, len(k), sha(np.array(k, "<u4").tobytes()), sha(x.encode())) for i, k, x in want)


def test_bpe_decodes_any_ids(spark):
    t, r = bpe_codec.tokenizer(BPE), random.Random(1)
    rows = [(i, [r.randrange(50_257) for _ in range(r.randrange(40))]) for i in range(300)]
    got = {x.doc_id: x.text for x in bpe_codec.decode(spark.createDataFrame([*rows, (900, None), (901, [99_999, -1, 5])], "doc_id long, ids array<int>"), BPE).collect()}
    assert got == {i: t.decode(x, skip_special_tokens=False) for i, x in rows} | {900: "", 901: t.decode([5])}


def test_bpe_of_tables(spark):
    t = bpe_codec.tokenizer(BPE)
    got = {r.doc_id: r for r in queries.op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(got) == docs.count() and bpe_codec.digests(docs.limit(0), BPE).count() == 0 == bpe_codec.encode(docs.limit(0), BPE).count()


def test_short_numbers():
    n = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152, 2**28 - 1])
    data, size = bpe_codec._short(n)
    assert bpe_codec._long(data).tolist() == n.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    assert len(bpe_codec._long(bpe_codec._short(n[:0])[0])) == 0


def test_bpe_blocks_split_anywhere(monkeypatch):
    """A block ends between any two rows, and one row may be larger than a block."""
    monkeypatch.setattr(bpe_codec, "BLOCK_WORDS", 5)
    monkeypatch.setattr(bpe_codec, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    items = [["a", "b"], [], ["a"] * 12, ["c"], ["a", "c"], None, ["b"]]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(7), pa.int64()), "items": pa.array(items, pa.list_(pa.string()))})
    listed, back = {}, {}
    for b in bpe_codec._blocks(iter([batch.slice(0, 4), batch.slice(4)]), True):
        for r in b.to_pylist():
            if r["kind"] == bpe_codec.LISTED:
                words = bpe_codec._words_of(*bpe_codec._unpacked(r["value"])).to_pylist()
                listed |= {(r["block"], r["key"] + i): w for i, w in enumerate(words)}
            else:
                ids, _, sizes, codes = bpe_codec._unpacked(r["value"])
                words = [listed[r["block"], c] for c in bpe_codec._long(codes).tolist()]
                for doc, size in zip(ids.view(np.int64).tolist(), bpe_codec._long(sizes).tolist(), strict=True):
                    back[doc], words = words[:size], words[size:]
    assert back == {i: x or [] for i, x in enumerate(items)} and len({b for b, _ in listed}) > 1
