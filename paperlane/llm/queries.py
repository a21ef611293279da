"""The numbered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_codec, conversations, lexical_search, licenses, line_dedup, metric_join, near_dedup, packing, periodic_runs, permutation_index, quality, sentencepiece_codec, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in $TOKENIZERS_DIR, or where the installed package has it (the same on every executor)."""
    if "TOKENIZERS_DIR" in os.environ:
        return os.path.join(os.environ["TOKENIZERS_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False, with_crc=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lang", "source", "n_chars", "removed_chunks")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = conversations.in_reply_order(conversations.link_replies(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "position", "turn", "role", F.col("body").alias("content"), "reply_conv", "reply_turn")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_toxicity, op3_quality, op4_nearest, op5_near_dedup, op6_line_dedup, op7_licenses, op8_sentencepiece, op9_metric_join, op10_conversations, op11_lexical, op12_runs, op13_bpe)
}

ORACLES: dict[str, str] = {
    "op6_line_dedup": line_dedup.SQL.format(docs="documents")
    + """
SELECT o.doc_id, CASE WHEN coalesce(d.removed_chunks, 0) > 0 THEN d.text ELSE o.text END AS text, o.lang, o.source,
  CASE WHEN coalesce(d.removed_chunks, 0) > 0 THEN length(d.text) ELSE o.n_chars END AS n_chars, coalesce(d.removed_chunks, 0)::INTEGER AS removed_chunks
FROM documents o LEFT JOIN d USING (doc_id)
""",
    "op9_metric_join": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = vec_id) AS component_id,
  vec_id = (SELECT min(b) FROM r WHERE r.a = vec_id) AS kept
FROM v
""",
    "op10_conversations": conversations.SQL,
    "op11_lexical": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY doc_id, t),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM d),
df AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t, n_docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total))))::BIGINT AS score FROM q JOIN tf USING (t) JOIN df USING (t) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
""",
}
