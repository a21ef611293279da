"""Removal of repeated runs of lines, cut by their content (DataFrame operations only).

A line begins a new chunk if the rolling hash over its predecessor's hash and its own says so; the
boundary moves with the text, so a passage pasted at another place is cut into the same chunks. A
chunk of at least min_lines lines that stands at more than one place is kept where (doc_id, position)
is least and removed elsewhere. Hashes of 128 bits find the chunks that repeat; only their bytes are then
compared, and only what has the same bytes is one chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .graph import join_counted, settle, stored

#: A line begins a chunk if the last hex digit of the rolling hash is one of these: every second line on average.
BOUNDARY = ("0", "2", "4", "6", "8", "a", "c", "e")


def with_chunks(docs: DataFrame) -> DataFrame:
    """Adds _chunks array<string>: the text's chunks, in which U+0001 is escaped as U+0001 e; joined by line feeds they are the text.

    Each array is the argument of one higher-order function, never read inside a lambda, where it would be computed anew for each element;
    the lines are a column of their own, so that the text is split once and not for each use of them.
    """
    last = ", ".join(f"'{c}'" for c in BOUNDARY)
    begins = f"before IS NOT NULL AND right(md5(concat(md5(before), md5(line))), 1) IN ({last})"
    marked = f"zip_with(_lines, concat(array(cast(null AS string)), _lines), (line, before) -> concat(if({begins}, '\u0001b', ''), replace(line, '\u0001', '\u0001e')))"
    # the second array has one element more: its line is null, and array_join leaves it out
    lines = docs.withColumn("_lines", F.expr("split(coalesce(text, ''), '\\n', -1)"))
    return lines.withColumn("_chunks", F.expr(f"split(array_join({marked}, '\\n'), '\\n\u0001b', -1)")).drop("_lines")


def _hashes(text: str) -> list:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("again"), text).alias("h2")]


def repeated_chunks(docs: DataFrame, min_lines: int = 2, copies: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, chunk) of every chunk to be removed: all but the first of those with the same bytes.

    copies (doc_id, of), a row for each text that goes later and the one of its class that stays, are spared as in passage_dedup. version is a hash of the text, so that rows with equal ids and different texts stay apart.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("version")).where("doc_id is not null and text is not null")
    each = with_chunks(texts).select("doc_id", "version", F.posexplode("_chunks").alias("chunk", "bytes"))
    breaks = F.length("bytes") - F.length(F.replace("bytes", F.lit("\n"), F.lit("")))
    each = each.where((breaks >= min_lines - 1) & (F.length("bytes") > breaks))
    key, place = ["h1", "h2"], F.struct(F.col("of").isNotNull().alias("goes"), "doc_id", "version", "chunk", "of")
    classed = lambda rows: rows.withColumn("of", F.lit(None).cast("long")) if copies is None else rows.join(copies.select("doc_id", "of"), "doc_id", "left")
    places = stored(each.select("doc_id", "version", "chunk", *_hashes("bytes")))
    known = places.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    total = places.count()
    again = settle(join_counted(places, known, key, total))
    # the bytes of what repeats, each text's from one cut of it
    wanted = again.groupBy("doc_id", "version").agg(F.collect_set("chunk").alias("_wanted"))
    cut = with_chunks(classed(texts.join(wanted, ["doc_id", "version"])))
    read = cut.select("doc_id", "version", "of", F.expr("inline(transform(_wanted, c -> struct(c AS chunk, element_at(_chunks, c + 1) AS bytes)))")).select("*", *_hashes("bytes"))
    firsts = settle(read.groupBy(*key, "bytes").agg(F.min(place).alias("first"), F.count("*").alias("_n")))
    kinds = firsts.groupBy(*key).agg(F.count("*").alias("kinds"), F.min("first").alias("first"), F.sum("_n").alias("_n"))
    gone = join_counted(classed(again), kinds.where("kinds = 1").drop("kinds"), key, total)
    if not kinds.where("kinds > 1").isEmpty():  # chunks that share 128 bits and not their bytes
        met = read.join(kinds.where("kinds > 1").select(*key), key, "left_semi")
        gone = gone.unionByName(met.join(firsts.drop("_n"), [*key, "bytes"]).select(gone.columns))
    gone = gone.where("struct(doc_id, version, chunk) <> struct(first.doc_id, first.version, first.chunk)")
    # not what another text of the same class has first
    gone = gone.where("coalesce(of, doc_id) <> coalesce(first.of, first.doc_id) or struct(doc_id, version) = struct(first.doc_id, first.version)")
    return gone.select("doc_id", "version", "chunk").distinct()


def dedup_lines(docs: DataFrame, min_lines: int = 2, copies: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, any other columns) with the repeated chunks removed from text; every row stays.

    Adds removed_chunks int (an own column of that name is replaced). n_chars, if there, is set to the new
    length. A text all of whose chunks stand elsewhere first becomes empty. Null texts stay null; rows whose
    doc_id is null are not touched. Rows with the same doc_id and text are one text given twice, and are cut
    alike. copies is as in dedup_passages(). Blank chunks and chunks of fewer than min_lines lines stay. An empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c != "removed_chunks"]
    gone = settle(repeated_chunks(docs, min_lines, copies)).groupBy("doc_id", "version").agg(F.collect_set("chunk").alias("_gone"))
    # the text isn't in _row as well: both would go through the shuffle
    rest = F.struct(F.lit(0), *[c for c in columns if c not in ("doc_id", "text")]).alias("_row")
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.col("text"), rest)
    cut = with_chunks(rows.join(gone, ["doc_id", "version"], "left"))
    kept = F.expr("replace(array_join(filter(_chunks, (c, i) -> NOT array_contains(_gone, i)), '\\n'), '\u0001e', '\u0001')")
    text = F.when(F.col("_gone").isNotNull(), kept).otherwise(F.col("text"))
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.when(F.col("_gone").isNotNull(), F.length(text).cast("long")).otherwise(F.col("_row.n_chars"))}
    out = [made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns]
    return cut.select(*out, F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(0).alias("removed_chunks"))


#: DuckDB SQL for dedup_lines over a table {docs} (doc_id, text).
SQL = """
WITH l AS (
  SELECT doc_id, pos - 1 AS pos, lines[pos] AS line FROM (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {docs} WHERE text IS NOT NULL))),
b AS (
  SELECT *, CASE WHEN pos = 0 OR right(md5(md5(lag(line) OVER w) || md5(line)), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE 0 END AS starts
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk FROM b),
c AS (SELECT doc_id, chunk, count(*) AS k, string_agg(line, chr(10) ORDER BY pos) AS bytes, bool_or(line <> '') AS filled FROM n GROUP BY doc_id, chunk),
r AS (
  SELECT *, k >= 2 AND filled AND row_number() OVER (PARTITION BY bytes, k >= 2 AND filled ORDER BY doc_id, chunk) > 1 AS gone
  FROM c),
d AS (
  SELECT doc_id, coalesce(string_agg(bytes, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS removed_chunks
  FROM r GROUP BY doc_id)
"""
