"""Passages, and the inverted index of each document: windows, postings, lengths, document frequencies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

SIZE, OVERLAP = 90, 30

#: Bytes of files for each part of by_document(): the terms of its documents' passages take some thirty times as much memory. No file is as large as an unknown size.
PART_BYTES, UNKNOWN_BYTES = 1 << 20, 1 << 55


def pages_of(documents: DataFrame) -> DataFrame:
    """Each document as one page."""
    return documents.select("doc_id", F.lit(0).alias("page_pos"), F.lit(1).alias("number"), F.lit("part 1").alias("label"), F.coalesce("text", F.lit("")).alias("text"))


def parts_of(rows: DataFrame) -> int:
    """Into how many parts rows are dealt so that a part's memory doesn't grow with the table: by the size that Spark knows from the files, else as the session has it."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // PART_BYTES) if size < UNKNOWN_BYTES else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_document(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """pages, dealt by document; what is grouped by document, or joined with another table so dealt into as many parts, stays where it is."""
    return pages.repartition(parts or parts_of(pages), "doc_id")


@dataclass(frozen=True)
class _Cut:
    """pages with the blocks of words that their windows are made of (_b), the number of their words (_n), and expressions on these: the number of windows, one of them, and the first and the last window that a block is in."""

    rows: DataFrame
    count: Column
    window: Callable[[Column], Column]
    first: Callable[[Column], Column]
    last: Callable[[Column], Column]


def _windows(pages: DataFrame, size: int, overlap: int, only: Column | None = None) -> _Cut:
    """How pages are cut; those for which only isn't true aren't, and have no window."""
    step = max(20, size - overlap)
    unit = gcd(size, step)
    # white space to one space; single spaces, the most of it, are left as they are
    blocks = F.expr(rf"regexp_extract_all(regexp_replace(text, r'\s{{2,}}|[^\S ]', ' '), r'[^ ]++(?: [^ ]++){{0,{unit - 1}}}+', 0)")
    cut = pages.withColumn("_b", blocks if only is None else F.when(only, blocks))
    n = F.when(F.size("_b") > 0, (F.size("_b") - 1) * unit + F.size(F.split(F.element_at("_b", -1), " "))).otherwise(0)
    short = F.col("_n") <= size + overlap // 2
    full = F.ceil((F.col("_n") - size) / step).cast("int") + 1
    # a tail of under 30 words is dropped unless it is all there is
    last = F.least(F.col("_n") - (full - 1) * step, F.lit(size))
    count = F.when(F.col("_n") == 0, 0).when(short, 1).otherwise(F.when(last < 30, F.greatest(full - 1, F.lit(1))).otherwise(full))
    per_step, per_window = step // unit, size // unit
    return _Cut(
        cut.withColumn("_n", n),
        count,
        lambda i: F.when(short, F.regexp_replace("text", r"^\s+|\s+$", "")).otherwise(F.array_join(F.slice("_b", i * per_step + 1, F.lit(per_window)), " ")),
        lambda i: F.when(short, 0).otherwise(F.greatest(F.lit(0), F.floor((i - per_window + per_step) / per_step).cast("int"))),
        lambda i: F.when(short, 0).otherwise(F.least(count - 1, F.floor(i / per_step).cast("int"))),
    )


def passages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, one_page: bool = False) -> DataFrame:
    """(doc_id, passage_idx, number, label, text): overlapping windows of each page's words; a short page is one passage, verbatim.

    Windows are numbered through a document. A page's windows follow from its word count alone, so their
    numbers come from a running sum over its pages, not over its windows. With one_page every row of pages is a
    document of its own, and nothing is shuffled.

    Text is cut to blocks of as many words as divide both the width and the step of a window; a window joins a
    few blocks, so that a long page costs no more for each word than a short one. Arrays are exploded with their
    empties, which are filtered after: an inner explode is given a filter on the array's size before it, and that
    computes the array from the text again.
    """
    cut = _windows(pages.select("doc_id", "page_pos", "number", "label", "text"), size, overlap)
    windows = F.when(F.col("_n") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), cut.count - 1), cut.window))
    made = cut.rows.select("doc_id", "page_pos", "number", "label", windows.alias("_w"))
    if one_page:
        return made.select("doc_id", "number", "label", F.posexplode_outer("_w").alias("passage_idx", "text")).where("text is not null").select("doc_id", "passage_idx", "number", "label", "text")
    # what is summed through a document is a number for each page; its text stays where it is
    counted = cut.rows.select("doc_id", "page_pos", cut.count.alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("doc_id").orderBy("page_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select("doc_id", "page_pos", before.alias("_before"))
    rows = made.join(placed, ["doc_id", "page_pos"]).select("doc_id", "number", "label", "_before", F.posexplode_outer("_w").alias("_i", "text")).where("text is not null")
    return rows.select("doc_id", (F.col("_before") + F.col("_i")).cast("int").alias("passage_idx"), "number", "label", "text")


def passage_texts(keys: DataFrame, pages: DataFrame, only: str | None = None) -> DataFrame:
    """keys (doc_id, passage_idx, …) with number, label and text of the passage, where every row of pages is a document of its own.

    A document's keys meet its page as one row, and only the windows asked for are put out. Keys without a passage have no row; with only, the
    name of a column, those in which it is null have a row without a text, and a page of which no text is asked isn't cut.
    """
    asked = keys.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in keys.columns if c != "doc_id"])).alias("_keys"))
    wanted = (lambda k: F.lit(True)) if only is None else (lambda k: k[only].isNotNull())
    cut = _windows(pages.select("doc_id", "number", "label", "text").join(asked, "doc_id"), SIZE, OVERLAP, None if only is None else F.exists("_keys", wanted))
    # the number of windows is a column that the lambda reads, and the windows asked for are the only ones that are made
    whole = cut.rows.withColumn("_k", cut.count)
    there = lambda k: wanted(k) & (k["passage_idx"] >= 0) & (k["passage_idx"] < F.col("_k"))
    found = F.transform("_keys", lambda k: F.struct(k.alias("_key"), F.when(there(k), cut.window(k["passage_idx"])).alias("text")))
    rows = whole.select("doc_id", "number", "label", F.inline(found)).select("doc_id", "_key.*", "number", "label", "text")
    return rows.where(F.col("text").isNotNull() | (F.lit(False) if only is None else F.col(only).isNull()))


def token_rows(passages_: DataFrame, stopwords: bool = False) -> DataFrame:
    """(doc_id, passage_idx, pos, term), exploded before stemming so that stems are plain generated code."""
    raw = passages_.select("doc_id", "passage_idx", F.posexplode_outer(T.raw_tokens("text")).alias("pos", "w")).where(T.kept_sql("w", stopwords))
    return raw.select("doc_id", "passage_idx", "pos", F.expr(T.stem_sql("w")).alias("term"))


def postings(passages_: DataFrame) -> DataFrame:
    """(doc_id, term, passage_idx, tf). Of passages that are partitioned by doc_id nothing is shuffled."""
    return token_rows(passages_).groupBy("doc_id", "term", "passage_idx").agg(F.count("*").alias("tf"))


def passage_lengths(passages_: DataFrame) -> DataFrame:
    """(doc_id, passage_idx, len): tokens, at least 1."""
    return passages_.select("doc_id", "passage_idx", F.greatest(F.size(F.filter(T.raw_tokens("text"), lambda x: T._kept(x, False))), F.lit(1)).alias("len"))


def document_stats(lengths: DataFrame) -> DataFrame:
    """(doc_id, n_passages, avg_len)."""
    return lengths.groupBy("doc_id").agg(F.count("*").alias("n_passages"), F.avg("len").alias("avg_len"))


def document_frequency(postings_: DataFrame) -> DataFrame:
    """(doc_id, term, df): the passages of the document that hold the term."""
    return postings_.groupBy("doc_id", "term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, term, df, idf), within each document."""
    joined = df.join(stats, "doc_id")
    return joined.select("doc_id", "term", "df", F.log(1 + (F.col("n_passages") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _blocks(pages: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(doc_id, n_passages, _first, _last, text): blocks of words, each with the first and the last of the passages that share it; every row of pages is a document of its own. With more also the block's place _i and these columns of its page; _page is the text."""
    more = more or []
    cut, i = _windows(pages.withColumn("_page", F.col("text")).select("doc_id", "text", *more), SIZE, OVERLAP), F.col("_i")
    blocks = cut.rows.select("doc_id", "_n", *more, F.posexplode_outer("_b").alias("_i", "text")).where("text is not null")
    return blocks.select("doc_id", cut.count.alias("n_passages"), cut.first(i).alias("_first"), cut.last(i).alias("_last"), "text", *(["_i", *more] if more else [])).where("_first <= _last")


def page_words(pages: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_passages, first, last, words, low, *more): the words of each page in order, some in a row; first to last are the passages that have them.

    The first row of each page, and no other, has low, the page in lower case, and more of its columns: every row of pages is a document of its own, and its rows follow each other.
    Nothing is shuffled or grouped. A row for each word would cost much: Spark measures an Arrow batch anew with each row that it puts in.
    """
    blocks, first = _blocks(pages, ["_page", *more]), F.col("_i") == 0
    return blocks.select("doc_id", "n_passages", F.col("_first").alias("first"), F.col("_last").alias("last"), T.raw_tokens("text").alias("words"), F.when(first, F.lower("_page")).alias("low"), *[F.when(first, F.col(c)).alias(c) for c in more])


def words_held(pages: DataFrame, begin: list[str] | None = None) -> DataFrame:
    """(term), distinct: the terms of all pages; with begin those alone that begin so, with STEM_KEEPS characters each, or are shorter and one of them. Words are told apart before they are stemmed, and pages stay where they are."""
    if begin is not None:
        pages = pages.where(F.exists(F.array(*map(F.lit, begin)), lambda b: F.contains(F.lower("text"), b)))
    words = pages.select(F.explode(T.raw_tokens("text")).alias("w"))
    words = (words if begin is None else words.where(F.expr(f"left(w, {T.STEM_KEEPS})").isin(begin))).distinct().where(T.kept_sql("w"))
    return words.select(F.expr(T.stem_sql("w")).alias("term")).distinct()


def posting_lists(pages: DataFrame, one_page: bool = False, wanted: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(doc_id, term, df, n_passages, avg_len, hits array<struct<passage_idx, tf, len>>): what a question needs of each document's index, by term.

    With wanted ((term) or (doc_id, term), distinct) only those terms have rows; of a passage's other terms only their number is kept.
    With one_page the pages are dealt by document once, into parts, and everything else is done where they are. Else a document's pages are dealt
    apart, and only sums meet, so that one giant document isn't one task.
    """
    dealt = by_document(pages, parts) if one_page else pages
    few = one_page and wanted is not None
    if few:
        # of few terms little is left of a block of words, so a block, which windows share, is read once and its counts go to its windows
        place, texts = ["_first", "_last"], _blocks(dealt)
    else:
        place, texts = ["passage_idx"], passages(dealt, one_page=one_page)
    raw = texts.select("doc_id", *place, F.explode_outer(T.raw_tokens("text")).alias("w"))
    kept = T.kept_sql("w")
    if wanted is None:
        tokens = raw.select("doc_id", *place, F.expr(f"CASE WHEN {kept} THEN {T.stem_sql('w')} END").alias("term")).withColumn("_one", F.col("term").isNotNull())
    else:
        # a word is stemmed only if a term that is asked begins as it does
        begin = f"left({{}}, {T.STEM_KEEPS})"
        own = [c for c in wanted.columns if c != "term"]
        asked = wanted.groupBy(*own, F.expr(begin.format("term")).alias("_begin")).agg(F.collect_set("term").alias("_asked"))
        tokens = raw.select("doc_id", *place, F.expr(f"CASE WHEN {kept} THEN w END").alias("w")).withColumn("_begin", F.expr(begin.format("w"))).join(asked, [*own, "_begin"], "left")
        stem = T.stem_sql("w")
        tokens = tokens.select("doc_id", *place, F.expr(f"CASE WHEN _asked IS NOT NULL AND array_contains(_asked, {stem}) THEN {stem} END").alias("term"), F.col("w").isNotNull().alias("_one"))
    counted = tokens.groupBy("doc_id", *place, "term").agg(F.sum(F.col("_one").cast("int")).alias("tf"))
    if few:
        counted = counted.select("doc_id", F.explode(F.sequence("_first", "_last")).alias("passage_idx"), "term", "tf").groupBy("doc_id", "passage_idx", "term").agg(F.sum("tf").alias("tf"))
    held = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    each = counted.groupBy("doc_id", "passage_idx").agg(F.greatest(F.sum("tf"), F.lit(1)).alias("len"), held.alias("held"))
    if one_page:
        document = Window.partitionBy("doc_id")
        each = each.withColumn("n_passages", F.count("*").over(document)).withColumn("avg_len", F.avg("len").over(document))
    else:
        each = each.join(document_stats(each.select("doc_id", "passage_idx", "len")), "doc_id")
    rows = each.select("doc_id", "passage_idx", "len", "n_passages", "avg_len", F.inline("held"))
    hit = F.struct("passage_idx", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("df"), F.first("n_passages").alias("n_passages"), F.first("avg_len").alias("avg_len"), F.collect_list(hit).alias("hits"))
