"""Readers: files and raw pages to pages(doc_id, page_pos, number, label, text)."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import StringType
from pyspark.storagelevel import StorageLevel

from ..functions import text as T

PARAGRAPHS, CSV_LINES = 12, 25

# Kinds of file by suffix, and what one read takes at most.
SUFFIXES = {
    "pdf": "pdf", "docx": "docx", "doc": "doc", "xlsx": "xlsx", "xls": "xls",
    "csv": "csv", "tsv": "csv", "txt": "text", "md": "text", "markdown": "text",
    "log": "text", "rst": "text", "json": "text", "yaml": "text", "yml": "text",
    "py": "text", "js": "text", "html": "html", "htm": "html", "xhtml": "html",
}
MAX_BYTES, MAX_ROWS = 80 * 1024 * 1024, 20_000
# The parts of a web page that are dropped, the tags that end a line, headings, and tags.
DROPPED = r"(?is)<(script|style|noscript|head|svg)\b.*?</\1>"
BLOCK_END = r"(?i)</(p|div|li|tr|h[1-6]|section|article|br)\s*/?>"
HEADING = r"(?is)<h[12][^>]*>(.*?)</h[12]>"
TAG = r"<[^>]+>"


def sniff(name: Column, content: Column) -> Column:
    """The kind of a file, by its first bytes, then its suffix, then whether it looks like text; else unknown."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    suffix = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))
    by_suffix = F.lit(None).cast("string")
    for kind in dict.fromkeys(SUFFIXES.values()):
        by_suffix = F.when(suffix.isin(*[x for x, k in SUFFIXES.items() if k == kind]), kind).otherwise(by_suffix)
    zipped = F.decode(content, "ISO-8859-1")
    plain = F.length(F.regexp_replace(F.substring(head, 1, 2048), "[^\\x09-\\x0d\\x20-\\x7e\\xa0-\\xff]", "")) / F.length(F.substring(head, 1, 2048)) > 0.9
    return (
        F.when(F.contains(head, F.lit("%PDF-")), "pdf")
        .when(F.startswith(head, F.lit("PK\x03\x04")), F.when(F.contains(zipped, F.lit("word/")), "docx").when(F.contains(zipped, F.lit("xl/")), "xlsx").otherwise("unknown"))
        .when(by_suffix.isNotNull(), by_suffix)
        .when((F.length(head) > 0) & plain, "text")
        .otherwise("unknown")
    )


#: The bytes 80 to 9f as Latin-1 reads them and as Windows-1252 does, and those that Windows-1252 leaves undefined.
_C1 = [chr(b) for b in range(0x80, 0xA0)]
_WINDOWS = [bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)]
_UNDEFINED = "".join(c for c, w in zip(_C1, _WINDOWS, strict=True) if not w)


def decode_text(content: Column) -> Column:
    """A file's text: UTF-8, without its byte order mark, if it is valid; else Windows-1252; else, if a byte is undefined there, Latin-1."""
    utf8 = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(c for c, w in zip(_C1, _WINDOWS, strict=True) if w), "".join(_WINDOWS))
    marked = F.when(F.startswith(utf8, F.lit("\ufeff")), F.substr(utf8, F.lit(2))).otherwise(utf8)
    return F.when(F.is_valid_utf8(utf8), marked).when(latin.rlike(f"[{_UNDEFINED}]"), latin).otherwise(windows)


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(unescape, na_action="ignore")


def decoded(text: Column) -> Column:
    """The text with its character references, named and numbered, as characters. Only texts that may have one leave the JVM."""
    some = F.contains(text, F.lit("&"))
    return F.when(some, _unescaped(F.when(some, text))).otherwise(text)


def html_sections(raw: DataFrame) -> DataFrame:
    """pages of raw (doc_id, html), and title: split at h1 and h2, whose text is the label only; scripts, styles, head dropped; empty sections too.

    A page is cut and numbered in its own row, so nothing is shuffled.
    """
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), TAG, " ")
    body = F.regexp_replace(F.regexp_replace("html", r"[\u0001\u0002]", ""), DROPPED, " ")
    # character references are decoded once, for the whole page, after the tags are gone; none of them gives the two marks
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, HEADING, "\u0001$1\u0002"), BLOCK_END, "\n"), TAG, " ")
    rows = raw.select("doc_id", decoded(title).alias("title"), decoded(marked).alias("marked"))

    def section(part: Column, at: Column) -> Column:
        headed = F.contains(part, F.lit("\u0002")) & (at > 0)
        rest = F.when(headed, F.substr(part, F.instr(part, F.lit("\u0002")) + 1)).otherwise(part)
        return F.struct(F.when(headed, T.tidy(F.substring_index(part, "\u0002", 1))).alias("heading"), T.tidy(rest).alias("text"))

    sections = F.filter(F.transform(F.split("marked", "\u0001"), section), lambda x: x["text"] != "")
    cut = rows.select("doc_id", T.tidy(F.col("title")).alias("title"), F.posexplode(sections).alias("page_pos", "s"))
    number = F.col("page_pos") + 1
    return cut.select("doc_id", "title", "page_pos", number.alias("number"), T.section_label(number, F.col("s.heading")).alias("label"), "s.text")


def text_parts(raw: DataFrame) -> DataFrame:
    """pages of raw (doc_id, text): Markdown sections if the text has headings (what precedes the first is dropped), else parts of twelve paragraphs.

    A text is cut and numbered in its own row, so nothing is shuffled.
    """
    blank = r"[^\S\n]"
    heading = rf"^{blank}{{0,3}}#{{1,3}}{blank}+(.*\S){blank}*$"
    tidied = raw.select("doc_id", F.regexp_replace(T.tidy(F.col("text")), "\u0001", "").alias("text"))
    marked = F.regexp_replace("text", rf"(?md)({heading})", "\u0001$1")
    rows = tidied.select("doc_id", "text", F.split(marked, "\u0001").alias("p"))
    sections = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x, i: F.struct(T.section_label(i + 1, F.regexp_extract(x, rf"(?md){heading}", 1)).alias("label"), T.tidy(x).alias("text")))
    paragraphs = F.filter(F.split("text", "\n\n"), lambda x: F.trim(x) != "")
    rows = rows.select("doc_id", F.when(F.size("p") > 1, sections).alias("s"), F.when(F.size("p") == 1, paragraphs).alias("q"))
    parts = F.transform(F.sequence(F.lit(1), F.ceil(F.size("q") / PARAGRAPHS).cast("int")), lambda k: F.struct(F.concat(F.lit("part "), k.cast("string")).alias("label"), F.array_join(F.slice("q", (k - 1) * PARAGRAPHS + 1, F.lit(PARAGRAPHS)), "\n\n").alias("text")))
    cut = rows.select("doc_id", F.posexplode(F.coalesce("s", F.when(F.size("q") > 0, parts))).alias("page_pos", "x"))
    return cut.select("doc_id", "page_pos", (F.col("page_pos") + 1).alias("number"), "x.label", "x.text")


#: Characters of a CSV text that one task takes; a longer text is cut.
CSV_SLICE = 4_000_000
# a field in quotes, from its opening quote or from within, up to its closing one; doubled quotes belong to it
_INSIDE = re.compile(r'[^"]*+(?:""[^"]*+)*+"(?!")')
_CELL = re.compile(r'(?:"[^"]*+(?:""[^"]*+)*+"(?!"))?+[^,]*+')


def _ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind a line, given whether one is before it. Quotes count only where a field begins."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        closed = _INSIDE.match(line)
        if not closed:
            return True
        at = line.find(",", closed.end())
        if at < 0:
            return False
        at += 1
    while True:
        # up to the next comma; a quoted field that isn't closed reaches the end
        if line.startswith('"', at) and not _INSIDE.match(line, at + 1):
            return True
        at = _CELL.match(line, at).end() + 1
        if at > len(line):
            return False


def _sliced(text: Column, size: int) -> Column:
    """array<struct<slice, text>>: a text cut at line ends, each slice of about so many characters with its line ends but the last."""
    # a line end belongs to the slice before it
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}[^\n]*+\n?+"), F.lit(0))
    return F.transform(parts, lambda x, i: F.struct(i.alias("slice"), x.alias("text")))


def _slice_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, slice, after_out, after_in): whether a quoted field is open behind a slice, if none or one is before it."""
    for batch in batches:
        out, inn = [], []
        for text in batch.column("text").to_pylist():
            ends = [False, True]
            for line in text.split("\n"):
                ends = [_ends_inside(line, e) for e in ends]
            out.append(ends[0])
            inn.append(ends[1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("slice"), pa.array(out, pa.bool_()), pa.array(inn, pa.bool_())], ["doc_id", "slice", "after_out", "after_in"])


def _slice_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, slice, at, part, text) of slices with inside: whole records (part 0), and what an open record has here (1 its beginning, 2 more of it)."""
    for batch in batches:
        for doc, k, inside, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "slice", "inside", "text")), strict=True):
            lines = text.split("\n")
            if lines[-1] == "":
                lines.pop()  # the line end of the last line
            at, begun, open_, rows = 0, 0, inside, []
            head = inside
            for i, line in enumerate(lines):
                open_ = _ends_inside(line, open_)
                if not open_:
                    rows.append((at, 2 if head else 0, "\n".join(lines[begun : i + 1])))
                    at, begun, head = at + 1, i + 1, False
            if begun < len(lines):
                rows.append((at, 2 if head else 1, "\n".join(lines[begun:])))
            for i in range(0, len(rows), 5000):
                some = rows[i : i + 5000]
                columns = [pa.array([doc] * len(some), pa.string()), pa.array([k] * len(some), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "slice", "at", "part", "text"])


def _record_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, slice, at, cells, error) of records: the cells without outer blanks, or why a record isn't one. Blank records go."""
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        cells, errors = [], []
        for text in batch.column("text").to_pylist():
            try:
                rows = list(csv.reader(io.StringIO(text)))
                cells.append([c.strip() for r in rows for c in r])
                errors.append(None)
            except csv.Error as e:
                cells.append([""])
                errors.append(str(e))
        keep = pa.array([bool(e) or any(c) for c, e in zip(cells, errors, strict=True)])
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("slice"), batch.column("at"), pa.array(cells, pa.list_(pa.string())), pa.array(errors, pa.string())], ["doc_id", "slice", "at", "cells", "error"])
        yield out.filter(keep)


def csv_records(raw: DataFrame, size: int = CSV_SLICE) -> DataFrame:
    """(doc_id, slice, at, cells, error) of the records of CSV texts (doc_id, text), in order of slice and at; blank ones don't count.

    A text is cut into slices at line ends, which many tasks read. Whether a slice begins within a quoted field depends on all before it, so each
    slice first tells what it makes of either case, and a running composition over the slices of a text, two values for each, says which
    it is. A record that goes across slices is put together from its parts. Fields may be of any size.
    """
    ids = raw.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slices = ids.select("doc_id", F.inline(_sliced(F.col("text"), size))).repartition("doc_id", "slice")
    ends = slices.mapInArrow(_slice_ends, "doc_id string, slice int, after_out boolean, after_in boolean")
    each = ends.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("slice", "after_out", "after_in"))).alias("e"))
    # before slice i: what slices 0 to i - 1 make of the text's beginning
    state = F.aggregate(
        "e",
        F.struct(F.lit(False).alias("now"), F.array().cast("array<boolean>").alias("all")),
        lambda a, x: F.struct(F.when(a["now"], x["after_in"]).otherwise(x["after_out"]).alias("now"), F.array_append(a["all"], a["now"]).alias("all")),
    )
    begins = each.select("doc_id", F.posexplode(state["all"]).alias("slice", "inside"))
    records = slices.join(begins, ["doc_id", "slice"]).mapInArrow(_slice_records, "doc_id string, slice int, at int, part int, text string")
    # parts of records: at most two of a slice; a beginning opens a record, what follows it belongs to it
    parts = records.where("part > 0").withColumn("n", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("slice", "at")))
    joined = parts.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("slice", "at", "text"))).alias("p"))
    whole = joined.select("doc_id", F.col("p")[0]["slice"].alias("slice"), F.col("p")[0]["at"].alias("at"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    every = records.where("part = 0").select("doc_id", "slice", "at", "text").unionByName(whole)
    return every.mapInArrow(_record_cells, "doc_id string, slice int, at int, cells array<string>, error string")


def csv_files(raw: DataFrame, limit: int | None = MAX_ROWS, size: int = CSV_SLICE) -> DataFrame:
    """pages of the texts of CSV files (doc_id, text), and note and error: each row as ``Header: value, …``, 25 rows a part.

    Blank rows don't count; a blank header, and a cell beyond the header, is called by its column. Of a file the first limit
    rows are read, or all; the note says if there were more. Fields may be quoted and hold line ends, and be of any size. A file
    that isn't CSV throughout has one page without a number or text, whose error says so. A file is read in slices, see csv_records().
    """
    records = csv_records(raw, size)
    bad = records.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
    names = F.transform("cells", lambda c, i: F.when(c != "", c).otherwise(F.concat(F.lit("column "), (i + 1).cast("string"))))
    headers = records.groupBy("doc_id").agg(F.min(F.struct("slice", "at", "cells")).alias("h"))
    headers = headers.select("doc_id", F.col("h.slice").alias("_slice"), F.col("h.at").alias("_at"), F.col("h.cells").alias("cells")).select("doc_id", "_slice", "_at", names.alias("header"))
    # rows are numbered from the counts of the slices before theirs
    counts = records.groupBy("doc_id", "slice").agg(F.count("*").alias("n"))
    before = counts.select("doc_id", "slice", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = records.select("doc_id", "slice", "at", "cells", F.row_number().over(Window.partitionBy("doc_id", "slice").orderBy("at")).alias("k")).join(before, ["doc_id", "slice"])
    rows = numbered.join(headers, "doc_id").join(bad.select("doc_id"), "doc_id", "left_anti")
    called = F.transform("cells", lambda c, i: F.when(c != "", F.concat(F.coalesce(F.get(F.col("header"), i), F.concat(F.lit("column "), (i + 1).cast("string"))), F.lit(": "), c)))
    rows = rows.select("doc_id", (F.col("before") + F.col("k") - 1).alias("rn"), F.array_join(called, ", ").alias("line")).where("rn > 0")
    if limit is not None:
        rows = rows.where(F.col("rn") <= limit + 1)
    part = F.floor((F.col("rn") - 1) / CSV_LINES).cast("int")
    kept = F.lit(True) if limit is None else F.col("rn") <= limit
    parts = rows.groupBy("doc_id", part.alias("page_pos")).agg(F.min("rn").alias("a"), F.max(F.when(kept, F.col("rn"))).alias("b"), F.array_sort(F.collect_list(F.when(kept, F.struct("rn", "line")))).alias("x"), F.max("rn").alias("last"))
    label = F.concat(F.lit("rows "), F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string"))
    more = F.lit("") if limit is None else F.when(F.max("last").over(Window.partitionBy("doc_id")) > limit, f"only the first {limit:,} rows are read").otherwise("")
    out = parts.withColumn("note", more).where("b is not null")
    pages = out.select("doc_id", "page_pos", (F.col("page_pos") + 1).alias("number"), label.alias("label"), T.tidy(F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("text"), "note", F.lit(None).cast("string").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    return pages.unionByName(bad.select("doc_id", none("int").alias("page_pos"), none("int").alias("number"), none("string").alias("label"), none("string").alias("text"), F.lit("").alias("note"), "error"))


def read_metrics() -> dict[str, Column]:
    """What read_files() counts as it goes over files, by kind: files, bytes, and files that are refused unread."""
    out = {"files": F.count("*"), "bytes": F.coalesce(F.sum("size"), F.lit(0)), "refused": F.count("error")}
    for kind in ("html", "text", "csv"):
        some = F.col("kind") == kind
        out |= {f"{kind}_files": F.count(F.when(some, 1)), f"{kind}_bytes": F.coalesce(F.sum(F.when(some, F.col("size"))), F.lit(0))}
    return out


def read_files(files: DataFrame, limit: int | None = None, metrics: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) of files (doc_id, name, content).

    documents has doc_id, name, kind, title (of a web page its title, of a CSV file its first six headings, else empty), words, parts, note (what of a CSV file was
    left out, if limit, its rows at most, isn't null), and error, which says why a file gives no pages: it is too large or empty, of an old format
    (doc, xls), of one whose parser isn't here (pdf, docx, xlsx), of an unknown one, not CSV, or without text. pages are those of the others.
    The kind and the text of a file are found once, and the texts kept while the readers of the kinds go over them. metrics, if given, has
    read_metrics() after either table was computed: they are counted in the pass that finds the texts.
    """
    size = F.coalesce(F.length("content"), F.lit(0))
    kind = sniff(F.col("name"), F.col("content"))
    known = files.select(F.col("doc_id").cast("string").alias("doc_id"), "name", "content", F.when((size > 0) & (size <= MAX_BYTES), kind).alias("kind"), size.alias("size"))
    refused = F.when(F.col("size") > MAX_BYTES, "too large").when(F.col("size") == 0, "empty").when(F.col("kind").isin("doc", "xls"), "old format").when(F.col("kind").isin("pdf", "docx", "xlsx"), "no parser").when(F.col("kind") == "unknown", "unknown kind")
    known = known.withColumn("error", refused)
    if metrics is not None:
        known = known.observe(metrics, *[c.alias(n) for n, c in read_metrics().items()])
    # for all kinds at once: content isn't sniffed and decoded again for each
    read = known.select("doc_id", "name", "kind", "error", F.when(F.col("error").isNull(), decode_text(F.col("content"))).alias("text")).persist(StorageLevel.MEMORY_AND_DISK)
    texts = read.where("error is null")
    none = F.lit("")
    columns = ["doc_id", "page_pos", "number", "label", "text", "title", "note", "error"]
    clear = F.lit(None).cast("string")
    html = html_sections(texts.where("kind = 'html'").select("doc_id", F.col("text").alias("html"))).withColumns({"note": none, "error": clear}).select(columns)
    plain = text_parts(texts.where("kind = 'text'")).withColumns({"title": none, "note": none, "error": clear}).select(columns)
    sheets = texts.where("kind = 'csv'")
    first = F.regexp_extract("text", r"(?:^|\n)([^\n]*[^\s,][^\n]*)", 1)
    heads = csv_records(sheets.select("doc_id", first.alias("text"))).groupBy("doc_id").agg(F.min(F.struct("slice", "at", "cells")).alias("h"))
    title = F.array_join(F.slice(F.transform("h.cells", lambda c, i: F.when(c != "", c).otherwise(F.concat(F.lit("column "), (i + 1).cast("string")))), 1, 6), ", ")
    table = csv_files(sheets, limit).join(heads.select("doc_id", title.alias("title")), "doc_id", "left").select(columns)
    pages = html.unionByName(plain).unionByName(table)
    filled = pages.groupBy("doc_id").agg(F.count("text").alias("parts"), F.sum(F.size(T.words("coalesce(text, '')"))).alias("words"), F.max("title").alias("title"), F.max("note").alias("note"), F.max("error").alias("bad"))
    documents = read.select("doc_id", "name", "kind", "error").join(filled, "doc_id", "left")
    wrong = F.coalesce("error", F.when(F.col("bad").isNotNull(), "not csv"), F.when(F.coalesce("parts", F.lit(0)) == 0, "no text"))
    out = documents.select("doc_id", "name", "kind", F.coalesce("title", none).alias("title"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("note", none).alias("note"), wrong.alias("error"), F.coalesce("parts", F.lit(0)).alias("parts"))
    return out, pages.where("text is not null").select("doc_id", "page_pos", "number", "label", "text")


def csv_pages(rows: DataFrame, columns: list[str], order: list[str], doc_id: Column, limit: int | None = None) -> DataFrame:
    """pages of a table of strings: each row as ``Header: value, …`` without blank cells, 25 rows a part; of a document the first limit rows, or all."""
    cells = F.array(*[F.struct(F.lit(c).alias("h"), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("v")) for c in columns])
    line = F.array_join(F.transform(F.filter(cells, lambda x: x["v"] != ""), lambda x: F.concat(x["h"], F.lit(": "), x["v"])), ", ")
    numbered = rows.select(doc_id.alias("doc_id"), line.alias("line"), *order).where("line <> ''").withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    numbered = numbered if limit is None else numbered.where(F.col("rn") <= limit)
    parts = numbered.groupBy("doc_id", F.floor((F.col("rn") - 1) / CSV_LINES).cast("int").alias("page_pos")).agg(F.min("rn").alias("a"), F.max("rn").alias("b"), F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("x"))
    label = F.concat(F.lit("rows "), F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string"))
    return parts.select("doc_id", "page_pos", (F.col("page_pos") + 1).alias("number"), label.alias("label"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
