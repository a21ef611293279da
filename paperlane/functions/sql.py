"""The text functions and the passages of a document in SQL: scalar functions with SQL bodies, which the optimizer inlines, and a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from . import text as T


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, put in steps:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(put)})"
    return text


#: (name, parameters, type, body) of the scalar functions.
FUNCTIONS = (
    ("pl_tidy", "t STRING", "STRING", _replaced(f"translate({_replaced('t', (r'\r\n?', chr(10)), (r'[\x00-\x08\x0b-\x1f\x7f﻿]', ''))}, ' ', ' ')", (r"[ \t]{2,}", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))),
    ("pl_stem", "w STRING", "STRING", T.stem_sql("w")),
    ("pl_words", "t STRING", "ARRAY<STRING>", f"regexp_extract_all(lower(t), {_quoted(T.TOKEN)}, 0)"),
    ("pl_kept", "w STRING", "BOOLEAN", T.kept_sql("w")),
    ("pl_tokens", "t STRING", "ARRAY<STRING>", f"transform(filter(regexp_extract_all(lower(t), {_quoted(T.TOKEN)}, 0), w -> {T.kept_sql('w')}), w -> {T.stem_sql('w')})"),
    ("pl_label", "number INT, heading STRING", "STRING", "CASE WHEN coalesce(heading, '') <> '' THEN concat('section “', CASE WHEN length(heading) > 48 THEN concat(rtrim(left(heading, 45)), '…') ELSE heading END, '”') ELSE concat('section ', number) END"),
)


class Passages:
    """The passages of a table's texts, by document: pl_passages(TABLE(t), size => 90, step => 60).

    The table has doc_id, page_pos, number, label and text, other columns are ignored. analyze() asks Spark to partition it by doc_id and to
    order it by page_pos, so a query doesn't; a page is cut in the task that has its document, and held alone.
    """

    def __init__(self):
        self.next = 0
        self.doc = None

    @staticmethod
    def analyze(pages: AnalyzeArgument, size: AnalyzeArgument | None = None, step: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("the first argument must be a table")
        kinds = {f.name: f.dataType for f in pages.dataType.fields}
        missing = {"doc_id", "page_pos", "number", "label", "text"} - kinds.keys()
        if missing:
            raise ValueError(f"the table has no {', '.join(sorted(missing))}")
        for name, x in (("size", size), ("step", step)):
            if x is not None and (not x.isConstantExpression or x.value is None or x.value < 1):
                raise ValueError(f"{name} must be a positive constant")
        schema = StructType().add("doc_id", kinds["doc_id"]).add("passage_idx", IntegerType()).add("number", kinds["number"]).add("label", StringType()).add("text", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("page_pos")])

    def eval(self, row: Row, size: int = 90, step: int = 60) -> Iterator[tuple]:
        if row["doc_id"] != self.doc:
            self.doc, self.next = row["doc_id"], 0
        for text in _windows(row["text"] or "", size, step):
            yield row["doc_id"], self.next, row["number"], row["label"], text
            self.next += 1


def _windows(text: str, size: int, step: int) -> list[str]:
    """Overlapping windows of a text's words; a short text is one, verbatim, and a tail of under 30 words is dropped unless it is all there is."""
    words = re.findall(r"\S+", text, re.ASCII)
    if not words:
        return []
    if len(words) <= size + (size - step) // 2:
        return [re.sub(r"^\s+|\s+$", "", text, flags=re.ASCII)]
    out = []
    for begin in range(0, len(words), step):
        window = words[begin : begin + size]
        if len(window) >= 30 or not out:
            out.append(" ".join(window))
        if begin + size >= len(words):
            break
    return out


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: pl_tidy, pl_stem, pl_tokens, pl_label and pl_passages."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("pl_passages", udtf(Passages))
