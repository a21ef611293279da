"""Grounding, prompts, answer events and export of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: What a language model is told.
ANSWER_RULES = "Answer only from the numbered extracts of the document. Say on which page you found it. If the answer is not there, say that you could not find that in your document."
SUMMARY_RULES = "Summarise the document from the numbered extracts alone, in plain words."


def support(answers: DataFrame) -> DataFrame:
    """(turn_id, checked, ratio, supported) for answers (turn_id, answer, sources): how much of an answer's long words its sources hold."""
    cleaned = answers.select("turn_id", F.regexp_replace("answer", T.CITATION, " ").alias("clean"), "answer", "sources")
    rows = cleaned.select("turn_id", F.col("answer").rlike(T.REFUSAL).alias("refused"), F.filter(T.tokens("clean"), lambda x: F.length(x) > 3).alias("said"), F.array_distinct(T.tokens("sources")).alias("known"))
    # both in one sorted array, a known word before what is said of it: one pass counts, however long the texts are
    marked = lambda words, said: F.transform(words, lambda x: F.struct(x.alias("word"), F.lit(said).alias("said")))
    passed = F.struct(F.lit(None).cast("string").alias("known"), F.lit(0).alias("n"))
    count = lambda a, x: F.struct(F.when(x["said"], a["known"]).otherwise(x["word"]).alias("known"), (a["n"] + F.coalesce(x["said"] & (x["word"] == a["known"]), F.lit(False)).cast("int")).alias("n"))
    covered = F.aggregate(F.sort_array(F.concat(marked("known", False), marked("said", True))), passed, count, lambda a: a["n"])
    checked = ~F.col("refused") & (F.size("said") > 0) & (F.size("known") > 0)
    rows = rows.select("turn_id", checked.alias("checked"), F.size("said").alias("n"), covered.alias("covered"))
    ratio = F.when(F.col("checked"), F.col("covered") / F.col("n"))
    supported = F.when(F.col("checked"), F.when(F.col("n") < 3, F.col("covered") > 0).otherwise(F.col("covered") / F.col("n") >= 0.4))
    return rows.select("turn_id", "checked", F.round(ratio, 2).alias("ratio"), supported.alias("supported"))


def citations(texts: DataFrame) -> DataFrame:
    """(turn_id, pos, citation) of every citation in texts (turn_id, text)."""
    found = F.expr(r"regexp_extract_all(text, '(?i)\\(((?:page|part|section|sheet)\\s+[^)\"]{1,60})\\)', 1)")
    return texts.select("turn_id", F.posexplode(found).alias("pos", "citation"))


def extract_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, extracts): the hits as numbered extracts, best first."""
    one = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), "label", F.lit(")\n"), "text").alias("b"))
    blocks = hits.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return blocks.select("query_id", "doc_id", F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias("extracts"))


def messages(extracts: DataFrame, questions: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, messages array<struct<role, content>>) for a model: with questions to answer, without them to summarise.

    names (doc_id, name) has what the document is called; one without a name is called “the document”.
    """
    if questions is None:
        rows, rules, tail = extracts, SUMMARY_RULES, F.lit("")
    else:
        rows, rules = extracts.join(questions, "query_id"), ANSWER_RULES
        tail = F.concat(F.lit("\n\nQuestion: "), F.trim(F.substring("question", 1, 500)))
    rows = rows.withColumn("name", F.lit(None).cast("string")) if names is None else rows.join(names.select("doc_id", "name"), "doc_id", "left")
    head = F.concat(F.lit("Extracts from “"), F.coalesce("name", F.lit("the document")), F.lit("”"))
    # a summary is told that the beginning comes first
    head = F.concat(head, F.lit(" (its beginning, then the parts that stand for it best):\n\n" if questions is None else ":\n\n"))
    pair = F.array(F.struct(F.lit("system").alias("role"), F.lit(rules).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(head, "extracts", tail).alias("content")))
    return rows.select("query_id", "doc_id", pair.alias("messages"))


def answer_events(asked: DataFrame, hits: DataFrame, answers: DataFrame, confidence: DataFrame | None = None, engines: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, seq, type, payload): the events of answering each pair of asked (query_id, doc_id) with answers (query_id, doc_id, answer, supported).

    found comes first; its payload is JSON: the hits (rank, label, score, and snippet if hits have one), best first, and the pair's confidence
    (found, coverage, score, reason), if given. Without hits a note and an unfinished end follow; with hits and no answer, or no engine in
    engines (query_id, doc_id, name, model), if given, no_engine and an unfinished end. Else engine, with its name and model as JSON, the answer, or
    a note if it is empty, a warning if it isn't supported, and the end.
    """
    keys = ["query_id", "doc_id"]
    columns = [c for c in ("rank", "label", "score", "snippet") if c in hits.columns]
    best = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("hits"))
    rows = asked.select(*keys).distinct().join(best, keys, "left").join(answers, keys, "left")
    parts = [F.coalesce("hits", F.array().cast(best.schema["hits"].dataType)).alias("hits")]
    if confidence is not None:
        told = confidence.select(*keys, F.struct("found", "coverage", "score", "reason").alias("confidence"))
        rows, parts = rows.join(told, keys, "left"), [*parts, F.col("confidence")]
    if engines is not None:
        rows = rows.join(engines.select(*keys, F.struct("name", "model").alias("engine")), keys, "left")
    rows = rows.withColumn("n", F.coalesce(F.size("hits"), F.lit(0)))

    def event(kind: str, payload: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), payload.cast("string").alias("payload")))

    able = F.col("answer").isNotNull() if engines is None else F.col("answer").isNotNull() & F.col("engine").isNotNull()
    none, silent, told, blank = F.col("n") <= 0, (F.col("n") > 0) & ~able, (F.col("n") > 0) & able, F.col("answer") == ""
    named = [] if engines is None else [event("engine", F.to_json("engine"), told)]
    events = F.array_compact(F.array(event("found", F.to_json(F.struct(*parts)), F.lit(True)), event("note", F.lit("nothing found"), none), event("no_engine", F.lit(""), silent), *named, event("answer", F.col("answer"), told & ~blank), event("note", F.lit("nothing was answered"), told & blank), event("unsupported", F.lit(""), told & ~F.coalesce("supported", F.lit(True))), event("done", told, F.lit(True))))
    return rows.select(*keys, F.posexplode(events).alias("seq", "e")).select(*keys, "seq", "e.type", "e.payload")


ANSWER_SENTENCES = 3


def extractive_answers(questions: DataFrame, hits: DataFrame, limit: int = ANSWER_SENTENCES) -> DataFrame:
    """(query_id, doc_id, answer, sentences array<struct<rank, pos, sentence>>): for each pair with hits, sentences of the hits that cover the question; no model is asked.

    Hits' texts are cut to sentences behind full stops, question and exclamation marks and at line ends. A question's term weighs
    1 + ln(sentences / those that hold it), within the pair's hits. The first sentence is the one whose terms weigh most, each further one adds
    most to the terms covered so far; ties go to the earlier sentence of the better hit. It ends at limit sentences, or when none adds anything; an
    answer without a term is empty. Sentences are put together in the order of the hits, each with the place it comes from.
    """
    keys = ["query_id", "doc_id"]
    asked = questions.select("query_id", F.array_distinct(T.tokens("question")).alias("want"))
    cut = F.filter(F.transform(F.split("text", r"(?<=[.!?…])\s+|\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = hits.join(asked, "query_id").select(*keys, "rank", "label", "want", F.posexplode(cut).alias("pos", "sentence"))
    rows = rows.select(*keys, "rank", "pos", "label", "sentence", "want", F.array_intersect("want", T.tokens("sentence")).alias("has"))
    # one row for each pair: six passages hold few sentences
    each = rows.groupBy(*keys).agg(F.first("want").alias("want"), F.array_sort(F.collect_list(F.struct("rank", "pos", "label", "sentence", "has"))).alias("s"))
    weight = F.transform("want", lambda t: F.struct(t.alias("t"), F.size(F.filter("s", lambda x: F.array_contains(x["has"], t))).alias("n")))
    each = each.withColumn("w", F.map_from_entries(F.transform(F.filter(weight, lambda x: x["n"] > 0), lambda x: F.struct(x["t"], F.round(1 + F.log(F.size("s") / x["n"]), 9)))))
    # the greedy cover is a fold over the number of sentences to take
    none = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("covered"))

    def further(done: Column, _: Column) -> Column:
        gain = F.transform("s", lambda x, i: F.struct(F.round(F.aggregate(F.array_except(x["has"], done["covered"]), F.lit(0.0), lambda a, t: a + F.try_element_at("w", t)), 6).alias("g"), (-i).alias("i")))
        # one element stands for the best sentence, so that it is found once
        taken = F.transform(F.array(F.array_max(gain)), lambda best: F.when(best["g"] > 0, F.struct(F.array_append(done["taken"], -best["i"]).alias("taken"), F.array_union(done["covered"], F.get(F.col("s"), -best["i"])["has"]).alias("covered"))).otherwise(done))
        return F.get(taken, F.lit(0))

    each = each.withColumn("taken", F.aggregate(F.sequence(F.lit(1), F.lit(limit)), none, further)["taken"])
    chosen = F.transform(F.array_sort("taken"), lambda i: F.get(F.col("s"), i))
    each = each.select(*keys, chosen.alias("c"))
    said = F.array_join(F.transform("c", lambda x: F.concat(x["sentence"], F.lit(" ("), x["label"], F.lit(")"))), " ")
    return each.select(*keys, said.alias("answer"), F.transform("c", lambda x: F.struct(x["rank"].alias("rank"), x["pos"].alias("pos"), x["sentence"].alias("sentence"))).alias("sentences"))


def export_markdown(turns: DataFrame, title: str, saved: str | None = None) -> DataFrame:
    """(chat_id, markdown) of turns (chat_id, turn, question, answer, hits array<struct<label, snippet>>), with the date saved, if given.

    Turns with neither question nor answer don't count; chats without any other give no row.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    kept = turns.withColumn("question", strip(F.col("question"))).withColumn("answer", strip(F.col("answer"))).where("question <> '' or answer <> ''")
    numbered = kept.withColumn("k", F.row_number().over(Window.partitionBy("chat_id").orderBy("turn")))
    said = lambda h: F.when(strip(h["snippet"]) == "", "(a source page)").otherwise(F.concat(F.lit("“"), F.substring(strip(h["snippet"]), 1, 220), F.lit("”")))
    sources = F.array_join(F.transform("hits", lambda h: F.concat(F.lit("- "), h["label"], F.lit(": "), said(h), F.lit("\n"))), "")
    block = F.concat(F.lit("## Question "), F.col("k").cast("string"), F.lit("\n\n"), "question", F.lit("\n\n"), "answer", F.lit("\n"), F.when(F.size("hits") > 0, F.concat(F.lit("\n**Where this came from**\n\n"), sources)).otherwise(""))
    one = numbered.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))).alias("x"))
    head = f"# {title}\n\n" + (f"Saved on {saved}. Every answer keeps the page it came from.\n\n" if saved else "")
    return one.select("chat_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["b"]), "\n")).alias("markdown"))
