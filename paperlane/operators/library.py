"""The library of documents as tables: upsert, delete, lookup, statistics, settings, and what engines there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T

# The settings that exist.
SETTINGS = ("engine_id", "model", "custom_base_url", "custom_api_key", "last_opened")
# Parts of the names of small models, most wanted first.
SMALL_MODELS = ("1b", "1.5b", "2b", "3b", "mini", "small", "tiny")
# Models that are suggested, with the memory in GB that each needs.
SUGGESTED_MODELS = (("llama3.2:1b", 2.5), ("qwen2.5:3b", 4.5), ("llama3.1:8b", 9.0))
# Questions that fit any document, and how one is asked about a keyword.
GENERIC_QUESTIONS = ("What is this document about?", "What are the most important points?", "Are there any dates or deadlines?", "What does it ask of me?")
ABOUT_KEYWORD = ("What does it say about “", "”?")


def upsert(new: DataFrame, library: DataFrame) -> DataFrame:
    """library with new (source_name, added, words) put in: a name that is there keeps its id and is marked as replaced; of a name given twice the last added counts."""
    latest = new.withColumn("source_name", T.safe_name(F.col("source_name"))).groupBy("source_name").agg(F.max_by(F.struct("added", "words"), F.struct("added", "words")).alias("n"))
    old = library.select("source_name", F.col("id").alias("old_id"))
    entry = latest.join(old, "source_name", "left")
    fresh = entry.select(F.coalesce("old_id", F.substring(F.sha2("source_name", 256), 1, 16)).alias("id"), "source_name", F.col("n.added").alias("added"), F.col("n.words").alias("words"), F.col("old_id").isNotNull().alias("replaced"))
    rest = library.join(latest, "source_name", "left_anti").select("id", "source_name", "added", "words", F.lit(False).alias("replaced"))
    return fresh.unionByName(rest)


def delete(library: DataFrame, ids: DataFrame) -> DataFrame:
    """library without the entries whose id is in ids (id)."""
    return library.join(ids, "id", "left_anti")


def lookup(library: DataFrame, doc_id: str) -> DataFrame:
    """The entry of an id; ids that aren't 6 to 32 hex digits have none."""
    return library.where(F.lit(doc_id).rlike("^[0-9a-f]{6,32}$") & (F.col("id") == doc_id))


def stats(library: DataFrame) -> DataFrame:
    return library.agg(F.count("*").alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


def newest_first(library: DataFrame) -> DataFrame:
    return library.where("id is not null").orderBy(F.desc("added"), "id")


def patch_settings(settings: DataFrame, patch: DataFrame) -> DataFrame:
    """settings (owner, settings map) with the known keys of patch (owner, patch map) put in."""
    known = F.map_filter(F.coalesce("patch", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*SETTINGS))
    kept = F.map_filter("settings", lambda k, v: ~F.map_contains_key("known", k))
    return settings.join(patch, "owner", "left").withColumn("known", known).select("owner", F.map_concat(kept, "known").alias("settings"))


def default_models(engines: DataFrame, saved: DataFrame) -> DataFrame:
    """(id, model): each engine's saved model if it has it, else its first small one, else its shortest name."""
    rows = engines.select("id", F.posexplode(F.array_sort("models")).alias("pos", "name")).join(saved, "id", "left")
    small = F.coalesce(*[F.when(F.contains(F.lower("name"), F.lit(h)), k) for k, h in enumerate(SMALL_MODELS)], F.lit(len(SMALL_MODELS)))
    order = Window.partitionBy("id").orderBy(F.when(F.col("name") == F.col("model"), 0).otherwise(1), small, F.when(small == len(SMALL_MODELS), F.length("name")).otherwise(0), "pos")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("id", F.col("name").alias("model"))


def page_by_label(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, doc_id, number, label) for each row of wanted (query_id, doc_id, wanted): the page of its document that a citation names.

    The page of that number, if it is all digits; else the first whose label contains it, whatever the case; else
    the first. A document without pages has none. One join on the document, and an aggregate of one row per query.
    """
    clean = wanted.select("query_id", "doc_id", F.lower(F.regexp_replace(F.trim(F.coalesce("wanted", F.lit(""))), "^“|”$", "")).alias("w"))
    both = clean.join(pages.select("doc_id", "page_pos", "number", "label"), "doc_id")
    numbered = F.col("w").rlike(r"^[0-9]{1,9}$") & (F.try_to_number(F.col("w"), F.lit("999999999")) == F.col("number"))
    place = F.when(numbered & (F.col("number") != 0), 0).when(F.contains(F.lower(F.coalesce("label", F.lit(""))), F.col("w")), 1).otherwise(2)
    best = both.groupBy("query_id", "doc_id").agg(F.min(F.struct(place.alias("place"), "page_pos", "number", "label")).alias("b"))
    return best.select("query_id", "doc_id", "b.number", "b.label")


def picked_engines(engines: DataFrame, saved: DataFrame) -> DataFrame:
    """(owner, engine, model) for each of engines' owners: the saved engine if it works, else the first that does; its saved or default model.

    engines (owner, pos, id, ok, models); saved (owner, engine, model). An engine works if it is ok and has models; without one both are null.
    """
    usable = engines.where("ok and size(models) > 0").join(saved, "owner", "left")
    first = usable.groupBy("owner").agg(F.min(F.struct((~F.coalesce(F.col("id") == F.col("engine"), F.lit(False))).alias("other"), "pos", "id", "models", "model")).alias("e"))
    chosen = first.select("owner", F.col("e.id").alias("engine"), F.col("e.models").alias("models"), F.col("e.model").alias("model"))
    models = default_models(chosen.select(F.col("owner").alias("id"), "models"), chosen.select(F.col("owner").alias("id"), "model")).withColumnRenamed("id", "owner")
    return engines.select("owner").distinct().join(chosen.select("owner", "engine").join(models, "owner"), "owner", "left")


def engine_summary(engines: DataFrame, saved: DataFrame, machines: DataFrame) -> DataFrame:
    """(owner, engines, ready, engine_id, engine_name, model, suggested) for each owner of engines: what a page says about the engines there are.

    engines (owner, pos, id, name, ok, models, error, why, port), saved as in picked_engines(), machines (owner, ram_gb). engines and suggested are
    arrays of structs, in order; an owner without an engine that works isn't ready, and its engine and model are empty.
    """
    none = lambda c, kind: F.coalesce(c, F.lit({"boolean": False, "string": "", "int": 0}[kind]).cast(kind))
    one = F.struct("pos", "id", "name", none("ok", "boolean").alias("ok"), F.coalesce("models", F.array().cast("array<string>")).alias("models"), none("error", "string").alias("error"), none("why", "string").alias("why"), none("port", "int").alias("port"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*[x[c].alias(c) for c in ("id", "name", "ok", "models", "error", "why", "port")]))
    # of engines with the same id the first gives the name
    picked = picked_engines(engines.select("owner", "pos", "id", "ok", "models"), saved)
    names = engines.groupBy("owner", F.col("id").alias("engine")).agg(F.min_by("name", "pos").alias("engine_name"))
    offered = suggested_models(machines.select(F.col("owner").alias("machine"), "ram_gb")).withColumnRenamed("machine", "owner")
    order = F.array_position(F.array(*[F.lit(n) for n, _ in SUGGESTED_MODELS]), F.col("name"))
    offered = offered.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), "name", "needs_gb", "fits"))), lambda x: F.struct(x["name"].alias("name"), x["needs_gb"].alias("needs_gb"), x["fits"].alias("fits"))).alias("suggested"))
    rows = engines.groupBy("owner").agg(listed.alias("engines")).join(picked, "owner", "left").join(names, ["owner", "engine"], "left").join(offered, "owner", "left")
    return rows.select("owner", "engines", F.col("engine").isNotNull().alias("ready"), none("engine", "string").alias("engine_id"), none("engine_name", "string").alias("engine_name"), none("model", "string").alias("model"), "suggested")


def suggested_models(machines: DataFrame) -> DataFrame:
    """(machine, name, needs_gb, fits): each suggested model on each of machines (machine, ram_gb); where the memory isn't known, it fits."""
    offered = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(g).alias("needs_gb")) for n, g in SUGGESTED_MODELS])
    rows = machines.select("machine", F.coalesce("ram_gb", F.lit(0.0)).alias("ram"), F.inline(offered))
    return rows.select("machine", "name", "needs_gb", ((F.col("ram") == 0) | (F.col("ram") >= F.col("needs_gb"))).alias("fits"))


def suggested_questions(documents: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, pos, question) for each of documents (doc_id) from keywords (doc_id, rank, term): what it is about, up to three keywords of four letters, and general ones; five at most."""
    terms = keywords.where(F.length("term") >= 4).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    asked = F.transform(F.slice("k", 1, 3), lambda x: F.concat(F.lit(ABOUT_KEYWORD[0]), x["term"], F.lit(ABOUT_KEYWORD[1])))
    asked = F.coalesce(asked, F.array().cast("array<string>"))
    general = [F.lit(q) for q in GENERIC_QUESTIONS]
    every = F.slice(F.concat(F.array(general[0]), asked, F.array(*general[1:])), 1, 5)
    return documents.select("doc_id").distinct().join(terms, "doc_id", "left").select("doc_id", F.posexplode(every).alias("pos", "question"))


def cleared(library: DataFrame) -> DataFrame:
    """The library without any entry."""
    return library.where("false")


def document_totals(pages: DataFrame) -> DataFrame:
    """(doc_id, words, pages, parts array<struct<number, label, words>>) of pages (doc_id, page_pos, number, label, text)."""
    words = F.size(T.words("text"))
    rows = pages.select("doc_id", "page_pos", "number", "label", words.alias("words"))
    parts = F.array_sort(F.collect_list(F.struct("page_pos", "number", "label", "words")))
    return rows.groupBy("doc_id").agg(F.sum("words").alias("words"), F.count("*").alias("pages"), F.transform(parts, lambda x: F.struct(x["number"].alias("number"), x["label"].alias("label"), x["words"].alias("words"))).alias("parts"))


def full_texts(pages: DataFrame, between: str = "\n\n") -> DataFrame:
    """(doc_id, text): a document's pages in order, joined."""
    one = F.array_sort(F.collect_list(F.struct("page_pos", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(one, lambda x: x["text"]), between).alias("text"))


PAGE_JSON = "name string, full_pages array<struct<number: int, text: string, label: string>>"


def to_json(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, json): each document of names (doc_id, name) with its pages."""
    one = F.array_sort(F.collect_list(F.struct("page_pos", F.col("number").cast("int").alias("number"), "text", "label")))
    held = pages.groupBy("doc_id").agg(F.transform(one, lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"), x["label"].alias("label"))).alias("full_pages"))
    empty = F.array().cast("array<struct<number:int,text:string,label:string>>")
    return names.join(held, "doc_id", "left").select("doc_id", F.to_json(F.struct("name", F.coalesce("full_pages", empty).alias("full_pages"))).alias("json"))


def from_json(stored: DataFrame) -> DataFrame:
    """pages(doc_id, name, page_pos, number, label, text) of stored (doc_id, json): a missing number is the place, a missing text or label empty."""
    rows = stored.select("doc_id", F.from_json("json", PAGE_JSON).alias("d"))
    pages = rows.select("doc_id", F.coalesce("d.name", F.lit("")).alias("name"), F.posexplode("d.full_pages").alias("page_pos", "p"))
    return pages.select("doc_id", "name", "page_pos", F.coalesce("p.number", F.col("page_pos") + 1).alias("number"), F.coalesce("p.label", F.lit("")).alias("label"), F.coalesce("p.text", F.lit("")).alias("text"))
