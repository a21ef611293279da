"""Line dedup on finer units: removal of repeated passages, inside lines and across them (DataFrame operations only).

A text is cut into units of a few words: after each line, and between two words whose common hash says
so, so that a passage pasted anywhere is cut into the same units but for its two ends. A unit that stands
elsewhere before, where (doc_id, position) is less, is repeated; neighbouring repeated units are joined to
runs, and runs of at least min_words words or of two whole lines are removed. The first place of a unit always stays.

Where near-duplicate detection comes after, it must still know its copies. So it may say beforehand which texts it links
(copies): of such a class one text stays and the others go later. What a class has in common is then not cut within it, and what
others had before is cut from all of it alike; a text that will go is the first place of nothing that one that stays has too.
Hashes of 64 bits find what may repeat; only units with the same bytes, but for white space at their end, are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .graph import HOT_KEYS, HOT_ROWS, settle, stored

#: One pair of words in so many is cut apart.
PAIRS = 6
#: Words of the shortest run that is removed: a repeated passage of 50 words has so many but for its ends.
MIN_WORDS = 20

#: What finds units that may be the same.
HASH = "xxhash64({})"

_SPACE = r"' \t\n\r\f'"


def with_units(rows: DataFrame, text: str) -> DataFrame:
    """Adds _units, the array of the units of a text; joined they are the text, in which U+0001 is escaped as U+0001 e.

    The words are a column of their own, so that the text is split once and not for each use of its words.
    """
    cut = f"before IS NOT NULL AND (contains(before, '\\n') OR pmod(xxhash64(rtrim({_SPACE}, before), rtrim({_SPACE}, word)), {PAIRS}) = 0)"
    marked = f"zip_with(_words, concat(array(cast(null AS string)), _words), (word, before) -> concat(if({cut}, '\u0001b', ''), replace(word, '\u0001', '\u0001e')))"
    words = rows.withColumn("_words", F.expr(rf"split({text}, '(?<=\\s)(?=\\S)', -1)"))
    return words.withColumn("_units", F.expr(f"split(array_join({marked}, ''), '\u0001b', -1)")).drop("_words")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, copies: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, runs array<struct<first, last>>): the units to be removed; version is a hash of the text.

    copies (doc_id, of), a row for each text that goes later and the one of its class that stays, are what dedup_passages() says of them.
    """
    one = rf"if(unit IS NULL, NULL, struct({HASH.format(f"rtrim({_SPACE}, unit)")} AS h, rtrim({_SPACE}, unit) AS bytes, size(split(trim(BOTH {_SPACE} FROM unit), '\\s+')) AS words, contains(before, '\n') AS starts, contains(unit, '\n') AS ends))"
    rows = docs.where("doc_id is not null and text is not null").where(r"text rlike '\\S'").select("doc_id", F.xxhash64("text").alias("version"), "text")
    rows = rows.withColumn("of", F.lit(None).cast("long")) if copies is None else rows.join(copies.select("doc_id", "of"), "doc_id", "left")
    each = with_units(rows, "concat(text, '\\n')").select("doc_id", "version", "of", F.posexplode(F.expr(f"zip_with(_units, concat(array('\\n'), _units), (unit, before) -> {one})")).alias("at", "u")).where("u is not null")
    each = stored(each.select("doc_id", "version", "of", "at", "u.*"))
    # the few hot units by broadcast, all others by one shuffle of the units; only those that repeat are compared
    known, bound = stored(each.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1")), max(HOT_ROWS, each.count() // HOT_KEYS)
    hot, some = F.broadcast(known.where(F.col("_n") > bound).select("h")), known.where(F.col("_n") <= bound).select("h")
    place, common = F.struct(F.col("of").isNotNull().alias("goes"), "doc_id", "version", "at", "of"), each.join(hot, "h")
    common = common.join(F.broadcast(common.groupBy("h", "bytes").agg(F.min(place).alias("first"))), ["h", "bytes"])
    rest = each.join(hot, "h", "left_anti").join(some, "h").withColumn("first", F.min(place).over(Window.partitionBy("h", "bytes")))
    again = common.unionByName(rest).where("struct(doc_id, version, at) <> struct(first.doc_id, first.version, first.at)")
    # not what another text of the same class has first
    again = again.where("coalesce(of, doc_id) <> coalesce(first.of, first.doc_id) or struct(doc_id, version) = struct(first.doc_id, first.version)")
    held = again.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("at", "words", "starts", "ends"))).alias("all"))
    runs = held.select("doc_id", "version", F.posexplode("all").alias("i", "u")).groupBy("doc_id", "version", (F.col("u.at") - F.col("i")).alias("run"))
    whole = F.sum(F.col("u.ends").cast("int")) - F.when(F.min(F.struct("u.at", "u.starts"))["starts"], 0).otherwise(1)
    runs = runs.agg(F.min("u.at").alias("first"), F.max("u.at").alias("last"), F.sum("u.words").alias("words"), whole.alias("lines"))
    runs = runs.where((F.col("words") >= min_words) | (F.col("lines") >= 2))
    return runs.groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, copies: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, any other columns) with the repeated passages removed from text; every row stays.

    copies (doc_id long, of long) has a row for each document that near-duplicate detection will link with the document of, which stays.

    n_chars, if there, is set to the new length. A text all of which stands elsewhere before becomes empty. Null texts stay
    null; rows whose doc_id is null are not touched. Rows with the same doc_id and text are one text given twice, and are
    cut alike. An empty table gives an empty result.
    """
    gone = settle(repeated_runs(docs, min_words, copies)).withColumnRenamed("runs", "_gone")
    rest = F.struct(F.lit(0), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_row")
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.col("text"), rest).join(gone, ["doc_id", "version"], "left")
    kept = "replace(array_join(filter(_units, (unit, i) -> NOT exists(_gone, r -> i BETWEEN r.first AND r.last)), ''), '\u0001e', '\u0001')"
    cut = with_units(rows, "if(_gone IS NULL, NULL, text)").withColumn("_text", F.expr(f"CASE WHEN _gone IS NOT NULL THEN {kept} ELSE text END"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("_text"), "n_chars": F.when(F.col("_gone").isNotNull(), F.length("_text").cast("long")).otherwise(F.col("_row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return cut.select([made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
