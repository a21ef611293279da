"""Chat formatting by quotation linking (DataFrame operations only).

A message's lines are parsed into quote levels (the number of leading ``>`` marks). Runs of lines of
one level are passages; a quoted passage is normalised (lower case, single spaces) and hashed, and
joined to the messages that say the same at level 0. A message replies to the message that its
quotation nearest to level 1 points at: in its own conversation if it is there, else the first that said it anywhere;
of a quotation that nobody said as a whole passage or line, to the message that most of its lines in a row were first said in;
without a found quotation, to the turn numbered one less, if it exists. Conversations are built in reply order, without
quotes: after a message come the replies to it with all that replies to them, the one with the least turn first.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window, functions as F

from .graph import join_counted, settle, stored

#: Turns of a conversation that are numbered together.
TURNS = 1000
#: The quote marks that begin a line.
MARKS = "^[ \\t]*(?:>[ \\t]?)+"
#: Whether a message quotes at all.
QUOTES = rf"text rlike '(?m){MARKS}'"


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, passages array<struct<level, text>>, body): runs of lines of one level, and the text without quotes."""
    lines = r"split(coalesce(text, ''), '\n', -1)"
    level = "length(replace(replace(regexp_extract({}, '" + MARKS + "', 0), ' ', ''), '\t', ''))"
    new = f"before IS NOT NULL AND {level.format('line')} <> {level.format('before')}"
    # each array is the argument of a higher-order function once; inside a lambda it would be computed for each element
    marked = rf"zip_with({lines}, concat(array(cast(null AS string)), {lines}), (line, before) -> concat(if({new}, '\u0001b', ''), replace(line, '\u0001', '\u0001e')))"
    runs = rf"split(array_join({marked}, '\n'), '\n\u0001b', -1)"
    plain = rf"replace(regexp_replace(run, '(?m){MARKS}', ''), '\u0001e', '\u0001')"
    out = messages.withColumn("passages", F.expr(f"transform({runs}, run -> struct({level.format('run')} AS level, {plain} AS text))"))
    body = r"trim(BOTH '\n' FROM array_join(transform(filter(passages, p -> p.level = 0), p -> p.text), '\n'))"
    quoted = "exists(passages, p -> p.level > 0)"
    return out.select("conv_id", "turn", "role", "passages", F.expr(f"CASE WHEN {quoted} THEN {body} ELSE text END").alias("body"))


def normalised(text: str):
    return F.expr(rf"trim(regexp_replace(lower({text}), r'\s+', ' '))")


def _lines(parsed: DataFrame, level: str) -> DataFrame:
    """(conv_id, turn, level, at, line, said, h): the lines, without blank ones, of the passages at of such a level."""
    rows = parsed.select("conv_id", "turn", F.posexplode("passages").alias("at", "p")).where(level)
    rows = rows.select("conv_id", "turn", "p.level", "at", F.posexplode(F.expr(r"filter(split(p.text, '\n', -1), x -> x rlike '\\S')")).alias("line", "text"))
    return rows.select("conv_id", "turn", "level", "at", "line", normalised("text").alias("said")).withColumn("h", F.xxhash64("said"))


def _looked_up(asked: DataFrame, said: DataFrame, keys: list[str], total: int) -> DataFrame:
    """asked, of total rows, with what said has for its keys, if anything; a quotation that a large share quotes doesn't go to one task."""
    counted = asked.groupBy(*keys).agg(F.count("*").alias("_n"))
    return join_counted(asked, said.join(counted, keys), keys, total, "left")


def _partly_quoted(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, at, part): for each quoted passage the message that holds the most of its lines in a row, by where each line was said first."""
    asked, own = settle(_lines(parsed.where("quoting"), "p.level > 0")), _lines(parsed, "p.level = 0").withColumn("place", F.col("at").cast("long") * 1_000_000 + F.col("line"))
    total = asked.count()
    near = own.groupBy("conv_id", "h", "said").agg(F.min(F.struct("turn", "place")).alias("n"))
    first = near.groupBy("h", "said").agg(F.min(F.struct("conv_id", "n")).alias("f"))
    here = F.when(F.col("n.turn") < F.col("turn"), F.struct("conv_id", "n.turn", "n.place"))
    there = F.when(F.expr("f.conv_id <> conv_id"), F.struct("f.conv_id", "f.n.turn", "f.n.place"))
    held = _looked_up(_looked_up(asked, near, ["conv_id", "h", "said"], total), first, ["h", "said"], total).withColumn("s", F.coalesce(here, there)).where("s is not null")
    source = F.struct(F.col("s.conv_id").alias("conv_id"), F.col("s.turn").alias("turn")).alias("source")
    runs = held.groupBy("conv_id", "turn", "at", source, (F.col("s.place") - F.col("line")).alias("run")).agg((-F.count("*")).alias("few"))
    best = F.min(F.struct("few", (F.col("source.conv_id") != F.col("conv_id")).alias("away"), "source"))
    return runs.groupBy("conv_id", "turn", "at").agg(best.alias("b")).select("conv_id", "turn", "at", F.col("b.source").alias("part"))


def _quotations(clean: DataFrame) -> DataFrame | None:
    """(conv_id, turn, quotes, best.source) of the messages that quote; None if none does."""
    parsed = passages(clean).withColumn("quoting", F.expr("exists(passages, p -> p.level > 0)"))
    quoted = passages(clean.where(QUOTES)).select("conv_id", "turn", F.posexplode("passages").alias("at", "p")).where("p.level > 0")
    quoted = settle(quoted.select("conv_id", "turn", "p.level", "at", normalised("p.text").alias("said")).where("said <> ''").withColumn("h", F.xxhash64("said")))
    total = quoted.count()
    if not total:
        return None
    # what messages say themselves: the whole of their passages and each line of them
    own = parsed.select("conv_id", "turn", F.explode("passages").alias("p")).where("p.level = 0").select("conv_id", "turn", F.explode(F.expr(r"array_union(array(p.text), split(p.text, '\n', -1))")).alias("said"))
    own = own.select("conv_id", "turn", normalised("said").alias("said")).where("said <> ''").withColumn("h", F.xxhash64("said"))
    near = own.groupBy("conv_id", "h", "said").agg(F.min("turn").alias("near_turn"))
    first = near.groupBy("h", "said").agg(F.min(F.struct("conv_id", "near_turn")).alias("f"))
    joined = _looked_up(_looked_up(quoted, near, ["conv_id", "h", "said"], total), first, ["h", "said"], total)
    here = F.when(F.col("near_turn") < F.col("turn"), F.struct(F.col("conv_id"), F.col("near_turn").alias("turn")))
    there = F.when(F.expr("f.conv_id <> conv_id"), F.struct(F.col("f.conv_id"), F.col("f.near_turn").alias("turn")))
    joined = joined.join(_partly_quoted(parsed), ["conv_id", "turn", "at"], "left")
    best = F.min(F.when(F.col("source").isNotNull(), F.struct("level", (-F.col("at")).alias("at"), "source")))
    return joined.withColumn("source", F.coalesce(here, there, "part")).groupBy("conv_id", "turn").agg(F.count("*").alias("quotes"), best.alias("best"))


def link_replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, quotes, reply_conv, reply_turn): the message that each message replies to.

    One row for each (conv_id, turn) of messages (conv_id, turn, role, text; other columns are ignored); of several rows with
    that key the one with the least (role, text) counts. Rows without conv_id or turn are left out. A null or empty text has an
    empty body and no quotes. reply_conv and reply_turn are null for a first message without a found quotation. An empty table
    gives an empty result; very long texts are read whole.
    """
    clean = messages.where("conv_id is not null and turn is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    clean = stored(clean.select("conv_id", "turn", "m.role", "m.text"))
    found = _quotations(clean)
    bodies = clean.where(f"not ({QUOTES})").select("conv_id", "turn", "role", F.col("text").alias("body")).unionByName(passages(clean.where(QUOTES)).drop("passages"))
    previous = clean.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    out = bodies.join(previous, ["conv_id", "turn"], "left")
    reply = F.when(F.col("previous").isNotNull(), F.struct(F.col("conv_id"), F.col("previous").alias("turn")))
    if found is None:
        out = out.withColumn("quotes", F.lit(0).cast("long"))
    else:
        out, reply = out.join(found, ["conv_id", "turn"], "left"), F.coalesce(F.col("best.source"), reply)
    return out.withColumn("r", reply).select("conv_id", "turn", "role", "body", F.coalesce("quotes", F.lit(0).cast("long")).alias("quotes"), F.col("r.conv_id").alias("reply_conv"), F.col("r.turn").alias("reply_turn"))


def in_reply_order(linked: DataFrame) -> DataFrame:
    """linked (conv_id, turn, reply_conv, reply_turn, other columns) with position, from 1 in each conversation.

    The order is that of a walk through the replies, depth first: a message, then each reply to it with all below it, by turn.
    Messages that reply to none of their conversation begin anew, by turn. A reply always has a later turn than what it replies to.
    conv_id and turn are not null and no pair of them is given twice, as in the rows of link_replies(); nulls elsewhere change nothing.

    Runs of messages that each reply to the turn just before are walked without a stop, so the walk is one over such runs, those
    attached to a run's later messages first. Its steps (into a run, out of it) form a list, which is ranked by pointer doubling:
    as many joins as the logarithm of the most runs of a conversation, none where every conversation is one run. Runs are
    found by ranges of turns, so no task holds a long conversation.
    """
    rows = stored(linked)
    own = F.when(F.col("reply_conv") == F.col("conv_id"), F.col("reply_turn"))
    m = rows.select("conv_id", "turn", own.alias("parent")).withColumn("start", F.when(F.coalesce(F.col("parent") != F.col("turn") - 1, F.lit(True)), F.col("turn"))).withColumn("range", F.floor(F.col("turn") / TURNS))
    last = m.groupBy("conv_id", "range").agg(F.max("start").alias("last"))
    before = F.max("last").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    within = F.max("start").over(Window.partitionBy("conv_id", "range").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    placed = m.withColumn("within", within).join(last.withColumn("before", before).select("conv_id", "range", "before"), ["conv_id", "range"])
    placed = settle(placed.select("conv_id", "turn", "parent", F.coalesce("within", "before").alias("run")))
    runs = settle(placed.groupBy("conv_id", "run").agg(F.count("*").alias("size"), F.max(F.when(F.col("turn") == F.col("run"), F.col("parent"))).alias("parent")))
    several = runs.groupBy("conv_id").agg(F.count("*").alias("_n"), F.sum("size").alias("messages")).where("_n > 1")
    most = several.agg(F.max("_n")).first()[0]
    if most is None:
        begins = runs.select("conv_id", "run", F.lit(0).cast("long").alias("before"))
    else:
        kept = join_counted(runs, several.select("*", F.lit(1).alias("many")), ["conv_id"], runs.count(), "left")
        walked = settle(kept.where("many is not null").select("conv_id", "run", "size", "parent", "messages"))
        holder = placed.select("conv_id", F.col("turn").alias("parent"), F.col("run").alias("holder"))
        siblings = Window.partitionBy("conv_id", "holder").orderBy(F.desc("parent"), "run")
        known = walked.join(holder, ["conv_id", "parent"], "left").withColumn("next", F.lead("run").over(siblings)).withColumn("k", F.row_number().over(siblings))
        child = known.where("k = 1 and holder is not null").select("conv_id", F.col("holder").alias("run"), F.col("run").alias("child"))
        known = known.join(child, ["conv_id", "run"], "left")
        step = lambda run, out: F.struct(run.alias("run"), F.lit(out).alias("out"))
        into = F.struct(step(F.col("run"), False).alias("at"), F.col("size").alias("weight"), F.coalesce(F.when(F.col("child").isNotNull(), step(F.col("child"), False)), step(F.col("run"), True)).alias("to"))
        leave = F.struct(step(F.col("run"), True).alias("at"), F.lit(0).cast("long").alias("weight"), F.coalesce(F.when(F.col("next").isNotNull(), step(F.col("next"), False)), F.when(F.col("holder").isNotNull(), step(F.col("holder"), True))).alias("to"))
        steps = settle(known.select("conv_id", F.explode(F.array(into, leave)).alias("s")).select("conv_id", "s.*"))
        for _ in range(ceil(log2(2 * most)) + 1):
            ahead = steps.select("conv_id", F.col("at").alias("to"), F.col("weight").alias("more"), F.col("to").alias("beyond"))
            # steps that have come to the end stay out of the join: they would all meet under the key null
            moved = steps.where("to is not null").join(ahead, ["conv_id", "to"]).select("conv_id", "at", (F.col("weight") + F.col("more")).alias("weight"), F.col("beyond").alias("to"))
            steps = settle(moved.unionByName(steps.where("to is null")))
        ranked = steps.where("not at.out").select("conv_id", F.col("at.run").alias("run"), F.col("weight").alias("rest"))
        begins = kept.join(ranked, ["conv_id", "run"], "left").select("conv_id", "run", F.when(F.col("rest").isNotNull(), F.col("messages") - F.col("rest")).otherwise(0).alias("before"))
    # a run is a range of turns, cut at the same ranges, so that no key holds a long run
    cut = placed.withColumn("range", F.floor(F.col("turn") / TURNS))
    whole = cut.select("conv_id", "run", "range").distinct().join(begins, ["conv_id", "run"])
    position = F.col("before") + F.col("turn") - F.col("run") + 1
    numbered = cut.join(whole, ["conv_id", "run", "range"]).select("conv_id", "turn", position.alias("position"))
    return rows.join(numbered, ["conv_id", "turn"])


def build_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<position, turn, role, content, reply_conv, reply_turn>>): a conversation in reply order, without quotes.

    Messages that held nothing but quotes have an empty content and stay, so that the replies to them keep their place. A conversation is
    one row here; in_reply_order() gives the same as rows.
    """
    linked = in_reply_order(link_replies(messages))
    one = F.struct("position", "turn", "role", F.col("body").alias("content"), "reply_conv", "reply_turn")
    return linked.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("messages"))


#: DuckDB SQL for the rows of build_conversations, a row for each message.
SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, min(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))) AS m
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
l AS (
  SELECT conv_id, turn, pos, lines[pos] AS line FROM (
    SELECT conv_id, turn, string_split(m.text, chr(10)) AS lines, unnest(range(1, len(string_split(m.text, chr(10))) + 1)) AS pos FROM m)),
v AS (
  SELECT conv_id, turn, pos, len(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS text FROM l),
s AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn ORDER BY pos) THEN 1 ELSE 0 END AS starts FROM v),
g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS run FROM s),
p AS (SELECT conv_id, turn, run, any_value(level) AS level, string_agg(text, chr(10) ORDER BY pos) AS text FROM g GROUP BY conv_id, turn, run),
b AS (
  SELECT conv_id, turn, max(run) AS last, coalesce(string_agg(text, chr(10) ORDER BY run) FILTER (WHERE level = 0), '') AS body, count(*) FILTER (WHERE level > 0) AS n
  FROM p GROUP BY conv_id, turn),
own AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(said), '\s+', ' ', 'g')) AS said FROM (
    SELECT conv_id, turn, text AS said FROM p WHERE level = 0 UNION SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM p WHERE level = 0)),
near AS (SELECT conv_id, said, min(turn) AS near_turn FROM own WHERE said <> '' GROUP BY conv_id, said),
f AS (SELECT said, min(struct_pack(conv_id := conv_id, turn := near_turn)) AS f FROM near GROUP BY said),
q AS (SELECT conv_id, turn, level, run, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS said FROM p WHERE level > 0),
j AS (
  SELECT q.conv_id, q.turn, level, run,
    CASE WHEN near_turn < q.turn THEN struct_pack(conv_id := q.conv_id, turn := near_turn)
         WHEN f.f.conv_id <> q.conv_id THEN f.f END AS source
  FROM q LEFT JOIN near ON near.conv_id = q.conv_id AND near.said = q.said LEFT JOIN f ON f.said = q.said WHERE q.said <> ''),
k AS (
  SELECT conv_id, turn, count(*) AS quotes, min(struct_pack(level := level, run := -run, source := source)) FILTER (WHERE source IS NOT NULL) AS best
  FROM j GROUP BY conv_id, turn),
r AS (
  SELECT m.conv_id, m.turn, m.m.role AS role, CASE WHEN b.n = 0 THEN m.m.text ELSE trim(b.body, chr(10)) END AS content,
    CASE WHEN k.best IS NOT NULL THEN k.best.source WHEN z.turn IS NOT NULL THEN struct_pack(conv_id := m.conv_id, turn := z.turn) END AS source
  FROM m JOIN b USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn) LEFT JOIN m z ON z.conv_id = m.conv_id AND z.turn = m.turn - 1),
t(conv_id, turn, path) AS (
  SELECT conv_id, turn, [turn] FROM r WHERE source IS NULL OR source.conv_id <> conv_id
  UNION ALL SELECT r.conv_id, r.turn, list_append(t.path, r.turn) FROM r JOIN t ON r.source.conv_id = r.conv_id AND r.conv_id = t.conv_id AND r.source.turn = t.turn)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS position, turn, role, content, source.conv_id AS reply_conv, source.turn AS reply_turn
FROM r JOIN t USING (conv_id, turn)
"""
