"""The queries of the document engine over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sql as sql_functions, text as T
from ..operators import about, answers, events, library, passages as P, retrieve
from ..operators.index import index_of, update_index
from ..operators.storage import shared_dir
from ..sources import readers

QUESTION = "Where is the reation of thand and the tioning described?"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; if it has fewer splits than there are cores, as one file of one row group has, its rows are dealt to all of them."""
    table, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pages_of(_t(spark, sf_dir, "documents"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _pages(), for what deals documents out itself."""
    return P.pages_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _question(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("q").alias("query_id"), F.lit(QUESTION).alias("question"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


# ---- shared SQL of the oracles ------------------------------------------------------------------

_WORDS = r"regexp_extract_all({}, '\S+')"


def _kept(w: str, stopwords: bool = False) -> str:
    return rf"({w} <> '' AND (length({w}) > 1 OR regexp_matches({w}, '^[0-9]$'))" + ("" if stopwords else f" AND {w} NOT IN ({T.quoted(T.STOPWORDS)})") + ")"


def _single(x: str) -> str:
    return f"CASE WHEN length({x}) > 3 AND substr({x}, length({x}), 1) = substr({x}, length({x}) - 1, 1) AND NOT regexp_matches({x}, '[lsz]$') THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"


# written for this dialect by hand, apart from what the engine runs
_KEPT = _kept("w")
_STEM = f"""CASE WHEN length(w) <= 3 THEN w
  WHEN w LIKE '%ies' AND length(w) > 5 THEN regexp_replace(w, 'ies$', 'y')
  WHEN w LIKE '%sses' AND length(w) > 6 THEN regexp_replace(w, 'es$', '')
  WHEN w LIKE '%xes' AND length(w) > 5 THEN regexp_replace(w, 'es$', '')
  WHEN regexp_matches(w, '[cs]hes$') AND length(w) > 6 THEN regexp_replace(w, 'es$', '')
  WHEN w LIKE '%ing' AND length(w) > 5 THEN {_single("regexp_replace(w, 'ing$', '')")}
  WHEN w LIKE '%ed' AND length(w) > 4 THEN {_single("regexp_replace(w, 'ed$', '')")}
  WHEN w LIKE '%ly' AND length(w) > 4 THEN regexp_replace(w, 'ly$', '')
  WHEN w LIKE '%s' THEN regexp_replace(w, 's$', '') ELSE w END"""
_RAW = "unnest(list_transform(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9''’\\-]*'), lambda x: rtrim(x, '''-’'))) AS w, generate_subscripts(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9''’\\-]*'), 1) - 1 AS pos"

_PASSAGES = rf"""
w0 AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL),
w1 AS (SELECT doc_id, text, {_WORDS.format("text")} AS words FROM w0 WHERE text <> ''),
w2 AS (SELECT *, len(words) AS n FROM w1),
w3 AS (SELECT *, CASE WHEN n <= 105 THEN 1 ELSE ceil((n - 90) / 60.0)::INTEGER + 1 END AS k FROM w2),
p AS (
  SELECT doc_id, i::INTEGER AS passage_idx, CASE WHEN n <= 105 THEN text ELSE array_to_string(list_slice(words, i * 60 + 1, i * 60 + 90), ' ') END AS text
  FROM (SELECT *, unnest(range(0, k)) AS i FROM w3))"""
_TOKENS = f"""{_PASSAGES},
k0 AS (SELECT doc_id, passage_idx, {_RAW.format("text", "text")} FROM p),
k AS (SELECT doc_id, passage_idx, pos, {_STEM} AS term FROM k0 WHERE {_KEPT})"""
_INDEX = f"""{_TOKENS},
posted AS (SELECT doc_id, term, passage_idx, count(*) AS tf FROM k GROUP BY doc_id, term, passage_idx),
lengths AS (SELECT p.doc_id, p.passage_idx, greatest(coalesce(c.n, 0), 1) AS len FROM p LEFT JOIN (SELECT doc_id, passage_idx, count(*) AS n FROM k GROUP BY doc_id, passage_idx) c USING (doc_id, passage_idx)),
stats AS (SELECT doc_id, count(*) AS n_passages, avg(len) AS avg_len FROM lengths GROUP BY doc_id),
df AS (SELECT doc_id, term, count(*) AS df FROM posted GROUP BY doc_id, term),
idf AS (SELECT doc_id, term, df, ln(1 + (n_passages - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN stats USING (doc_id))"""


def _search(questions: str) -> str:
    return rf"""{_INDEX},
q0 AS ({questions}),
q1 AS (SELECT query_id, trim(left(question, 500)) AS question FROM q0),
q2 AS (SELECT query_id, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS phrase, {_RAW.format("question", "question")} FROM q1),
q3 AS (SELECT query_id, phrase, {_STEM} AS term, min(pos) AS place FROM q2 WHERE {_KEPT} GROUP BY ALL),
q AS (SELECT query_id, phrase, term, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS pos, count(*) OVER (PARTITION BY query_id) AS n_terms FROM q3),
s1 AS (
  SELECT q.query_id, posted.doc_id, posted.passage_idx, n_terms, phrase, pos, term, idf * tf * (1.4 + 1) / (tf + 1.4 * (1 - 0.72 + 0.72 * len / avg_len)) AS s
  FROM q JOIN posted USING (term) JOIN idf USING (doc_id, term) JOIN stats USING (doc_id) JOIN lengths USING (doc_id, passage_idx)),
s2 AS (
  SELECT query_id, doc_id, passage_idx, n_terms, phrase, list_sum(list(s ORDER BY pos)) AS raw, count(*) / n_terms AS coverage, min(pos) AS first_pos, string_agg(term, ' ' ORDER BY pos) AS matched
  FROM s1 GROUP BY query_id, doc_id, passage_idx, n_terms, phrase),
s3 AS (
  SELECT s2.*, p.text, raw * CASE WHEN length(phrase) > 8 AND contains(trim(regexp_replace(lower(p.text), '\s+', ' ', 'g')), phrase) THEN 1.8 ELSE 1.0 END * (0.6 + 0.4 * coverage) AS score
  FROM s2 JOIN p USING (doc_id, passage_idx)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, first_pos, passage_idx) AS rank FROM s3 QUALIFY rank <= 6)"""


_ONE = f"SELECT 'q' AS query_id, '{QUESTION}' AS question"
_MANY = "SELECT item_id AS query_id, text AS question FROM benchmark"
_CITE = T.CITATION

# ---- queries ------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, len({_WORDS.format('coalesce(text, chr(32))')}) AS words FROM documents")
def doc_word_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.words("coalesce(text, '')")).cast("long").alias("words"))


@query(f"SELECT source, count(*) AS documents, sum(len({_WORDS.format('text')})) AS words FROM documents GROUP BY source")
def library_stats(spark, d):
    return _t(spark, d, "documents").select("source", F.size(T.words("text")).alias("w")).groupBy("source").agg(F.count("*").alias("documents"), F.sum("w").alias("words"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'), chr(160), ' '), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def tidy_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.tidy(F.col("text")).alias("text"))


@query(f"WITH {_PASSAGES} SELECT doc_id, passage_idx, text FROM p")
def passages(spark, d):
    return P.passages(_pages(spark, d), one_page=True).select("doc_id", "passage_idx", "text")


@query(f"WITH {_TOKENS} SELECT doc_id, passage_idx, pos, term FROM k")
def tokens(spark, d):
    return P.token_rows(P.passages(_pages(spark, d), one_page=True))


@query(f"WITH d AS (SELECT doc_id, {_RAW.format('text', 'text')} FROM documents) SELECT doc_id, count(*) AS raw_tokens, count(*) FILTER (WHERE {_KEPT}) AS kept_tokens FROM d GROUP BY doc_id")
def stopword_share(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.explode(T.raw_tokens("text")).alias("w"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("raw_tokens"), F.expr(f"count_if({T.kept_sql('w')})").alias("kept_tokens"))


@query(f"WITH {_INDEX} SELECT doc_id, term, passage_idx, tf FROM posted")
def postings(spark, d):
    return P.postings(P.passages(P.by_document(_whole(spark, d)), one_page=True))


@query(f"WITH {_INDEX} SELECT doc_id, passage_idx, len FROM lengths")
def passage_lengths(spark, d):
    return P.passage_lengths(P.passages(_pages(spark, d), one_page=True))


@query(f"WITH {_INDEX} SELECT doc_id, n_passages, round(avg_len, 6) AS avg_len FROM stats")
def document_stats(spark, d):
    return P.document_stats(P.passage_lengths(P.passages(_pages(spark, d), one_page=True))).withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {_INDEX} SELECT doc_id, term, df, round(idf, 6) AS idf FROM idf")
def term_idf(spark, d):
    lists = P.posting_lists(_whole(spark, d), one_page=True)
    return P.idf(lists.select("doc_id", "term", "df"), lists.select("doc_id", "n_passages").distinct()).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_search(_ONE)} SELECT query_id, doc_id, rank, passage_idx, round(score, 3) AS score, round(coverage, 6) AS coverage, matched FROM hits")
def bm25_all_documents(spark, d):
    hits = retrieve.search(_question(spark), _pages(spark, d), one_page=True, texts=False)
    return hits.select("query_id", "doc_id", "rank", "passage_idx", "score", F.round("coverage", 6).alias("coverage"), F.array_join("matched", " ").alias("matched"))


@query(f"WITH {_search(_MANY)} SELECT query_id, doc_id, rank, passage_idx, round(score, 3) AS score, matched FROM hits")
def bm25_benchmark_questions(spark, d):
    return retrieve.search(_benchmark(spark, d), _pages(spark, d), one_page=True, texts=False).select("query_id", "doc_id", "rank", "passage_idx", "score", F.array_join("matched", " ").alias("matched"))


@query(f"WITH {_search(_MANY)} SELECT query_id, doc_id, rank, passage_idx, label, round(score, 3) AS score, text FROM (SELECT *, 'part 1' AS label FROM hits) WHERE rank = 1")
def stored_index(spark, d):
    # the index is written as tables; questions join its postings, and the passages of the hits are read from it
    name = f"ix_{uuid.uuid4().hex}"
    index = update_index(_whole(spark, d), name, f"{shared_dir(spark)}/{name}", one_page=True)
    return retrieve.search(_benchmark(spark, d), limit=1, index=index).select("query_id", "doc_id", "rank", "passage_idx", "label", "score", "text")


_CHANGED = "documents AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'Here the tioning is: ' || text ELSE text END AS text FROM main.documents WHERE doc_id % 7 <> 2)"


@query(f"WITH {_CHANGED}, {_search(_ONE)} SELECT query_id, doc_id, rank, passage_idx, round(score, 3) AS score, matched FROM hits")
def stored_index_after_changes(spark, d):
    # a seventh of the documents comes again, changed, and another is taken out
    name, pages = f"ix_{uuid.uuid4().hex}", _whole(spark, d)
    update_index(pages, name, f"{shared_dir(spark)}/{name}", one_page=True)
    changed = pages.where("doc_id % 7 = 1").withColumn("text", F.concat(F.lit("Here the tioning is: "), "text"))
    index = update_index(changed, name, f"{shared_dir(spark)}/{name}", pages.where("doc_id % 7 = 2").select("doc_id"), one_page=True)
    return retrieve.search(_question(spark), index=index, texts=False).select("query_id", "doc_id", "rank", "passage_idx", "score", F.array_join("matched", " ").alias("matched"))


@query(f"""WITH {_search(_MANY)},
present AS (SELECT query_id, doc_id, count(DISTINCT term) / any_value(n_terms) AS share FROM s1 GROUP BY query_id, doc_id),
b AS (SELECT query_id, doc_id, round(score, 3) AS score, share FROM hits JOIN present USING (query_id, doc_id) WHERE rank = 1),
z AS (SELECT item_id AS query_id, text AS question FROM benchmark UNION ALL SELECT -1, 'qzx xqz zzxq'),
o AS (SELECT query_id, doc_id, share >= 0.4 AND score >= 0.5 AS found, round(share, 2) AS coverage, score, CASE WHEN share >= 0.4 AND score >= 0.5 THEN 'ok' ELSE 'weak' END AS reason FROM b)
SELECT * FROM o UNION ALL SELECT query_id, NULL, false, 0.0, 0.0, 'empty' FROM z WHERE query_id NOT IN (SELECT query_id FROM o)""")
def confidence(spark, d):
    asked = _benchmark(spark, d)
    nonsense = spark.range(1).select(F.lit(-1).cast(asked.schema["query_id"].dataType).alias("query_id"), F.lit("qzx xqz zzxq").alias("question"))
    return retrieve.confidence(asked.unionByName(nonsense), _pages(spark, d), one_page=True)


@query(rf"""WITH {_search(_ONE)},
want AS (SELECT DISTINCT {_STEM} AS term FROM q2 WHERE {_kept("w", True)}),
h AS (SELECT doc_id, rank, text, {_WORDS.format("text")} AS words FROM hits),
u AS (SELECT doc_id, rank, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM h),
u2 AS (SELECT doc_id, rank, i, lower(trim(word, '.,;:!?"''()')) AS w FROM u),
u3 AS (SELECT doc_id, rank, i, CASE WHEN {_STEM} IN (SELECT term FROM want) THEN 1 ELSE 0 END AS hit FROM u2),
starts AS (SELECT doc_id, rank, unnest(range(0, len(words) - 46 + 1, 6)) AS s FROM h WHERE len(words) > 46),
c AS (SELECT doc_id, rank, s, sum(hit) AS n FROM starts JOIN u3 USING (doc_id, rank) WHERE i >= s AND i < s + 46 GROUP BY doc_id, rank, s),
best AS (SELECT doc_id, rank, s FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, rank ORDER BY n DESC, s) = 1)
SELECT 'q' AS query_id, h.doc_id, h.rank, CASE WHEN len(words) <= 46 THEN text ELSE CASE WHEN s > 0 THEN '… ' ELSE '' END || array_to_string(list_slice(words, s + 1, s + 46), ' ') || CASE WHEN s + 46 < len(words) THEN ' …' ELSE '' END END AS snippet
FROM h LEFT JOIN best USING (doc_id, rank)""")
def snippets(spark, d):
    q = _question(spark)
    return retrieve.snippets(retrieve.search(q, _pages(spark, d), one_page=True), q).select("query_id", "doc_id", "rank", "snippet")


_KEYWORDS = f"""t0 AS (SELECT doc_id, {_RAW.format("text", "text")} FROM documents),
t AS (SELECT doc_id, pos, {_STEM} AS term FROM t0 WHERE {_KEPT}),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS place FROM t GROUP BY doc_id, term HAVING term NOT IN ({T.quoted(T.NOISE)})),
r AS (SELECT *, n > 1 AND length(term) > 3 AS repeated FROM c WHERE (n > 1 AND length(term) > 3) OR length(term) > 5),
z AS (SELECT *, bool_or(repeated) OVER (PARTITION BY doc_id) AS found FROM r),
kw AS (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN repeated THEN n * length(term) ELSE length(term) END DESC, place) AS rank FROM z WHERE repeated OR NOT found QUALIFY rank <= 12)"""


@query(f"WITH {_KEYWORDS} SELECT doc_id, rank, term, n FROM kw")
def about_keywords(spark, d):
    return about.keywords(P.by_document(_whole(spark, d)))


@query(f"SELECT doc_id, CASE WHEN length(trim(text)) > 40 THEN array_to_string(list_slice({_WORDS.format('text')}, 1, 60), ' ') ELSE '' END AS opening, 'part 1' AS labels FROM documents")
def openings(spark, d):
    return about.openings(_pages(spark, d)).select("doc_id", "opening", F.array_join("labels", ", ").alias("labels"))


_SUMMARY = f"""{_INDEX}, {_KEYWORDS.replace("c AS", "c1 AS").replace("FROM c WHERE", "FROM c1 WHERE").replace("r AS", "r1 AS").replace("FROM r)", "FROM r1)")},
a0 AS (SELECT doc_id, rank, term AS w FROM kw WHERE rank <= 8 AND {_kept("term")}),
a1 AS (SELECT doc_id, {_STEM} AS term, min(rank) AS place FROM a0 GROUP BY ALL),
a AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos, count(*) OVER (PARTITION BY doc_id) AS n_terms FROM a1),
x AS (SELECT doc_id, passage_idx, pos, n_terms, idf * tf * 2.4 / (tf + 1.4 * (0.28 + 0.72 * len / avg_len)) AS s FROM a JOIN posted USING (doc_id, term) JOIN idf USING (doc_id, term) JOIN stats USING (doc_id) JOIN lengths USING (doc_id, passage_idx)),
y AS (SELECT doc_id, passage_idx, min(pos) AS first_pos, list_sum(list(s ORDER BY pos)) * (0.6 + 0.4 * count(*) / any_value(n_terms)) AS raw FROM x GROUP BY doc_id, passage_idx),
asked AS (SELECT doc_id, lower(string_agg(term, ' ' ORDER BY rank)) AS phrase FROM kw WHERE rank <= 8 GROUP BY doc_id),
v AS (SELECT y.*, raw * CASE WHEN length(phrase) > 8 AND contains(trim(regexp_replace(lower(p.text), '\\s+', ' ', 'g')), phrase) THEN 1.8 ELSE 1.0 END AS score FROM y JOIN asked USING (doc_id) JOIN p USING (doc_id, passage_idx)),
f AS (SELECT doc_id, passage_idx, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first_pos, passage_idx) AS rank FROM v QUALIFY rank <= 5),
summary AS (SELECT doc_id, passage_idx, rank, round(score, 3) AS score FROM f UNION ALL SELECT doc_id, passage_idx, passage_idx + 1, 0 FROM p WHERE passage_idx < 3 AND doc_id NOT IN (SELECT doc_id FROM f))"""


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def summary_hits(spark, d):
    return about.summary_hits(_whole(spark, d), one_page=True)


@query(f"""WITH {_SUMMARY}
SELECT doc_id, '{answers.SUMMARY_RULES}' AS system, 'Extracts from “' || CASE WHEN doc_id % 5 = 0 THEN 'the document' ELSE 'doc ' || doc_id END || '” (its beginning, then the parts that stand for it best):' || chr(10) || chr(10) || string_agg('[' || rank || '] (part 1)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS user
FROM summary JOIN p USING (doc_id, passage_idx) GROUP BY doc_id""")
def summary_prompts(spark, d):
    pages = _whole(spark, d)
    hits = index_of(pages, one_page=True).texts(about.summary_hits(pages, one_page=True)).withColumn("query_id", F.lit("summary"))
    m = answers.messages(answers.extract_blocks(hits), names=_names(spark, d))
    return m.select("doc_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


# the character references that the pages hold, and those that any page may
_ENTITIES = (("nbsp", "chr(160)"), ("copy", "'©'"), ("middot", "'·'"), ("eacute", "'é'"), ("mdash", "'—'"), ("ndash", "'–'"), ("hellip", "'…'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("#x27", "chr(39)"), ("apos", "chr(39)"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'"))


def _tidied_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \t]{{2,}}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _untagged_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in _ENTITIES:
        out = f"replace({out}, '&{name};', {char})" if name != "amp" else f"regexp_replace({out}, '&amp;?', '&', 'g')"  # also without its end
    return out


_BODY = "html"
for _tag in ("script", "style", "noscript", "head", "svg"):
    _BODY = rf"regexp_replace({_BODY}, '(?is)<{_tag}\b.*?</{_tag}>', ' ', 'g')"
_MARKED = rf"regexp_replace(regexp_replace({_BODY}, '(?is)<h[12][^>]*>(.*?)</h[12]>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(p|div|li|tr|h[1-6]|section|article|br)\s*/?>', chr(10), 'g')"


@query(rf"""WITH a AS (SELECT page_id, {_tidied_sql(_untagged_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, string_split({_untagged_sql(_MARKED)}, chr(1)) AS parts FROM pages),
b AS (SELECT page_id, title, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM a),
c AS (SELECT page_id, title, i, CASE WHEN i > 1 THEN {_tidied_sql("split_part(part, chr(2), 1)")} END AS heading, {_tidied_sql("CASE WHEN i > 1 THEN substr(part, instr(part, chr(2)) + 1) ELSE part END")} AS text FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS number FROM c WHERE text <> '')
SELECT page_id AS doc_id, title, number, CASE WHEN coalesce(heading, '') <> '' THEN 'section “' || CASE WHEN length(heading) > 48 THEN rtrim(left(heading, 45)) || '…' ELSE heading END || '”' ELSE 'section ' || number END AS label, text FROM d""")
def html_sections(spark, d):
    raw = _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return readers.html_sections(raw).select("doc_id", "title", "number", "label", "text")


@query(r"""WITH t AS (SELECT conv_id, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS x FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, role, text FROM conversations)
SELECT conv_id AS doc_id, number, 'section “' || role || ' ' || turn || '”' AS label, '## ' || role || ' ' || turn || CASE WHEN trim(text) = '' THEN '' ELSE chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') END AS text FROM l""")
def markdown_sections(spark, d):
    one = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), "text").alias("x"))))
    chats = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(one, lambda x: x["x"]), "\n\n").alias("text"))
    return readers.text_parts(chats).select("doc_id", F.col("number").cast("long").alias("number"), "label", "text")


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("""WITH r AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn, 'c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_mktsegment: ' || c_mktsegment || ', c_acctbal: ' || c_acctbal::DECIMAL(12,2) AS line FROM customer)
SELECT c_mktsegment AS doc_id, (floor((rn - 1) / 25))::INTEGER + 1 AS number, 'rows ' || min(rn) || '–' || max(rn) AS label, string_agg(line, chr(10) ORDER BY rn) AS text FROM r GROUP BY c_mktsegment, floor((rn - 1) / 25)""")
def csv_parts(spark, d):
    rows = _t(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))
    return readers.csv_pages(rows, list(_CUSTOMER), ["c_custkey"], F.col("c_mktsegment")).select("doc_id", "number", "label", "text")


@query("""WITH r AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn, 'c_custkey: ' || c_custkey || ', na"me: ' || c_name || ', x, y, column 3: ' || CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR || ', column 4: more' ELSE c_nationkey::VARCHAR END AS line FROM customer)
SELECT c_mktsegment AS doc_id, (floor((rn - 1) / 25))::INTEGER + 1 AS number, 'rows ' || min(rn) || '–' || max(rn) AS label, string_agg(line, chr(10) ORDER BY rn) AS text, '' AS note FROM r GROUP BY c_mktsegment, floor((rn - 1) / 25)""")
def csv_files(spark, d):
    # a file for each segment: a header with a blank name, a quoted field, and every other row longer than the header
    c = _t(spark, d, "customer").select("c_mktsegment", "c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('" '), "c_name", F.lit(', x, y"')), F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, "more")).alias("line"))
    one = F.array_sort(F.collect_list(F.struct("c_custkey", "line")))
    files = c.groupBy(F.col("c_mktsegment").alias("doc_id")).agg(F.concat(F.lit('c_custkey,"na""me", \n,,\n'), F.array_join(F.transform(one, lambda x: x["line"]), "\r\n")).alias("text"))
    return readers.csv_files(files, None, 500).select("doc_id", "number", "label", "text", "note")


@query(r"""SELECT page_id, left(CASE WHEN n = '' THEN 'document' ELSE n END, 180) AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[\\/\x00-\x1f]', '-', 'g'), '\.{2,}', '.', 'g'), '^[\s.]+|[\s.]+$', '', 'g') AS n FROM pages)""")
def safe_names(spark, d):
    return _t(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """What documents are called; every fifth has no name."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 5 <> 0")
    return docs.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"))


_TURNS = "SELECT a.conv_id, a.turn, a.text AS answer, b.text AS sources FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("sources"))
    return c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("answer"), "sources")


@query(rf"""WITH t AS ({_TURNS}),
s0 AS (SELECT conv_id, turn, {_RAW.format("sources", "sources")} FROM t), s AS (SELECT DISTINCT conv_id, turn, {_STEM} AS term FROM s0 WHERE {_KEPT}),
a0 AS (SELECT conv_id, turn, {_RAW.format(f"regexp_replace(answer, '{_CITE}', ' ', 'g')", f"regexp_replace(answer, '{_CITE}', ' ', 'g')")} FROM t), a AS (SELECT conv_id, turn, pos, {_STEM} AS term FROM a0 WHERE {_KEPT}),
c AS (SELECT a.conv_id, a.turn, count(*) AS n, count(s.term) AS covered FROM a LEFT JOIN s ON s.conv_id = a.conv_id AND s.turn = a.turn AND s.term = a.term WHERE length(a.term) > 3 GROUP BY a.conv_id, a.turn),
k AS (SELECT t.conv_id, t.turn, coalesce(n, 0) AS n, coalesce(covered, 0) AS covered, NOT regexp_matches(answer, '(?i)could not find that in your document') AND coalesce(n, 0) > 0 AND EXISTS (SELECT 1 FROM s WHERE s.conv_id = t.conv_id AND s.turn = t.turn) AS checked FROM t LEFT JOIN c USING (conv_id, turn))
SELECT conv_id, turn, checked, CASE WHEN checked THEN round(covered / n, 2) END AS ratio, CASE WHEN checked THEN CASE WHEN n < 3 THEN covered > 0 ELSE covered / n >= 0.4 END END AS supported FROM k""")
def answer_support(spark, d):
    turns = _turns(spark, d).select(F.struct("conv_id", "turn").alias("turn_id"), "answer", "sources")
    return answers.support(turns).select("turn_id.conv_id", "turn_id.turn", "checked", "ratio", "supported")


@query(f"WITH {_search(_ONE)} SELECT query_id, doc_id, string_agg('[' || rank || '] (part 1)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS extracts FROM hits GROUP BY query_id, doc_id")
def extract_blocks(spark, d):
    return answers.extract_blocks(retrieve.search(_question(spark), _pages(spark, d), one_page=True))


@query(f"WITH {_search(_ONE)}, x AS (SELECT query_id, doc_id, string_agg('[' || rank || '] (part 1)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS e FROM hits GROUP BY query_id, doc_id) SELECT query_id, doc_id, '{answers.ANSWER_RULES}' AS system, 'Extracts from “' || CASE WHEN doc_id % 5 = 0 THEN 'the document' ELSE 'doc ' || doc_id END || '”:' || chr(10) || chr(10) || e || chr(10) || chr(10) || 'Question: {QUESTION}' AS user FROM x")
def prompts(spark, d):
    q = _question(spark)
    m = answers.messages(answers.extract_blocks(retrieve.search(q, _pages(spark, d), one_page=True)), q, _names(spark, d))
    return m.select("query_id", "doc_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


@query("""WITH t AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn - 1) AS turn, coalesce(trim(u.text, chr(10) || ' '), '') AS question, coalesce(trim(a.text, chr(10) || ' '), '') AS answer
  FROM (SELECT * FROM conversations WHERE role = 'user') u FULL JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t WHERE question <> '' OR answer <> '')
SELECT conv_id AS chat_id, '# Conversation' || chr(10) || chr(10) || 'Saved on 2026-01-31. Every answer keeps the page it came from.' || chr(10) || chr(10) || string_agg('## Question ' || k || chr(10) || chr(10) || question || chr(10) || chr(10) || answer || chr(10) || chr(10) || '**Where this came from**' || chr(10) || chr(10) || '- turn ' || turn || ': ' || CASE WHEN question = '' THEN '(a source page)' ELSE '“' || left(question, 220) || '”' END || chr(10), chr(10) ORDER BY k) AS markdown FROM n GROUP BY conv_id""")
def export_markdown(spark, d):
    c = _t(spark, d, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    source = F.array(F.struct(F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("label"), F.col("question").alias("snippet")))
    both = asked.join(said, ["conv_id", "turn"], "full")
    return answers.export_markdown(both.select(F.col("conv_id").alias("chat_id"), "turn", "question", "answer", source.alias("hits")), "Conversation", "2026-01-31")


@query(r"SELECT doc_id, regexp_replace(text, '(?i)\b(?:tion|thand)[0-9A-Za-z_]*', '<mark>\0</mark>', 'g') AS text FROM documents")
def highlight(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.highlight(F.col("text"), ["tion", "thand", "of"]).alias("text"))


def _library(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.concat("source", F.lit("-"), F.pmod("doc_id", F.lit(40)).cast("string")).alias("source_name"), F.col("doc_id").cast("double").alias("added"), F.size(T.words("text")).alias("words"))
    return docs


@query(rf"""WITH d AS (SELECT source || '-' || (doc_id % 40) AS source_name, doc_id::DOUBLE AS added, len({_WORDS.format("text")}) AS words, doc_id FROM documents),
old AS (SELECT source_name, left(sha256(source_name), 16) AS id, max(struct_pack(added := added, words := words)) AS n FROM d WHERE doc_id % 3 = 0 GROUP BY source_name),
new AS (SELECT source_name, max(struct_pack(added := added, words := words)) AS n FROM d WHERE doc_id % 3 <> 0 GROUP BY source_name)
SELECT left(sha256(new.source_name), 16) AS id, new.source_name, new.n.added AS added, new.n.words AS words, old.id IS NOT NULL AS replaced FROM new LEFT JOIN old USING (source_name)
UNION ALL SELECT id, source_name, n.added, n.words, false FROM old WHERE source_name NOT IN (SELECT source_name FROM new)""")
def library_upsert(spark, d):
    docs = _library(spark, d)
    third = F.col("added").cast("long") % 3 == 0
    empty = spark.createDataFrame([], "id string, source_name string, added double, words int")
    old = library.upsert(docs.where(third), empty).drop("replaced")
    return library.upsert(docs.where(~third), old)


@query(r"""WITH e AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id AS stream_id, event_id, event_type AS message FROM e WHERE before IS DISTINCT FROM event_type""")
def progress_dedup(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("message"))
    return events.changed_progress(e).select("stream_id", "seq.event_id", "message")


@query("""WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 4 AS step, 1 + event_id % 7 AS size FROM events),
f(user_id, k, accepted, expected, received) AS (
  SELECT user_id, 0::BIGINT, false, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT user_id FROM s)
  UNION ALL SELECT f.user_id, s.k, s.step <> 0, f.received, f.received + CASE WHEN s.step <> 0 THEN s.size ELSE 0 END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
SELECT user_id AS upload_id, k AS arrival, accepted, expected FROM f WHERE k > 0""")
def upload_assembly(spark, d):
    from pyspark.sql import Window

    # slices that begin where the accepted ones end, but for every fourth event, which begins one further
    e = _t(spark, d, "events").withColumn("arrival", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    size, good = 1 + F.col("event_id") % 7, F.col("event_id") % 4 != 0
    ends = F.coalesce(F.sum(F.when(good, size).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.assemble_uploads(e.select(F.col("user_id").alias("upload_id"), "arrival", (ends + F.when(good, 0).otherwise(1)).alias("offset"), size.alias("size")))


@query("""SELECT user_id AS stream_id, event_id AS seq, 'answer' AS type, event_type || chr(10) || '"é' AS payload FROM events""")
def sse_round_trip(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.lit("answer").alias("type"), F.concat("event_type", F.lit('\n"é')).alias("payload"))
    body = F.regexp_replace(F.trim("frame"), "^data: ", "")
    read = events.write_lines(e).select("stream_id", "seq", F.regexp_replace(body, "[\r\n]+$", "").alias("body")).where("body <> '[DONE]'")
    return read.select("stream_id", "seq", F.get_json_object("body", "$.type").alias("type"), F.get_json_object("body", "$.payload").alias("payload"))


@query("""SELECT user_id AS stream_id, event_id AS seq, CASE event_id % 5 WHEN 4 THEN event_type || '"x' ELSE event_type || chr(10) END AS text FROM events
WHERE event_id <= coalesce((SELECT min(event_id) FROM events z WHERE z.user_id = events.user_id AND z.event_id % 97 = 96), 1e18) AND event_id % 97 <> 96""")
def sse_lines(spark, d):
    # the four protocols and a broken line, by turns; some streams end early
    e = _t(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("t"), F.concat("event_type", F.lit("\n")).alias("response"))
    kind = F.col("seq") % 5
    message = F.to_json(F.struct(F.struct(F.col("response").alias("content")).alias("message")))
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("response").alias("content")).alias("delta"))).alias("choices")))
    plain = F.to_json(F.struct(F.array(F.struct(F.col("response").alias("text"))).alias("choices")))
    broken = F.concat(F.lit('{"id": 3, "content": "'), "t", F.lit('\\"x'))
    body = F.when(kind == 0, F.to_json(F.struct("response"))).when(kind == 1, message).when(kind == 2, delta).when(kind == 3, plain).otherwise(broken)
    line = F.when(F.col("seq") % 97 == 96, "data: [DONE]").otherwise(F.concat(F.when(kind > 1, "data: ").otherwise(""), body))
    return events.read_lines(e.select("stream_id", "seq", line.alias("line")).unionByName(e.select("stream_id", "seq", F.lit("  ").alias("line")))).select("stream_id", "seq", "text")


@query("""WITH c AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn),
w AS (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN '2' WHEN 1 THEN 'assist' ELSE 'nowhere' END AS w FROM c),
j AS (SELECT c.conv_id, turn, role || ' ' || turn AS label, CASE WHEN w = '2' AND turn = 2 THEN 0 WHEN contains(lower(role || ' ' || turn), w) THEN 1 ELSE 2 END AS place FROM c JOIN w ON w.conv_id = c.conv_id)
SELECT conv_id AS doc_id, turn AS number, label FROM j QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place, turn) = 1""")
def page_by_label(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    turns = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_pos"), F.col("turn").alias("number"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("label"))
    asked = F.when(F.col("doc_id") % 3 == 0, " 2").when(F.col("doc_id") % 3 == 1, "“Assist”").otherwise("nowhere")
    wanted = turns.select(F.col("doc_id").alias("query_id"), "doc_id", asked.alias("wanted")).distinct()
    return library.page_by_label(wanted, turns).select("doc_id", "number", "label")


# ---- files, library, settings, small projections -------------------------------------------------


@query(r"""WITH k AS (SELECT page_id, 'p' || page_id || '.' || list_extract(['html', 'HTM', 'txt', 'csv', 'doc', 'xls', 'zzz', 'pdf', 'md'], (page_id % 9 + 1)::INTEGER) AS name, page_id % 9 AS k FROM pages)
SELECT page_id AS doc_id, CASE k WHEN 0 THEN 'html' WHEN 1 THEN 'html' WHEN 2 THEN 'text' WHEN 3 THEN 'csv' WHEN 4 THEN 'doc' WHEN 5 THEN 'xls' WHEN 6 THEN 'text' WHEN 7 THEN 'pdf' ELSE 'text' END AS kind FROM k""")
def sniffed_kinds(spark, d):
    return _files(spark, d).select("doc_id", readers.sniff(F.col("name"), F.col("content")).alias("kind"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("html", "HTM", "txt", "csv", "doc", "xls", "zzz", "pdf", "md")]), (F.col("page_id") % 9 + 1).cast("int"))
    return _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("."), suffix).alias("name"), F.col("html").cast("binary").alias("content"))


@query(r"""WITH k AS (SELECT page_id, page_id % 9 AS k, len(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '[^\s,]'))) AS lines FROM pages)
SELECT page_id::VARCHAR AS doc_id, CASE k WHEN 4 THEN 'old format' WHEN 5 THEN 'old format' WHEN 7 THEN 'no parser' WHEN 3 THEN CASE WHEN lines < 2 THEN 'no text' END END AS error FROM k""")
def read_errors(spark, d):
    files = _files(spark, d)
    return readers.read_files(files)[0].select("doc_id", "error")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '“£5” — é' || doc_id END AS text FROM documents WHERE text IS NOT NULL""")
def decoded_texts(spark, d):
    windows = F.concat(F.unhex(F.lit("93A33594209720E9")), F.col("doc_id").cast("string").cast("binary"))
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))).otherwise(windows)
    return _t(spark, d, "documents").where("text is not null").select("doc_id", readers.decode_text(content).alias("text"))


@query(rf"""WITH t AS (SELECT conv_id, turn, text || ' (page ' || turn || ') and (Section “x”, 2) or (sheet "no")' AS text FROM conversations WHERE text IS NOT NULL),
c AS (SELECT conv_id, turn, regexp_extract_all(text, '(?i)\(((?:page|part|section|sheet)\s+[^)"]{{1,60}})\)', 1) AS c FROM t)
SELECT conv_id, turn, unnest(c) AS citation, generate_subscripts(c, 1) - 1 AS pos FROM c""")
def citations(spark, d):
    c = _t(spark, d, "conversations").where("text is not null")
    cited = F.concat("text", F.lit(" (page "), F.col("turn").cast("string"), F.lit(') and (Section “x”, 2) or (sheet "no")'))
    return answers.citations(c.select(F.struct("conv_id", "turn").alias("turn_id"), cited.alias("text"))).select("turn_id.conv_id", "turn_id.turn", "citation", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {_search(_ONE)}, n AS (SELECT doc_id, count(*) AS n, string_agg(rank || ' part 1', ', ' ORDER BY rank) AS listed, max(round(score, 3)) AS best FROM hits GROUP BY doc_id),
h AS (SELECT doc_id, count(DISTINCT term) / any_value(n_terms) AS share FROM s1 GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(listed, '') AS listed, CASE WHEN n IS NULL THEN 'empty' WHEN share >= 0.4 AND best >= 0.5 THEN 'ok' ELSE 'weak' END || ' ' || coalesce(round(share, 2) >= 0.4 AND best >= 0.5, false)::VARCHAR || ' ' || round(100 * coalesce(share, 0))::BIGINT AS sure,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'said ' || doc_id END AS answer, doc_id % 4 <> 3 AS supported, doc_id % 9 <> 0 AS engine FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)),
e AS (SELECT doc_id, list_filter([
  {{'type': 'found', 'payload': listed || '; ' || sure}}, CASE WHEN n = 0 THEN {{'type': 'note', 'payload': 'nothing found'}} END,
  CASE WHEN n > 0 AND (answer IS NULL OR NOT engine) THEN {{'type': 'no_engine', 'payload': ''}} END, CASE WHEN n > 0 AND engine AND answer IS NOT NULL THEN {{'type': 'engine', 'payload': '{{"name":"E ' || doc_id || '","model":"m"}}'}} END,
  CASE WHEN n > 0 AND engine AND answer <> '' THEN {{'type': 'answer', 'payload': answer}} END,
  CASE WHEN n > 0 AND engine AND answer = '' THEN {{'type': 'note', 'payload': 'nothing was answered'}} END, CASE WHEN n > 0 AND engine AND answer IS NOT NULL AND NOT supported THEN {{'type': 'unsupported', 'payload': ''}} END,
  {{'type': 'done', 'payload': CASE WHEN n > 0 AND engine AND answer IS NOT NULL THEN 'true' ELSE 'false' END}}], lambda x: x IS NOT NULL) AS e FROM a),
u AS (SELECT doc_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS seq FROM e)
SELECT 'q' AS query_id, doc_id, seq, x.type AS type, x.payload AS payload FROM u""")
def answer_events(spark, d):
    q, pages = _question(spark), _whole(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("q").alias("query_id"), "doc_id")
    kind = F.col("doc_id") % 4
    said = docs.select("query_id", "doc_id", F.when(kind == 0, None).when(kind == 1, "").otherwise(F.concat(F.lit("said "), F.col("doc_id").cast("string"))).alias("answer"), (kind != 3).alias("supported"))
    engines = docs.where("doc_id % 9 <> 0").select("query_id", "doc_id", F.concat(F.lit("E "), F.col("doc_id").cast("string")).alias("name"), F.lit("m").alias("model"))
    # hits and confidence read the same lists of the question's terms, and hits are read twice: both are kept, so that texts are tokenized once
    index = index_of(pages, True, retrieve.question_terms(q).select("term").distinct()).kept()
    hits = retrieve.search(q, index=index).select("query_id", "doc_id", "rank", "label", "score").persist()
    out = answers.answer_events(docs, hits, said, retrieve.confidence(q, hits=hits, asked=docs, index=index), engines)
    # of what was found, the hits' ranks and labels, and the confidence
    told = F.from_json("payload", "hits array<struct<rank: int, label: string, score: double>>, confidence struct<found: boolean, coverage: double, reason: string>")
    listed = F.array_join(F.transform(told["hits"], lambda h: F.concat(h["rank"].cast("string"), F.lit(" "), h["label"])), ", ")
    sure = F.concat_ws(" ", told["confidence"]["reason"], told["confidence"]["found"].cast("string"), F.round(100 * told["confidence"]["coverage"]).cast("long").cast("string"))
    payload = F.when(F.col("type") == "found", F.concat(listed, F.lit("; "), sure)).otherwise(F.col("payload"))
    return out.select("query_id", "doc_id", F.col("seq").cast("long").alias("seq"), "type", payload.alias("payload"))


_PICKS = []
for _k in range(3):
    _left = "" if not _k else f" AND NOT EXISTS (SELECT 1 FROM has z JOIN (SELECT doc_id, ord FROM pick0{''.join(f' UNION ALL SELECT doc_id, ord FROM pick{_i}' for _i in range(1, _k))}) y USING (doc_id, ord) WHERE z.doc_id = has.doc_id AND z.term = has.term)"
    _PICKS.append(f"pick{_k} AS (SELECT doc_id, ord FROM (SELECT has.doc_id, ord, round(sum(weight), 6) AS g FROM has JOIN weights USING (doc_id, term) WHERE true{_left} GROUP BY has.doc_id, ord) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY g DESC, ord) = 1)")


@query(rf"""WITH {_search(_ONE)},
c0 AS (SELECT doc_id, rank, string_split(regexp_replace(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), '
+', chr(1), 'g'), chr(1)) AS c FROM hits),
c1 AS (SELECT doc_id, rank, unnest(c) AS sentence, generate_subscripts(c, 1) AS i FROM c0),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) AS ord, rank, regexp_replace(sentence, '^\s+|\s+$', '', 'g') AS sentence FROM c1 WHERE trim(sentence, ' ' || chr(9) || chr(13)) <> ''),
h0 AS (SELECT doc_id, ord, {_RAW.format("sentence", "sentence")} FROM sentences),
h1 AS (SELECT DISTINCT doc_id, ord, {_STEM} AS term FROM h0 WHERE {_KEPT}),
has AS (SELECT h1.* FROM h1 JOIN q USING (term)),
weights AS (SELECT doc_id, term, round(1 + ln(s / count(*)), 9) AS weight FROM has JOIN (SELECT doc_id, count(*) AS s FROM sentences GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, term, s),
{", ".join(_PICKS)},
picked AS (SELECT * FROM pick0 UNION ALL SELECT * FROM pick1 UNION ALL SELECT * FROM pick2)
SELECT doc_id, coalesce(string_agg(sentence || ' (part 1)', ' ' ORDER BY ord) FILTER (WHERE picked.ord IS NOT NULL), '') AS answer, true AS found FROM sentences LEFT JOIN picked USING (doc_id, ord) GROUP BY doc_id""")
def extractive_answers(spark, d):
    q = _question(spark)
    hits = retrieve.search(q, _whole(spark, d), one_page=True).persist()  # read twice
    texts = hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "text"))).alias("texts"))
    found = F.forall("sentences", lambda x: F.contains(F.try_element_at("texts", x["rank"]), x["sentence"]))
    return answers.extractive_answers(q, hits).join(texts, "doc_id").select("doc_id", "answer", found.alias("found"))


@query(f"WITH {_search(_ONE)} SELECT doc_id, rank, least(100, greatest(6, round(round(score, 3) / 8 * 100))) AS bar FROM hits")
def score_bars(spark, d):
    hits = retrieve.search(_question(spark), _pages(spark, d), one_page=True, texts=False)
    return hits.select("doc_id", "rank", T.score_bar(F.col("score")).alias("bar"))


@query("""SELECT s_suppkey, ((ascii(substr(s, 1, 1)) - 64) * 26 + ascii(substr(s, 2, 1)) - 64) * 26 + ascii(substr(s, 3, 1)) - 65 AS i
FROM (SELECT s_suppkey, chr((65 + s_suppkey % 26)::INTEGER) || chr((65 + s_suppkey // 26 % 26)::INTEGER) || chr((65 + s_suppkey // 7 % 26)::INTEGER) AS s FROM supplier)""")
def column_indexes(spark, d):
    letter = lambda n: F.chr((65 + F.floor(F.col("s_suppkey") / n) % 26).cast("int"))
    reference = F.concat(F.lower(letter(1)), letter(26), letter(7), F.col("s_suppkey").cast("string"))
    return _t(spark, d, "supplier").select("s_suppkey", T.column_index(reference).cast("long").alias("i"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return library.upsert(_library(spark, d), spark.createDataFrame([], "id string, source_name string, added double, words int")).drop("replaced")


_ENTRIES = rf"""d AS (SELECT source || '-' || (doc_id % 40) AS source_name, doc_id::DOUBLE AS added, len({_WORDS.format("text")}) AS words FROM documents),
lib AS (SELECT left(sha256(source_name), 16) AS id, source_name, max(struct_pack(added := added, words := words)) AS n FROM d GROUP BY source_name)"""


@query(f"WITH {_ENTRIES} SELECT id, source_name, n.added AS added, n.words AS words FROM lib WHERE n.added::BIGINT % 3 <> 0")
def library_delete(spark, d):
    entries = _entries(spark, d)
    return library.delete(entries, entries.where(F.col("added").cast("long") % 3 == 0).select("id"))


@query(f"WITH {_ENTRIES} SELECT id, source_name, n.added AS added, n.words AS words FROM lib WHERE id = (SELECT left(sha256((SELECT source || '-' || (doc_id % 40) FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents))), 16))")
def library_lookup(spark, d):
    import hashlib

    first = _t(spark, d, "documents").agg(F.min_by(F.concat("source", F.lit("-"), F.pmod("doc_id", F.lit(40)).cast("string")), "doc_id").alias("n")).first().n
    return library.lookup(_entries(spark, d), hashlib.sha256(first.encode()).hexdigest()[:16])


@query(f"WITH {_ENTRIES} SELECT source_name, row_number() OVER (ORDER BY n.added DESC, id) AS place FROM lib")
def library_newest(spark, d):
    from pyspark.sql import Window

    # a library is small: its entries, not its documents, are put in order
    return library.newest_first(_entries(spark, d)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("added"), "id")).cast("long")).select("source_name", "place")


@query("""SELECT c_custkey AS owner, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS model, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE NULL END AS last_opened, NULL AS other FROM customer""")
def settings_patch(spark, d):
    c = _t(spark, d, "customer")
    settings = c.select(F.col("c_custkey").alias("owner"), F.create_map(F.lit("model"), F.lit("old")).alias("settings"))
    third = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("last_opened"), F.col("c_name"), F.lit("unknown"), F.lit("x"))).otherwise(F.create_map(F.lit("colour"), F.lit("red")))
    second = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("model"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    out = library.patch_settings(settings, c.select(F.col("c_custkey").alias("owner"), F.map_concat(second, third).alias("patch")))
    return out.select("owner", F.col("settings")["model"].alias("model"), F.col("settings")["last_opened"].alias("last_opened"), F.col("settings")["unknown"].alias("other"))


@query("""WITH m AS (SELECT s_suppkey AS id, unnest([p || '-7B', p || '-Mini', p || 'x-3B', p]) AS name, s_suppkey % 3 AS k FROM (SELECT s_suppkey, 'm' || s_suppkey AS p FROM supplier)),
f AS (SELECT id, name, CASE WHEN k = 0 AND name = 'm' || id || '-7B' THEN -1 ELSE coalesce((SELECT min(i) FROM (SELECT unnest(['1b', '1.5b', '2b', '3b', 'mini', 'small', 'tiny']) AS h, unnest(range(0, 7)) AS i) WHERE contains(lower(name), h)), 7) END AS place FROM m)
SELECT id AS s_suppkey, name AS model FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, CASE WHEN place = 7 THEN length(name) ELSE 0 END, name) = 1""")
def model_defaults(spark, d):
    p = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(*[F.concat(p, F.lit(x)) for x in ("-7B", "-Mini", "x-3B", "")]).alias("models"))
    saved = s.where("id % 3 = 0").select("id", F.concat(F.lit("m"), F.col("id").cast("string"), F.lit("-7B")).alias("model"))
    return library.default_models(s, saved).select(F.col("id").alias("s_suppkey"), "model")


@query("""WITH e AS (SELECT n_nationkey AS owner, n_regionkey AS k, n_name FROM nation)
SELECT owner, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'late' ELSE 'first' END AS engine, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'own' ELSE 'a-1b' END AS model FROM e""")
def picked_engines(spark, d):
    n = _t(spark, d, "nation")
    works = F.col("n_regionkey") != 0
    one = lambda pos, name, ok, models: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("id"), ok.alias("ok"), F.array(*[F.lit(m) for m in models]).cast("array<string>").alias("models"))
    made = n.select(F.col("n_nationkey").alias("owner"), F.inline(F.array(one(0, "dead", F.lit(False), ["x"]), one(1, "empty", F.lit(True), []), one(2, "first", works, ["long-name", "a-1b"]), one(3, "late", works, ["own", "tiny"]))))
    saved = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("owner"), F.lit("late").alias("engine"), F.lit("own").alias("model"))
    return library.picked_engines(made, saved)


@query("""SELECT s_suppkey AS machine, name, s_suppkey % 12 = 0 OR s_suppkey % 12 >= needs AS fits FROM supplier, (VALUES ('llama3.2:1b', 2.5), ('qwen2.5:3b', 4.5), ('llama3.1:8b', 9.0)) m(name, needs)""")
def suggested_models(spark, d):
    machines = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("machine"), (F.col("s_suppkey") % 12).cast("double").alias("ram_gb"))
    return library.suggested_models(machines).select("machine", "name", "fits")


@query(f"""WITH {_KEYWORDS},
k AS (SELECT doc_id, list('What does it say about “' || term || '”?' ORDER BY rank) FILTER (WHERE length(term) >= 4) AS k FROM kw GROUP BY doc_id),
g AS (SELECT doc_id, list_slice(['What is this document about?'] || list_slice(coalesce(k, []), 1, 3) || ['What are the most important points?', 'Are there any dates or deadlines?', 'What does it ask of me?'], 1, 5) AS g FROM documents LEFT JOIN k USING (doc_id))
SELECT doc_id, unnest(g) AS question, generate_subscripts(g, 1) - 1 AS pos FROM g""")
def suggested_questions(spark, d):
    out = library.suggested_questions(_t(spark, d, "documents"), about.keywords(P.by_document(_whole(spark, d))))
    return out.select("doc_id", "question", F.col("pos").cast("long").alias("pos"))


_CHAT_PAGES = "c AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn)"


def _chat_pages(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_pos"), F.col("turn").alias("number"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("label"), "text")


@query(f"WITH {_CHAT_PAGES} SELECT conv_id AS doc_id, sum(len({_WORDS.format('text')}))::BIGINT AS words, count(*) AS pages, string_agg(turn || ':' || len({_WORDS.format('text')}), ' ' ORDER BY turn) AS parts FROM c GROUP BY conv_id")
def document_totals(spark, d):
    out = library.document_totals(_chat_pages(spark, d))
    return out.select("doc_id", "words", "pages", F.array_join(F.transform("parts", lambda p: F.concat(p["number"].cast("string"), F.lit(":"), p["words"].cast("string"))), " ").alias("parts"))


@query(f"WITH {_CHAT_PAGES} SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM c GROUP BY conv_id")
def full_texts(spark, d):
    return library.full_texts(_chat_pages(spark, d))


@query(f"WITH {_CHAT_PAGES} SELECT conv_id AS doc_id, 'chat ' || conv_id AS name, turn AS number, 'turn ' || turn AS label, text FROM c")
def json_round_trip(spark, d):
    pages = _chat_pages(spark, d)
    names = pages.select("doc_id", F.concat(F.lit("chat "), F.col("doc_id").cast("string")).alias("name")).distinct()
    return library.from_json(library.to_json(pages, names)).select("doc_id", "name", "number", "label", "text")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 8080 WHEN url LIKE 'https%' THEN 443 ELSE 80 END AS port, CASE page_id % 5 WHEN 0 THEN '📕' WHEN 1 THEN '📘' WHEN 2 THEN '📗' WHEN 3 THEN '🌐' ELSE '📄' END AS icon FROM pages")
def ports_and_icons(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("url", r":\d+", ""), F.lit(":8080/x"))).otherwise(F.regexp_replace("url", r":\d+", ""))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("PDF", "Word document", "Spreadsheet (csv)", "Web page", "Text file")]), (F.col("page_id") % 5 + 1).cast("int"))
    return _t(spark, d, "pages").select("page_id", T.port_of(url).alias("port"), T.kind_icon(kind).alias("icon"))


def _shapes(spark: SparkSession, d: str, shapes: list[tuple[str, str]]) -> DataFrame:
    """Each event's type put for @ into one of the bodies, by turns."""
    body = F.element_at(F.array(*[F.lit(x) for x, _ in shapes]), (F.col("event_id") % len(shapes) + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", F.replace(body, F.lit("@"), F.col("event_type")).alias("body"))


def _shapes_sql(shapes: list[tuple[str, str]], column: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{want.replace(chr(39), chr(39) * 2)}'" for i, (_, want) in enumerate(shapes))
    return f"SELECT event_id, replace(CASE event_id % {len(shapes)} {cases} END, '@', event_type) AS {column} FROM events"


# bodies, and the text that each must give, as these protocols are read
_EVENTS = [
    ('{"message": {"content": "@"}, "response": "no"}', "@"), ('{"message": {}, "response": "no"}', ""), ('{"message": "plain", "response": "@"}', "@"), ('{"message": {"content": null}}', ""),
    ('{"response": "", "choices": [{"text": "no"}]}', ""), ('{"response": 5, "choices": [{"text": "@"}]}', "@"), ('{"response": "1 @"}', "1 @"), ('{"response": "{\\"a\\": 1}"}', '{"a": 1}'),
    ('{"choices": [{"delta": {"content": ""}, "text": "@"}]}', "@"), ('{"choices": [{"delta": {"content": "@"}, "text": "no"}]}', "@"), ('{"choices": [{"delta": null, "message": {"content": "true @"}}]}', "true @"),
    ('{"choices": []}', ""), ('{"choices": ["@"]}', ""), ('["@"]', ""), ('"@"', ""), ('{"other": "@"}', ""), ("{broken @", ""),
]


@query(_shapes_sql(_EVENTS, "text"))
def event_texts(spark, d):
    return _shapes(spark, d, _EVENTS).select("event_id", T.event_text(F.col("body")).alias("text"))


# broken lines, and what is saved of them: every escape, a letter that has none, a backslash before n, the end within a string
_BROKEN = [
    ('{"content": "a\\nb\\tc\\rd@', "a\nb\tc\rd@"), ('x "response" : "\\"@\\" \\/ \\b\\f" , "content": "no"', '"@" / \b\f'), ('{"text":"@\\\\nothing\\\\', "@\\nothing\\"), ('{"content":"\\u00e9 \\q@\\', "u00e9 q@\\"),
    ('{"content": 5, "text": "line\n@"', "line\n@"), ('{"other": "@"', ""), ('{"content":""@', ""), ('{"content":"@\\\\", "x": "', "@\\"),
]


@query(_shapes_sql(_BROKEN, "text"))
def salvaged_texts(spark, d):
    return _shapes(spark, d, _BROKEN).select("event_id", T.salvaged_text(F.col("body")).alias("text"))


_ERRORS = [
    ('{"error": {"message": "@' + "x" * 300 + '"}}', "@" + "x" * 300), ('{"error": "not @"}', "not @"), ('{"error": "true @"}', "true @"), ('{"error": "1 @"}', "1 @"), ('{"error": "[@"}', "[@"), ('{"error": {"code": 5}}', ""),
    ('{"error": {"message": null}}', "None"), ('{"error": {"message": 5}}', "5"), ('{"error": {"message": true}}', "True"), (' {"error": 5} ', '{"error": 5}'), ('{"error": null}', '{"error": null}'), ("\n no json @\t", "no json @"), ('{"other": "@"}', '{"other": "@"}'), ('["error"]', '["error"]'),
]


@query(_shapes_sql(_ERRORS, "message").replace("event_type)", "event_type)", 1).replace("replace(CASE", "left(replace(CASE", 1).replace("event_type) AS", "event_type), 200) AS", 1))
def salvaged_errors(spark, d):
    return _shapes(spark, d, _ERRORS).select("event_id", T.salvaged_error(F.col("body")).alias("message"))


@query("""SELECT n_nationkey AS owner, n_regionkey <> 0 AS ready, CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN 'late' ELSE 'first' END AS engine_id, CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN 'Late' ELSE 'First ' || n_name END AS engine_name,
  CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN 'own' ELSE 'a-1b' END AS model, 'dead Dead false [x] refused 0, first First ' || n_name || ' ' || CASE WHEN n_regionkey = 0 THEN 'false' ELSE 'true' END || ' [long-name a-1b]  11434, late Late ' || CASE WHEN n_regionkey = 0 THEN 'false' ELSE 'true' END || ' [own]  0' AS engines,
  CASE WHEN n_nationkey % 3 = 0 THEN 'true true true' WHEN n_nationkey % 3 = 1 THEN 'true false false' ELSE 'true true false' END AS fits FROM nation""")
def engine_summary(spark, d):
    n = _t(spark, d, "nation")
    works = F.col("n_regionkey") != 0
    one = lambda pos, name, label, ok, models, error, port: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("id"), label.alias("name"), ok.alias("ok"), F.array(*[F.lit(m) for m in models]).alias("models"), F.lit(error).cast("string").alias("error"), F.lit(None).cast("string").alias("why"), F.lit(port).cast("int").alias("port"))
    made = n.select(F.col("n_nationkey").alias("owner"), F.inline(F.array(one(2, "late", F.lit("Late"), works, ["own"], None, None), one(0, "dead", F.lit("Dead"), F.lit(False), ["x"], "refused", None), one(1, "first", F.concat(F.lit("First "), "n_name"), works, ["long-name", "a-1b"], None, 11434))))
    saved = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("owner"), F.lit("late").alias("engine"), F.lit("own").alias("model"))
    machines = n.select(F.col("n_nationkey").alias("owner"), F.element_at(F.array(F.lit(None).cast("double"), F.lit(3.0), F.lit(5.0)), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("ram_gb"))
    out = library.engine_summary(made, saved, machines)
    listed = F.array_join(F.transform("engines", lambda e: F.concat_ws(" ", e["id"], e["name"], e["ok"].cast("string"), F.concat(F.lit("["), F.array_join(e["models"], " "), F.lit("]")), e["error"], e["port"].cast("string"))), ", ")
    return out.select("owner", "ready", "engine_id", "engine_name", "model", listed.alias("engines"), F.array_join(F.transform("suggested", lambda x: x["fits"].cast("string")), " ").alias("fits"))


@query(f"WITH {_ENTRIES} SELECT count(*) AS documents, 0 AS left_documents, 0 AS left_words FROM lib")
def library_clear(spark, d):
    entries = _entries(spark, d)
    left = library.stats(library.cleared(entries)).select(F.col("documents").alias("left_documents"), F.col("words").alias("left_words"))
    return entries.agg(F.count("*").alias("documents")).join(left, how="full")


@query("SELECT user_id AS stream_id, string_agg(event_type, '' ORDER BY event_id) AS text FROM events GROUP BY user_id")
def joined_answers(spark, d):
    return events.joined_pieces(_t(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text")))


# ---- in SQL alone --------------------------------------------------------------------------------


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    sql_functions.register(spark)
    pages = f"SELECT doc_id, 0 AS page_pos, 1 AS number, 'part 1' AS label, coalesce(text, '') AS text FROM parquet.`{d}/documents.parquet`"
    return spark.sql(text.format(documents=f"parquet.`{d}/documents.parquet`", pages=pages))


@query(ORACLES["tidy_documents"])
def sql_tidy(spark, d):
    return _sql(spark, d, "SELECT doc_id, pl_tidy(text) AS text FROM {documents}")


@query(ORACLES["postings"])
def sql_postings(spark, d):
    # words are exploded before they are told apart and stemmed, so that this is generated code; within pl_tokens() it is interpreted
    return _sql(spark, d, "SELECT doc_id, pl_stem(w) AS term, passage_idx, count(*) AS tf FROM (SELECT doc_id, passage_idx, explode_outer(t) AS w FROM (SELECT doc_id, passage_idx, pl_words(text) AS t FROM pl_passages(TABLE({pages})))) WHERE pl_kept(w) GROUP BY ALL")


@query(rf"""WITH {_PASSAGES.replace("90", "40").replace("60.0", "30.0").replace("* 60", "* 30").replace("105", "45")}
SELECT doc_id, passage_idx, text, CASE WHEN length(text) > 48 THEN 'section “' || rtrim(left(text, 45)) || '…”' ELSE 'section “' || text || '”' END AS label FROM p WHERE len({_WORDS.format('text')}) >= 30 OR passage_idx = 0""")
def sql_passages(spark, d):
    return _sql(spark, d, "SELECT doc_id, passage_idx, text, pl_label(number, text) AS label FROM pl_passages(TABLE({pages}), 40, 30)")
