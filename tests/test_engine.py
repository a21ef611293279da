import time

import pytest
from pyspark.sql import Observation, functions as F

from compare import connection, rows
from paperlane.functions import text as T
from paperlane.operators import about, answers, events, library, passages as P, retrieve
from paperlane.plans import queries
from paperlane.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = connection(SF).sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression).first()[0]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("families", "family"), ("family", "fami"), ("buildings", "building"), ("building", "build"), ("passes", "passe"), ("running", "run"), ("adding", "add"), ("falling", "fall"), ("is", "is"), ("gas", "gas"), ("2027", "2027"), ("landlord's", "landlord'"), ("boxes", "boxe"), ("annexes", "annex"), ("churches", "church")],
)
def test_stem(spark, word, stem):
    assert one(spark, F.expr(T.stem_sql("w")), w=word) == stem
    assert one(spark, T._stem(F.col("w")), w=word) == stem


def test_tokens(spark):
    assert one(spark, T.tokens("t"), t="The café's 'quoted' words - a 7 x landlord's!") == ["caf", "quot", "word", "7", "landlord'"]


def test_tidy(spark):
    assert one(spark, T.tidy(F.col("t")), t="﻿a\r\nb  c d\x00\n\n\n\ne \t\n f\t g  ") == "a\nb c d\n\ne\n f g".replace("\t", "")


def lease(spark):
    pages = [(1, 0, 1, "page 1", "The tenant shall pay a deposit of 500 pounds before moving in."), (1, 1, 2, "page 2", "The garden must be kept tidy. Pets are not allowed in the house."), (1, 2, 3, "page 3", "Either side may end this agreement by giving two months notice in writing.")]
    return spark.createDataFrame(pages, "doc_id long, page_pos int, number int, label string, text string")


@pytest.mark.parametrize(("question", "page"), [("how much is the deposit", 1), ("can I keep a pet", 2), ("how long is the notice period", 3)])
def test_search_finds_the_page(spark, question, page):
    asked = spark.createDataFrame([("q", question)], "query_id string, question string")
    hit = retrieve.search(asked, lease(spark)).where("rank = 1").first()
    assert (hit.number, hit.label) == (page, f"page {page}")


def test_confidence_and_blank_questions(spark):
    asked = spark.createDataFrame([("yes", "how much is the deposit"), ("no", "notice about spacecraft propulsion chemistry regulation budget"), ("blank", "  ")], "query_id string, question string")
    found = {r.query_id: r.found for r in retrieve.confidence(asked, lease(spark)).collect()}
    assert found == {"yes": True, "no": False, "blank": False}
    pairs = spark.createDataFrame([("yes", 1), ("yes", 9), ("blank", 1)], "query_id string, doc_id long")
    told = {(r.query_id, r.doc_id): r.reason for r in retrieve.confidence(asked, lease(spark), asked=pairs).collect()}
    assert told == {("yes", 1): "ok", ("yes", 9): "empty", ("blank", 1): "empty"}


def test_windows(spark):
    made = [(n, 0, 1, "p", " ".join(f"w{i}" for i in range(n))) for n in (1, 105, 106, 150, 400)] + [(7, 0, 1, "p", "  ")]
    got = P.passages(spark.createDataFrame(made, "doc_id long, page_pos int, number int, label string, text string")).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 1, 105: 1, 106: 2, 150: 2, 400: 7}


def test_about(spark):
    terms = [r.term for r in about.keywords(lease(spark)).orderBy("rank").collect()]
    assert "deposit" in terms
    assert about.openings(lease(spark)).first().opening.startswith("The tenant")


def test_support_of_long_texts(spark):
    said = " ".join(f"kilo{i} kilo{i} vain{i}" for i in range(30_000))
    known = " ".join(f"kilo{i}" for i in range(30_000))
    began = time.time()
    got = answers.support(spark.createDataFrame([("a", said, known), ("b", "", known), ("c", said, ""), ("d", None, known)], "turn_id string, answer string, sources string")).collect()
    assert {r.turn_id: (r.checked, r.ratio, r.supported) for r in got} == {"a": (True, 0.67, True), "b": (False, None, None), "c": (False, None, None), "d": (None, None, None)}
    assert time.time() - began < 60  # each word with each would be 2.7 billion comparisons


def test_support(spark):
    source = "The deposit is five hundred pounds, protected in a scheme."
    said = [("faithful", "The deposit is five hundred pounds (page 1).", source), ("invented", "Landlords always repaint bedrooms every seventeen years.", source), ("refusal", "I could not find that in your document.", source), ("nothing", "It is so.", source), ("no source", "The deposit is large.", "")]
    got = {r.turn_id: (r.checked, r.supported) for r in answers.support(spark.createDataFrame(said, "turn_id string, answer string, sources string")).collect()}
    assert got == {"faithful": (True, True), "invented": (True, False), "refusal": (False, None), "nothing": (False, None), "no source": (False, None)}


def test_library(spark):
    empty = spark.createDataFrame([], "id string, source_name string, added double, words int")
    new = lambda *r: spark.createDataFrame(list(r), "source_name string, added double, words int")
    first = library.upsert(new(("../../etc/passwd.txt", 1.0, 3), ("b.txt", 1.0, 4)), empty)
    again = library.upsert(new(("b.txt", 2.0, 9)), first.drop("replaced"))
    got = {r.source_name: (r.words, r.replaced) for r in again.collect()}
    assert got == {"-.-etc-passwd.txt": (3, False), "b.txt": (9, True)}
    assert all(c not in n for n in got for c in ("/", "\\", ".."))
    one_id = again.where("source_name = 'b.txt'").select("id")
    assert library.delete(again, one_id).count() == 1
    assert library.lookup(again, "../../settings").count() == 0
    assert tuple(library.stats(again).first()) == (2, 12)


def test_settings_and_models(spark):
    s = spark.createDataFrame([("me", {"model": "a", "last_opened": "x"})], "owner string, settings map<string,string>")
    p = spark.createDataFrame([("me", {"model": "b", "colour": "red"})], "owner string, patch map<string,string>")
    assert library.patch_settings(s, p).first().settings == {"model": "b", "last_opened": "x"}
    e = spark.createDataFrame([("x", ["big", "llama-3b", "Qwen-1B"]), ("y", ["long-name", "short"]), ("z", ["a", "saved"])], "id string, models array<string>")
    saved = spark.createDataFrame([("z", "saved")], "id string, model string")
    assert {r.id: r.model for r in library.default_models(e, saved).collect()} == {"x": "Qwen-1B", "y": "short", "z": "saved"}


def test_events(spark):
    lines = [("s", 1, 'data: {"message": {"content": "a"}}'), ("s", 2, ""), ("s", 3, '{"choices": [{"delta": {"content": "b"}}]}'), ("s", 4, 'data: {"response": "c'), ("s", 5, "data: [DONE]"), ("s", 6, '{"text": "late"}')]
    got = events.read_lines(spark.createDataFrame(lines, "stream_id string, seq int, line string")).orderBy("seq").collect()
    assert [r.text for r in got] == ["a", "b", "c"]
    slices = spark.createDataFrame([("u", 1, 999, 10), ("u", 2, 0, 10), ("u", 3, 10, 5), ("u", 4, 10, 5)], "upload_id string, arrival int, offset long, size long")
    assert [(r.accepted, r.expected) for r in events.assemble_uploads(slices).orderBy("arrival").collect()] == [(False, 0), (True, 0), (True, 10), (False, 15)]


def test_readers(spark):
    html = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>before</p><h1>One</h1><p>first</p><h2>Two</h2>second<script>no()</script></body></html>"
    got = readers.html_sections(spark.createDataFrame([(1, html)], "doc_id long, html string")).orderBy("number").collect()
    assert [(r.title, r.label, r.text) for r in got] == [("A & B", "section 1", "before"), ("A & B", "section “One”", "first"), ("A & B", "section “Two”", "second")]
    text = [(1, "lost\n# One\na\n\n## Two\nb"), (2, "\n\n".join(f"p{i}" for i in range(14)))]
    got = readers.text_parts(spark.createDataFrame(text, "doc_id long, text string")).orderBy("doc_id", "number").collect()
    assert [(r.doc_id, r.label) for r in got] == [(1, "section “One”"), (1, "section “Two”"), (2, "part 1"), (2, "part 2")]
    files = [("a.pdf", b"junk\n%PDF-1.4"), ("b", b"PK\x03\x04..word/document.xml"), ("c.tsv", b"x"), ("d", b"plain words here"), ("e", bytes(range(256)) * 20)]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in files], "name string, content binary")
    assert [r[0] for r in df.select(readers.sniff(F.col("name"), F.col("content"))).collect()] == ["pdf", "docx", "csv", "text", "unknown"]


@pytest.mark.parametrize("fragment", ["caf&eacute; &mdash; &#8217;x&#x2019; &amp;lt; &lt;b&gt; &notanentity; &copy &Uuml;", "no reference", "&", "a &#1; b &#0; &#128;"])
def test_character_references(spark, fragment):
    from html import unescape

    assert one(spark, readers.decoded(F.col("t")), t=fragment) == unescape(fragment)


def test_csv_files(spark):
    text = 'name,, age \r\n,,\n"Ann, ""A""",x,3,extra\n\n bob,,4\nonly\n"two\nlines",1,2\n'
    pages = readers.csv_files(spark.createDataFrame([("f", text), ("head", "a,b\n"), ("none", "")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.label, r.note) for r in pages] == [("f", "rows 1–4", "")]
    assert pages[0].text == 'name: Ann, "A", column 2: x, age: 3, column 4: extra\nname: bob, age: 4\nname: only\nname: two\nlines, column 2: 1, age: 2'
    long = "h\n" + "\n".join(map(str, range(60)))
    cut = readers.csv_files(spark.createDataFrame([("f", long)], "doc_id string, text string"), 40).orderBy("number").collect()
    assert [r.label for r in cut] == ["rows 1–25", "rows 26–40"] and {r.note for r in cut} == {"only the first 40 rows are read"}


def plain_csv(text):
    """The lines of a CSV text as the standard reader has it, or what is wrong."""
    import csv
    import io

    csv.field_size_limit(2**31 - 1)
    try:
        rows_ = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    except csv.Error:
        return "error"
    header = [c.strip() or f"column {i + 1}" for i, c in enumerate(rows_[0])] if rows_ else []
    return [", ".join(f"{header[i] if i < len(header) else f'column {i + 1}'}: {c.strip()}" for i, c in enumerate(r) if c.strip()) for r in rows_[1:]]


def test_csv_in_slices(spark):
    """Whatever the slices, the rows are those of the whole text: quoted line ends across borders, quotes within fields, carriage returns."""
    import random

    r = random.Random(4)
    atoms = ["a", "b c", ",", ",", '"', '""', "\n", "\n", '"x,y"', '"line\nend"', '"say ""no"""', 'in"side', "\r\n", " "]
    texts = ["".join(r.choice(atoms) for _ in range(r.randrange(60))) for _ in range(300)]
    texts += ['h,i\n"' + "long\n" * 500 + '",2\n3,4', "a\rb,c\nd", "h\n" + "\n".join(f'"{i}\n{i}"' for i in range(200)), "only,head\n", "", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    for size in (1, 7, 10_000):
        got, bad = {}, set()
        for p in readers.csv_files(df, None, size).collect():
            if p.error:
                bad.add(p.doc_id)
            else:
                got.setdefault(p.doc_id, {})[p.number] = p
        for i, t in enumerate(texts):
            want = plain_csv(t or "")
            if want == "error":
                assert str(i) in bad and str(i) not in got
                continue
            parts = ["\n".join(want[k : k + 25]) for k in range(0, len(want), 25)]
            tidied = [one_tidy(x) for x in parts]
            assert [p.text for _, p in sorted(got.get(str(i), {}).items())] == tidied, (size, t)


def one_tidy(text):
    """As tidy() for these texts."""
    import re

    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\r\n?", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def test_read_files_loses_nothing(spark):
    many = "h,x\n" + "\n".join(f"{i},y" for i in range(20_050))
    files = [("many", "a.csv", many), ("wide", "b.csv", "h\n" + "z" * 200_000 + "\n1\n"), ("bad", "c.csv", "a,b\n1\r2,3\n"), ("text", "d.txt", "one two\n\nthree"), ("page", "e.html", "<head><title>T</title></head><p>a b</p>")]
    df = spark.createDataFrame([(i, n, bytearray(t.encode())) for i, n, t in files], "doc_id string, name string, content binary")
    documents, pages = readers.read_files(df)
    got = {r.doc_id: r for r in documents.collect()}
    assert (got["many"].parts, got["many"].words, got["many"].note, got["many"].title) == (802, 20_050 * 4, "", "h, x")
    assert (got["wide"].error, got["wide"].words, got["bad"].error, got["bad"].parts) == (None, 4, "not csv", 0)
    assert (got["text"].words, got["page"].title, got["page"].words) == (3, "T", 2)
    assert pages.where("doc_id = 'many'").agg(F.max("number")).first()[0] == 802 and pages.where("doc_id = 'bad'").count() == 0
    seen = Observation()
    readers.read_files(df, metrics=seen)[0].collect()
    assert seen.get == {"files": 5, "bytes": sum(len(t) for _, _, t in files), "refused": 0, "html_files": 1, "html_bytes": len(files[4][2]), "text_files": 1, "text_bytes": len(files[3][2]), "csv_files": 3, "csv_bytes": sum(len(t) for _, _, t in files[:3])}
    limited = {r.doc_id: r.note for r in readers.read_files(df, 20_000)[0].collect()}
    assert limited["many"] == "only the first 20,000 rows are read" and limited["wide"] == ""


def test_read_files(spark):
    files = [("1", "a.txt", b"# T\nbody"), ("2", "b.html", b"<h1>A</h1><p>x</p>"), ("3", "c.csv", b"h\n1\n"), ("4", "d.doc", b"x"), ("5", "e.xls", b"x"), ("6", "f", b""), ("7", "g.txt", b"  \n"), ("8", "h", bytes(range(256)) * 20), ("9", "i.PDF", b"%PDF-1.4"), ("10", "j", None)]
    documents, pages = readers.read_files(spark.createDataFrame([(i, n, None if b is None else bytearray(b)) for i, n, b in files], "doc_id string, name string, content binary"))
    assert {r.doc_id: r.error for r in documents.collect()} == {"1": None, "2": None, "3": None, "4": "old format", "5": "old format", "6": "empty", "7": "no text", "8": "unknown kind", "9": "no parser", "10": "empty"}
    assert {(r.doc_id, r.label) for r in pages.collect()} == {("1", "section “T”"), ("2", "section “A”"), ("3", "rows 1–1")}


def test_export(spark):
    hits = "hits array<struct<label: string, snippet: string>>"
    turns = [("c", 1, "q", "a", [("page 1", " s "), ("page 2", None)]), ("c", 2, " ", "\n", []), ("c", 3, "only asked", None, None), ("d", 1, None, " ", [])]
    got = answers.export_markdown(spark.createDataFrame(turns, f"chat_id string, turn int, question string, answer string, {hits}"), "T", "2026-02-01").collect()
    assert [(r.chat_id, r.markdown) for r in got] == [("c", "# T\n\nSaved on 2026-02-01. Every answer keeps the page it came from.\n\n## Question 1\n\nq\n\na\n\n**Where this came from**\n\n- page 1: “s”\n- page 2: (a source page)\n\n## Question 2\n\nonly asked\n\n\n")]


def test_summary_falls_back_to_the_title(spark):
    pages = spark.createDataFrame([(1, 0, 1, "p", "an old cat on the mat"), (2, 0, 1, "p", "of it all")], "doc_id long, page_pos int, number int, label string, text string")
    titles = spark.createDataFrame([(1, "The Cat"), (2, "Dogs")], "doc_id long, title string")
    assert {(r.doc_id, r.passage_idx, r.rank) for r in about.summary_hits(pages, titles=titles).collect()} == {(1, 0, 1), (2, 0, 1)}


def test_streamed_uploads(spark, tmp_path):
    from paperlane.streaming import uploads

    steps = [[("u", 1, 999, 10), ("u", 2, 0, 10), ("v", 1, 0, 3)], [("u", 3, 10, 5), ("u", 4, 10, 5), ("v", 2, 3, 1)]]
    for i, rows_ in enumerate(steps):
        spark.createDataFrame(rows_, "upload_id string, arrival long, offset long, size long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("upload_id string, arrival long, offset long, size long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = uploads.assemble(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.upload_id, r.arrival): (r.accepted, r.expected) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = events.assemble_uploads(spark.read.parquet(str(tmp_path / "in")))
    assert got == {(r.upload_id, r.arrival): (r.accepted, r.expected) for r in batch.collect()} and got["u", 3] == (True, 10)


def test_streaming_ingest(spark, tmp_path):
    from paperlane.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha beta")
    q = ingest.ingest(ingest.text_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["alpha beta"]
    import os
    import time

    (tmp_path / "new.txt").write_text("gamma")
    os.utime(tmp_path / "new.txt", (time.time() + 5, time.time() + 5))
    os.replace(tmp_path / "new.txt", tmp_path / "in" / "a2.txt")
    (tmp_path / "in" / "sub").mkdir()
    ingest.ingest(ingest.text_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.text for r in ingest.latest(spark, str(tmp_path / "out")).collect()) == ["alpha beta", "gamma"]
    old = ingest.latest(spark, str(tmp_path / "out")).where("text = 'alpha beta'")
    old.withColumn("text", F.lit("changed")).withColumn("batch", F.lit(9)).write.mode("append").partitionBy("batch").parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in ingest.latest(spark, str(tmp_path / "out")).collect()) == ["changed", "gamma"]


@pytest.mark.parametrize("data", [b"plain", b"", "caf\u00e9 \u20ac".encode(), b"\xef\xbb\xbfmarked", "\u00a3 5 \u2014 \u201cna\u00efve\u201d".encode("cp1252"), b"\x81 caf\xe9 \x93"])
def test_decode_text(spark, data):
    want = None
    for encoding in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            want = data.decode(encoding)
            break
        except UnicodeDecodeError:
            pass
    assert one(spark, readers.decode_text(F.col("c")), c=bytearray(data)) == want


def test_page_by_label(spark):
    pages = spark.createDataFrame([(1, 0, 1, "page 1"), (1, 1, 2, "page 2 (Costs)"), (1, 2, 3, None)], "doc_id long, page_pos int, number int, label string")
    wanted = spark.createDataFrame([("a", 1, "3"), ("b", 1, " “costs” "), ("c", 1, "none"), ("d", 1, None), ("e", 2, "1"), ("f", 1, "99999999999")], "query_id string, doc_id long, wanted string")
    assert {r.query_id: r.number for r in library.page_by_label(wanted, pages).collect()} == {"a": 3, "b": 2, "c": 1, "d": 1, "f": 1}


def test_uploads_are_not_collected(spark):
    made = spark.range(20_000).selectExpr("'u' AS upload_id", "id AS arrival", "id AS offset", "1L AS size")
    out = events.assemble_uploads(made)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert out.where("accepted and expected = arrival").count() == 20_000


def test_csv_parts_hold_every_row(spark):
    made = spark.range(20_030).selectExpr("id", "'d' AS doc")
    pages = readers.csv_pages(made, ["id"], ["id"], F.col("doc"))
    assert pages.agg(F.max("number")).first()[0] == 802 and pages.where("number = 802").first().text.endswith("id: 20029")
    assert readers.csv_pages(made, ["id"], ["id"], F.col("doc"), limit=20_000).count() == 800


def test_index_reads_text_for_phrases_and_hits_only(spark, tmp_path):
    """A question whose phrase nothing may hold is ranked though the stored passages are gone."""
    from paperlane.operators import index

    made = index.update_index(lease(spark), "ix_lease", str(tmp_path / "ix"))
    asked = spark.createDataFrame([("q", "how much is the deposit, notice and pet budget")], "query_id string, question string")
    want = [tuple(r) for r in retrieve.search(asked, lease(spark), texts=False).orderBy("rank").collect()]
    bare = index.Index(made.postings, passages=made.passages.where("false"))
    assert [tuple(r) for r in retrieve.search(asked, index=bare, texts=False).orderBy("rank").collect()] == want and len(want) == 3
    assert retrieve.search(asked, index=made).orderBy("rank").first().text.startswith("Either side") or want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = retrieve.search(asked, index=made, texts=False)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    # an index is found again under another name, and its documents can go
    again = index.open_index(spark, "ix_again", str(tmp_path / "ix"))
    assert again.postings.count() == made.postings.count() > 0
    gone = spark.createDataFrame([(1,)], "doc_id long")
    assert index.update_index(lease(spark).where("false"), "ix_lease", str(tmp_path / "ix"), gone).postings.count() == 0


def test_many_pages_are_one_document(spark):
    """Posting lists of a document of many pages, whose sums meet from many tasks, are those of one page at a time put together."""
    r = [(1, i, i + 1, f"p{i}", f"alpha beta word{i} " + "gamma " * (i % 3)) for i in range(40)] + [(1, 40, 41, "blank", " ")]
    pages = spark.createDataFrame(r, "doc_id long, page_pos int, number int, label string, text string")
    got = {x.term: x for x in P.posting_lists(pages).collect()}
    assert (got["alpha"].df, got["alpha"].n_passages, got["word7"].df) == (40, 40, 1)
    assert sorted((h.passage_idx, h.tf) for h in got["gamma"].hits) == [(i, i % 3) for i in range(40) if i % 3]
    assert {h.passage_idx: h["len"] for h in got["beta"].hits} == {i: 3 + i % 3 for i in range(40)}


def test_a_title_that_stands_in_a_passage_counts(spark):
    pages = spark.createDataFrame([(1, 0, 1, "p", "it is of no use"), (1, 1, 2, "p", "the old cat on a mat and dog"), (1, 2, 3, "p", "cats on old mats")], "doc_id long, page_pos int, number int, label string, text string")
    titles = spark.createDataFrame([(1, "Old Cat on a Mat")], "doc_id long, title string")
    got = {r.passage_idx: (r["rank"], r.score) for r in about.summary_hits(pages, titles=titles).collect()}
    plain = {r.passage_idx: r.score for r in about.summary_hits(pages, titles=titles.withColumn("title", F.lit("Old Mat Cat"))).collect()}
    assert got[1][0] == 1 and abs(got[1][1] - 1.8 * plain[1]) < 0.01 and got[2][1] == plain[2]


def test_sql_functions(spark):
    from paperlane.functions import sql

    sql.register(spark)
    lease(spark).createOrReplaceTempView("lease_pages")
    got = spark.sql("SELECT doc_id, passage_idx, number, label, text FROM pl_passages(TABLE(lease_pages))").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, P.passages(lease(spark)).collect()))
    assert spark.sql("SELECT pl_stem('families') AS a, pl_tokens('The boxes, 7 x running') AS b, pl_label(3, '') AS c").first() == ("family", ["boxe", "7", "run"], "section 3")
    with pytest.raises(Exception, match="no label"):
        spark.sql("SELECT * FROM pl_passages(TABLE(SELECT 1 AS doc_id, 0 AS page_pos, 1 AS number, 'x' AS text))").collect()


def test_extractive_answers(spark):
    hits = [("q", 1, 1, "page 2", "The deposit is 500. Pets may stay! It is due in May"), ("q", 1, 2, "page 5", "Nothing here.\nA deposit of pets is due."), ("q", 2, 1, "page 1", "No such words."), ("blank", 1, 1, "page 1", "Some text.")]
    df = spark.createDataFrame(hits, "query_id string, doc_id long, rank int, label string, text string")
    asked = spark.createDataFrame([("q", "When is the deposit for pets due in May?"), ("blank", "is it")], "query_id string, question string")
    got = {(r.query_id, r.doc_id): r for r in answers.extractive_answers(asked, df).collect()}
    assert got["q", 1].answer == "Pets may stay! (page 2) A deposit of pets is due. (page 5)"
    assert [(s["rank"], s.pos) for s in got["q", 1].sentences] == [(1, 1), (2, 1)]
    assert (got["q", 2].answer, got["q", 2].sentences, got["blank", 1].answer) == ("", [], "")
    assert {r.answer for r in answers.extractive_answers(asked.where("query_id = 'q'"), df.where("doc_id = 1"), 1).collect()} == {"A deposit of pets is due. (page 5)"}


def test_answer_events_without_engines(spark):
    pair = "query_id string, doc_id long"
    asked = spark.createDataFrame([("q", 1), ("q", 2)], pair)
    hits = spark.createDataFrame([("q", 1, 1, "page 1", 2.5)], f"{pair}, rank int, label string, score double")
    said = spark.createDataFrame([("q", 1, "yes", False), ("q", 2, "yes", True)], f"{pair}, answer string, supported boolean")
    got = answers.answer_events(asked, hits, said).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.type, r.payload) for r in got] == [(1, "found", '{"hits":[{"rank":1,"label":"page 1","score":2.5}]}'), (1, "answer", "yes"), (1, "unsupported", ""), (1, "done", "true"), (2, "found", '{"hits":[]}'), (2, "note", "nothing found"), (2, "done", "false")]


def test_logarithms_are_those_of_sql(spark):
    """Passages with the same shares in another order are told apart by the last digit of their sums, so it must be that of SQL."""
    got = spark.range(1, 2000).select((1 + F.col("id") / 7).alias("x")).select("x", retrieve.ln("x").alias("y"), F.log("x").alias("z")).toPandas()
    con = connection(SF)
    want = con.execute("SELECT ln(1 + i / 7) FROM range(1, 2000) r(i) ORDER BY i").fetchall()
    assert [r[0] for r in want] == sorted(got.y) and (got.y != got.z).any()


def test_summary_of_long_keywords_is_not_cut(spark):
    """Keywords of more characters than a question may have are all searched for."""
    words = ["x" * 200 + str(i) for i in range(6)]
    text = " ".join(f"{w} {w}" for w in words[:1]) + " filler" * 200 + " " + " ".join(f"{w} {w}" for w in words[1:])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = about.summary_hits(P.pages_of(docs), one_page=True).collect()
    con = connection(SF)
    con.sql("DROP VIEW documents")
    con.execute("CREATE TABLE documents AS SELECT 1::BIGINT AS doc_id, ?::VARCHAR AS text", [text])
    want = con.sql(queries.ORACLES["summary_hits"]).df()
    assert {(r.passage_idx, r["rank"], r.score) for r in found} == {(r.passage_idx, r["rank"], r.score) for _, r in want.iterrows()}


def test_documents_are_dealt_into_parts_of_bounded_size(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat(sha2(cast(id AS string), 512), 20)").alias("text"))
    docs.repartition(4).write.option("compression", "uncompressed").parquet(str(tmp_path / "d"))
    pages = P.pages_of(spark.read.parquet(str(tmp_path / "d")))
    parts = P.parts_of(pages)
    assert parts >= 3 and P.by_document(pages).rdd.getNumPartitions() == parts


def test_a_change_of_the_index_is_finished_by_its_second_try(spark, tmp_path, monkeypatch):
    """Buckets moved before a failure are neither lost nor moved twice, and emptied ones stay empty."""
    from paperlane.operators import index

    def docs(ids, word):
        return spark.createDataFrame([(i, 0, 1, "p", f"{word}{i} common") for i in ids], "doc_id long, page_pos int, number int, label string, text string")

    path, gone = str(tmp_path / "ix"), spark.createDataFrame([(i,) for i in range(20, 40)], "doc_id long")
    index.update_index(docs(range(40), "old"), "ix_twice", path, one_page=True)
    real, calls = index.move, []

    def stop(*a):
        calls.append(a)
        if len(calls) == 4:
            raise OSError("stopped")
        real(*a)

    monkeypatch.setattr(index, "move", stop)
    with pytest.raises(OSError):
        index.update_index(docs(range(10), "new"), "ix_twice", path, gone, one_page=True, step="2")
    monkeypatch.setattr(index, "move", real)
    made = index.update_index(docs(range(10), "new"), "ix_twice", path, gone, one_page=True, step="2")
    want = {f"new{i} common" for i in range(10)} | {f"old{i} common" for i in range(10, 20)}
    assert {r.text for r in made.passages.collect()} == want and made.passages.count() == 20
    assert sorted(r.doc_id for r in made.postings.where("term = 'common'").collect()) == list(range(20))


def test_keywords_that_are_stop_words(spark):
    import duckdb

    # "onlyed" has the stem "only", which is a stop word and the document's one keyword: the summary is its beginning, as in SQL
    docs = spark.createDataFrame([(1, "cat onlyed dog onlyed"), (2, "cat onlyed boxes onlyed boxes"), (3, "")], "doc_id long, text string")
    got = about.summary_hits(P.pages_of(docs), one_page=True).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(queries.ORACLES["summary_hits"]).df()
    assert rows(got) == rows(want.assign(score=want.score.astype(float))) and got[got.doc_id == 1].score.tolist() == [0.0]


def test_no_generated_method_is_too_large_for_the_jvm(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("about_keywords", "suggested_questions", "postings", "tokens", "score_bars", "extractive_answers"):
            plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
            debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
            made = debug.codegenStringSeq(plan)
            assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) <= 8000, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lists_that_are_read_twice_are_kept(spark):
    for name in ("answer_events", "extractive_answers"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan, name
    spark.catalog.clearCache()


def test_scores_stay_where_their_document_is(spark, tmp_path):
    """Python between postings and scores would have every score of every passage dealt out again, by question and document."""
    import re
    from dataclasses import replace

    from paperlane.operators.index import update_index

    pages = spark.createDataFrame([(i, 0, 1, "part 1", f"The {w} tenant pays the rent. The landlord repairs the roof of {w}.") for i, w in enumerate(("old", "new", "blue"))], "doc_id long, page_pos int, number int, label string, text string")
    q = spark.createDataFrame([(1, "who repairs the roof"), (2, "blue rent or zebras"), (3, "qzx zzxq")], "query_id long, question string")
    index = replace(update_index(pages, "stays", str(tmp_path / "ix"), one_page=True), parts=4)  # of a larger one
    told = retrieve.confidence(q, pages, one_page=True)
    for rows in (retrieve.search(q, pages, one_page=True, texts=False), retrieve.search(q, index=index, texts=False), told):
        assert not re.findall(r"hashpartitioning\(query_id#\d+L?, doc_id", rows._jdf.queryExecution().executedPlan().toString())
    found = sorted(map(tuple, told.collect()), key=str)
    assert len(found) == 7 and (3, None, False, 0.0, 0.0, "empty") in found and {x[3] for x in found if x[0] == 2} == {0.67, 0.33}
    for other in (retrieve.confidence(q, index=index), retrieve.confidence(q, hits=retrieve.search(q, index=index), index=index)):
        assert sorted(map(tuple, other.collect()), key=str) == found


def test_sql_postings_are_generated_code(spark):
    rows = queries.QUERIES["sql_postings"](spark, SF)
    assert "lambdafunction" not in rows._jdf.queryExecution().executedPlan().toString()
    row = spark.sql("SELECT transform(filter(pl_words(t), w -> w <> 'the'), w -> w) AS words, pl_kept('the') AS the, pl_kept('7') AS seven, pl_kept('x') AS x FROM VALUES ('The Cat-s and \"DOGS\" 7 x') AS v(t)").first()
    assert (row.words, row.the, row.seven, row.x) == (["cat-s", "and", "dogs", "7", "x"], False, True, False)


def test_few_terms_are_counted_by_blocks(spark):
    """Of a question's terms alone, words are counted once by block, and no window is made: the lists are those of the whole index."""
    word = lambda i: ("running", "tion", "boxes", "the", "x", "7", "cats", "stopped", "flies", "w%d" % i)[i * 7 % 10]
    texts = ["", None, " \t\n ", "the", "tion", " tion\u00a0cats\n\nRunning  run ", *["\n \t"[i % 3 :].join(map(word, range(n))) for i, n in enumerate((29, 30, 31, 89, 90, 91, 105, 106, 119, 120, 121, 149, 150, 179, 180, 181, 240, 300, 301))]]
    pages = P.pages_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    wanted = spark.createDataFrame([("run",), ("tion",), ("box",), ("7",), ("cat",), ("fly",), ("runn",), ("w5",)], "term string")
    some, every = P.posting_lists(pages, True, wanted), P.posting_lists(pages, True)

    def lists(rows):
        return sorted((r.doc_id, r.term, r.df, r.n_passages, r.avg_len, sorted(map(tuple, r.hits))) for r in rows.collect())

    assert lists(some) == lists(every.join(wanted, "term", "left_semi")) and some.count() > 50
    assert "array_join" not in some._jdf.queryExecution().optimizedPlan().toString()


def _texts(n):
    """Pages of some words of few kinds, with phrases in them."""
    word = lambda i: ("roof", "tenants", "the", "paying", "Rent", "7", "of", "houses", "x", "landlord's")[(i * i + n * i // 3) % 10]
    return [" ".join("\n " * (i % 11 == 0) + word(i * (k + 1)) for i in range(k * 23 % 400)) + ("  The  tenants\npaying the rent " if k % 3 == 0 else "") for k in range(n)]


def test_few_questions_are_scored_where_documents_are(spark, tmp_path):
    """By row of a document, by word or by list, in pieces or at once, scores are those by passage; words aren't grouped in Spark, and nothing is shuffled behind them."""
    import pyarrow as pa

    from paperlane.operators import scores
    from paperlane.operators.index import index_of, update_index

    pages = P.pages_of(spark.createDataFrame([*enumerate(_texts(40)), (90, None), (91, " \n ")], "doc_id long, text string"))
    q = spark.createDataFrame([(3, "are the tenants paying the rent?"), (4, "Tenants paying the rent"), (7, "roof houses 7 landlord's"), (8, "nothing such"), (9, "the of")], "query_id long, question string")
    terms = retrieve.question_terms(q)
    wanted = terms.select("term").distinct()
    made, stored = index_of(pages, True, wanted), update_index(pages, "few_scored", str(tmp_path / "ix"), one_page=True)

    def told(rows):
        return sorted((r.query_id, r.doc_id, r["rank"], r.passage_idx, r.score, r.coverage, tuple(r.matched), r.share) for r in rows.collect())

    for limit in (1, 4):
        want = told(retrieve._by_passage(terms, made, limit, share=True, few=True))
        assert len(want) > 100 and any(x[0] == 4 and x[4] > 2 for x in want)
        for index in (made, stored, index_of(pages, True, wanted).kept()):
            assert told(retrieve.ranked(terms, index, limit, share=True)) == want
    plan = retrieve.search(q, pages, one_page=True, texts=False)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "hashpartitioning" not in plan
    asked, rows = scores.asked_of(terms, retrieve.PHRASE), P.page_words(pages.coalesce(1)).toArrow()
    whole = pa.Table.from_batches(scores.scorer(asked, retrieve.scoring(4), True)(iter(rows.to_batches()))).to_pylist()
    kept = scores.MATCHES, scores.WORDS
    try:
        scores.MATCHES, scores.WORDS = 50, 300
        pieces = pa.Table.from_batches(scores.scorer(asked, retrieve.scoring(4), True)(iter(rows.to_batches(max_chunksize=97)))).to_pylist()
    finally:
        scores.MATCHES, scores.WORDS = kept
    order = lambda x: (x["query_id"], x["doc_id"], x["rank"])
    assert sorted(pieces, key=order) == sorted(whole, key=order) and len(whole) > 100


def test_large_documents_of_an_index_are_scored_by_passage(spark, tmp_path, monkeypatch):
    from paperlane.operators.index import update_index

    pages = P.pages_of(spark.createDataFrame(list(enumerate(_texts(20))), "doc_id long, text string"))
    q = spark.createDataFrame([(3, "are the tenants paying the rent?"), (7, "roof houses 7 landlord's")], "query_id long, question string")
    index = update_index(pages, "large_scored", str(tmp_path / "ix"), one_page=True)
    want = sorted(map(str, retrieve.search(q, index=index, texts=False).collect()))
    monkeypatch.setattr(retrieve, "ROW_PASSAGES", 2)
    assert sorted(map(str, retrieve.search(q, index=index, texts=False).collect())) == want and len(want) > 20


def test_questions_without_a_hit_are_found_in_few_pages(spark, monkeypatch):
    """All pages are searched for the terms of questions that the first pages don't answer, but only pages that may hold them are cut to words."""
    from paperlane.operators import index

    monkeypatch.setattr(index, "FIRST", 1)
    pages = P.pages_of(spark.createDataFrame([(1, "roof"), (2, "annexes"), (3, "a zebra's tail"), (4, "cat 7")], "doc_id long, text string"))
    q = spark.createDataFrame([(1, "roof"), (2, "annex"), (3, "the zebra's"), (4, "zebras"), (5, "7"), (6, ""), (7, "qzx roofing")], "query_id long, question string")
    told = retrieve.confidence(q, pages, one_page=True)
    assert {r.query_id for r in told.collect() if r.reason == "empty"} == {4, 6} and {r.query_id for r in told.collect() if r.doc_id} == {1, 2, 3, 5, 7}
    assert "Aggregate" not in retrieve.search(q, pages, one_page=True, texts=False)._jdf.queryExecution().executedPlan().toString()


def test_words_of_tasks_are_stemmed_as_in_spark(spark):
    words = "families family buildings passes running adding falling is gas 2027 7 x the landlord' boxes annexes churches wishes falls only onlyed ssing zzed abbed a1 stopped fly flies ies eding".split() + [""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.expr(f"CASE WHEN {T.kept_sql('w')} THEN {T.stem_sql('w')} END").alias("term")).collect()
    assert [(r.w, T.term_of(r.w)) for r in got] == [(r.w, r.term) for r in got]


def test_summaries_shuffle_pages_alone(spark):
    """Words are neither dealt by their beginning nor grouped: only documents are dealt, by their id, and what is found."""
    import re

    docs = spark.createDataFrame([*enumerate(_texts(40)), (90, None), (91, " \n "), (92, "it is"), (93, "cat onlyed dog onlyed " * 90)], "doc_id long, text string")
    new = about.summary_hits(P.pages_of(docs), one_page=True)
    dealt = set(re.findall(r"hashpartitioning\((\w+)#\d+L?(, \w+)?", new._jdf.queryExecution().executedPlan().toString()))
    assert dealt == {("doc_id", ", 8")} or dealt == {("doc_id", "")}, dealt
    old = about.summary_hits(P.pages_of(docs), one_page=True, titles=spark.createDataFrame([], "doc_id long, title string"))
    assert sorted(map(str, new.collect())) == sorted(map(str, old.select(new.columns).collect())) and new.where("doc_id = 93 and score = 0").count() == 3
