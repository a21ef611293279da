"""Streams with state and idempotent sinks: each against its batch twin, after a restart and after a repeated batch."""

import datetime as dt

from pyspark.sql import functions as F

from paperlane.operators import events, storage
from paperlane.sources import readers
from paperlane.streaming import answers, ingest, uploads

DAY = dt.datetime(2026, 1, 5, 12)


def request(upload, arrival, kind, minutes, name=None, offset=None, size=None):
    return (upload, arrival, kind, DAY + dt.timedelta(minutes=minutes), name, offset, size)


REQUESTS = [
    [request("u", 1, "start", 0, "a.txt"), request("u", 2, "slice", 1, None, 999, 10), request("u", 3, "slice", 1, None, 0, 3), request("v", 4, "slice", 1, None, 0, 3), request("w", 5, "start", 1), request("w", 6, "slice", 2, None, 0, 4)],
    [request("u", 7, "slice", 3, None, 3, 2), request("u", 8, "slice", 3, None, 3, 2), request("u", 9, "finish", 4), request("u", 10, "slice", 4, None, 5, 1), request("w", 11, "slice", 4, None, -1, 1), request("x", 12, "start", 5, "gone")],
    [request("w", 13, "start", 6, "again"), request("w", 14, "slice", 7, None, 0, 1), request("w", 15, "wait", 7), request("x", 16, "slice", 90, None, 0, 1), request("w", 17, "finish", 40)],
]
SCHEMA = "upload_id string, arrival long, kind string, at timestamp, name string, offset long, size long"


def key(r):
    return tuple(map(str, r))


def test_uploads_as_a_state_machine(spark, tmp_path):
    """Each micro-batch is a run of its own, so the state goes through a restart."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for batch in REQUESTS:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = uploads.uploads(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=key)
    rows = spark.createDataFrame([r for b in REQUESTS for r in b], SCHEMA)
    assert got == sorted(map(tuple, events.uploads(rows).collect()), key=key)
    said = {r[1]: r[2:] for r in got}
    assert said[2] == ("slice", 1, False, 0, "a.txt", "out of order") and said[9] == ("finish", 1, True, 5, "a.txt", None)
    assert said[4][-1] == said[10][-1] == "unknown upload" and said[5][4] == "document" and said[11][-1] == said[15][-1] == "bad request"
    assert said[None] == ("expired", 12, False, 0, "gone", "expired") and said[16][-1] == "unknown upload" and said[17][3] == 1
    contents = [("u", 2, 999, b"no"), ("u", 3, 0, b"abc"), ("u", 7, 3, b"de"), ("u", 8, 3, b"XX"), ("w", 6, 0, b"lost"), ("w", 14, 0, b"x")]
    slices = spark.createDataFrame([(u, a, o, bytearray(c)) for u, a, o, c in contents], "upload_id string, arrival long, offset long, content binary")
    files = events.finished_uploads(events.uploads(rows), slices)
    assert sorted((r.doc_id, r.name, bytes(r.content)) for r in files.collect()) == [("u-1", "a.txt", b"abcde"), ("w-13", "again", b"x")]
    assert {r.text for r in readers.read_files(files)[1].collect()} == {"abcde", "x"}


def test_answer_pieces(spark, tmp_path):
    lines = [("s", 1, 'data: {"response": "a"}'), ("s", 2, ""), ("t", 1, '{"message": {"content": "x"}}'), ("s", 3, '{"choices": [{"delta": {"content": " b"}}]}')]
    more = [("s", 3, '{"choices": [{"delta": {"content": " b"}}]}'), ("s", 4, 'data: {"response": "\\"c'), ("s", 5, "data: [DONE]"), ("s", 6, '{"text": "late"}')]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("stream_id string, seq long, line string").parquet(str(tmp_path / "in"))
    table = str(tmp_path / "out")
    for batch in (lines, more):
        spark.createDataFrame(batch, "stream_id string, seq long, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        answers.write_pieces(stream, table, str(tmp_path / "ck")).awaitTermination(120)
    want = {("s", 'a b"c', True), ("t", "x", False)}
    assert set(map(tuple, answers.read_answers(spark, table).collect())) == want
    again = events.pieces_of(spark.createDataFrame(more, "stream_id string, seq long, line string"))
    answers.put_pieces(again, 1, table)  # the last batch once more
    assert set(map(tuple, answers.read_answers(spark, table).collect())) == want
    assert spark.read.parquet(table).where("epoch = 1").count() == 3
    whole = events.joined_pieces(events.read_lines(spark.createDataFrame(lines + more[1:], "stream_id string, seq long, line string")))
    assert {tuple(r) for r in whole.collect()} == {w[:2] for w in want}


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, added timestamp, text string")


def test_ingest_is_an_upsert(spark, tmp_path):
    table, t = str(tmp_path / "t"), lambda n: DAY + dt.timedelta(minutes=n)
    held = lambda: {(r.doc_id, r.text) for r in ingest.latest(spark, table).collect()}
    first = documents(spark, *[(f"d{i}", t(1), f"text {i}") for i in range(30)], ("d0", t(3), "newer"), ("d0", t(2), "older"))
    second = documents(spark, ("d0", t(9), "newest"), ("d1", t(9), "  "), ("e", t(9), "one more"))
    assert held() == set()
    ingest.put_documents(first, 0, table, 8)
    one = {("d0", "newer")} | {(f"d{i}", f"text {i}") for i in range(1, 30)}
    assert held() == one
    ingest.put_documents(first, 0, table, 8)
    assert held() == one
    two = (one - {("d0", "newer"), ("d1", "text 1")}) | {("d0", "newest"), ("e", "one more")}
    for _ in range(2):
        ingest.put_documents(second, 1, table, 8)
        assert held() == two


def test_a_half_done_change_is_finished_from_its_stage(spark, tmp_path, monkeypatch):
    """The change stops after a bucket was taken away; what it held comes from the stage."""
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"d{i}", f"v{i}") for i in range(20)], "doc_id string, v string")
    storage.replace_documents(spark, table, rows, rows, 2, "first")
    change = rows.where("doc_id = 'd3'").withColumn("v", F.lit("new"))
    real, calls = storage.staged, []

    def stop(*args):
        calls.append(real(*args))
        raise RuntimeError("lost")

    monkeypatch.setattr(storage, "staged", stop)
    try:
        storage.replace_documents(spark, table, change, change, 2, "second")
    except RuntimeError:
        pass
    monkeypatch.setattr(storage, "staged", real)
    for r in change.select(storage.bucket_of(F.col("doc_id"), 2)).collect():
        storage.remove(spark, f"{table}/bucket={r[0]}")
    storage.replace_documents(spark, table, change, change, 2, "second")
    got = {r.doc_id: r.v for r in storage.read_documents(spark, table, "doc_id string, v string").collect()}
    assert got == {f"d{i}": f"v{i}" for i in range(20)} | {"d3": "new"} and not storage.exists(spark, f"{table}-staged/second")
    storage.replace_documents(spark, table, rows.where("false"), rows, 2)
    assert storage.read_documents(spark, table, "doc_id string, v string").count() == 0
