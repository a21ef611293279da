"""Event streams as tables: server-sent lines, progress messages, uploads in slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T


def read_lines(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, text) of the events in lines (stream_id, seq, line): blanks and events without text skipped, ``data:`` stripped, nothing after [DONE]; broken JSON is salvaged."""
    rows = lines.select("stream_id", "seq", F.trim(F.regexp_replace(F.trim("line"), r"^data:\s*", "")).alias("body")).where("body <> ''")
    end = F.min(F.when(F.col("body") == "[DONE]", F.col("seq"))).over(Window.partitionBy("stream_id"))
    rows = rows.withColumn("end", end).where("end is null or seq < end")
    good = F.expr("try_parse_json(body) is not null")
    said = F.when(good, T.event_text(F.when(good, F.col("body")))).otherwise(T.salvaged_text(F.col("body")))
    return rows.select("stream_id", "seq", said.alias("text")).where("text <> ''")


def write_lines(events: DataFrame) -> DataFrame:
    """(stream_id, frame): each event of events (stream_id, seq, type, payload) as a server-sent frame, and [DONE] at the end."""
    frames = events.where("type is not null").select("stream_id", "seq", F.concat(F.lit("data: "), F.to_json(F.struct("type", "payload")), F.lit("\n\n")).alias("frame"))
    done = events.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).withColumn("frame", F.lit("data: [DONE]\n\n"))
    return frames.unionByName(done)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(stream_id, text): the pieces (stream_id, seq, text) of each stream, joined in order."""
    one = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return pieces.groupBy("stream_id").agg(F.array_join(F.transform(one, lambda x: x["text"]), "").alias("text"))


def changed_progress(progress: DataFrame) -> DataFrame:
    """progress (stream_id, seq, message) without the messages that repeat the one before."""
    before = F.lag("message").over(Window.partitionBy("stream_id").orderBy("seq"))
    return progress.withColumn("_b", before).where(~F.col("message").eqNullSafe(F.col("_b"))).drop("_b")


def assemble_uploads(slices: DataFrame) -> DataFrame:
    """(upload_id, arrival, accepted, expected) of slices (upload_id, arrival, offset, size): a slice counts only if it begins where what came before it ends.

    A refused slice leaves the state as it is, so this is a fold over an upload's slices in order of arrival, not a running
    sum. The slices stream through it sorted; what is held is the number of bytes received.
    """
    kind = slices.schema["upload_id"].dataType.simpleString()
    rows = slices.select("upload_id", F.col("arrival").cast("long").alias("arrival"), F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upload, received, begun = None, 0, False
        for batch in batches:
            accepted, expected = [], []
            for u, offset, size in zip(batch.column("upload_id").to_pylist(), batch.column("offset").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if not begun or u != upload:
                    upload, received, begun = u, 0, True
                accepted.append(None if offset is None else offset == received)
                expected.append(received)
                if offset == received:
                    received += size
            yield pa.RecordBatch.from_arrays([batch.column("upload_id"), batch.column("arrival"), pa.array(accepted, pa.bool_()), pa.array(expected, pa.int64())], ["upload_id", "arrival", "accepted", "expected"])

    ordered = rows.repartition("upload_id").sortWithinPartitions("upload_id", "arrival", "offset", "size")
    return ordered.mapInArrow(fold, f"upload_id {kind}, arrival long, accepted boolean, expected long")


#: An upload that hears nothing for so many seconds is given up.
UPLOAD_SECONDS = 3600
# What an upload without a name is called, and how long a name may be.
UPLOAD_NAME, UPLOAD_NAME_CHARS = "document", 200
UPLOAD_COLUMNS = {"upload_id": "string", "arrival": "long", "kind": "string", "at": "timestamp", "name": "string", "offset": "long", "size": "long"}
UPLOAD_VERDICTS = "upload_id string, arrival long, kind string, run long, accepted boolean, expected long, name string, error string"


def upload_requests(rows: DataFrame) -> DataFrame:
    """The columns of requests (upload_id, arrival, kind, at, name, offset, size) in their types, and ms, the time in milliseconds."""
    return rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in UPLOAD_COLUMNS.items()], F.unix_millis(F.col("at").cast("timestamp")).alias("ms"))


def upload_step(state: tuple | None, request: tuple, seconds: int = UPLOAD_SECONDS) -> tuple[tuple | None, list[tuple]]:
    """The state of an upload, (run, name, received, last time) or none, after a request (arrival, kind, name, offset, size, ms), and what is answered.

    An answer is (arrival, kind, run, accepted, expected, name, error), see uploads().
    """
    arrival, kind, name, offset, size, at = request
    out = []
    if state and at is not None and state[3] is not None and at - state[3] > 1000 * seconds:
        state, gone = None, state
        out.append(upload_expired(gone))
    last = at if at is not None else state and state[3]
    if kind == "start":
        state = (arrival, (name or UPLOAD_NAME)[:UPLOAD_NAME_CHARS], 0, last)
        return state, [*out, (arrival, kind, arrival, True, 0, state[1], None)]
    if not state:
        return None, [*out, (arrival, kind, None, False, None, None, "unknown upload")]
    run, name, received, _ = state
    if kind == "finish":
        return None, [*out, (arrival, kind, run, True, received, name, None)]
    if kind != "slice" or offset is None or offset < 0 or size is None or size < 0:
        return state, [*out, (arrival, kind, run, False, received, name, "bad request")]
    if offset != received:
        return (run, name, received, last), [*out, (arrival, kind, run, False, received, name, "out of order")]
    return (run, name, received + size, last), [*out, (arrival, kind, run, True, received, name, None)]


def upload_expired(state: tuple) -> tuple:
    return (None, "expired", state[0], False, state[2], state[1], "expired")


def uploads(requests: DataFrame, seconds: int = UPLOAD_SECONDS) -> DataFrame:
    """(upload_id, arrival, kind, run, accepted, expected, name, error) of requests (upload_id, arrival, kind, at, name, offset, size), in order of arrival.

    start opens an upload, anew if there is one of that id; run is the arrival of its start. A slice counts if it begins where what came before
    it ends, else it is out of order and leaves the state as it is; expected is what had been received. finish gives the number of
    bytes and closes the upload. What isn't open is an unknown upload; other kinds, and slices without an offset and a size, are bad requests. An
    upload that hears nothing for so many seconds has expired, of which a row without arrival tells when the next request comes.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upload, state = None, None
        for batch in batches:
            out = []
            for u, *request in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != upload:
                    upload, state = u, None
                state, said = upload_step(state, tuple(request), seconds)
                out += [(u, *x) for x in said]
            names = [x.split()[0] for x in UPLOAD_VERDICTS.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    ordered = upload_requests(requests).drop("at").repartition("upload_id").sortWithinPartitions("upload_id", "arrival")
    return ordered.mapInArrow(fold, UPLOAD_VERDICTS)


def finished_uploads(verdicts: DataFrame, slices: DataFrame) -> DataFrame:
    """(doc_id, name, content) of the finished uploads in verdicts, from the accepted of slices (upload_id, arrival, offset, content): files for a reader."""
    done = verdicts.where("kind = 'finish' and accepted").select("upload_id", "run", "name")
    kept = verdicts.where("kind = 'slice' and accepted").select("upload_id", "run", "arrival").join(slices.select("upload_id", "arrival", "offset", "content"), ["upload_id", "arrival"])
    joined = kept.groupBy("upload_id", "run").agg(F.array_sort(F.collect_list(F.struct("offset", "arrival", "content"))).alias("c"))
    content = F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["content"])), ""))
    rows = done.join(joined, ["upload_id", "run"], "left")
    return rows.select(F.concat("upload_id", F.lit("-"), F.col("run").cast("string")).alias("doc_id"), "name", F.coalesce(content, F.lit(b"")).alias("content"))


def pieces_of(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, text, last) of lines (stream_id, seq, line) of streams, each line on its own, so also of a stream of lines: texts, and the [DONE] that ends a stream."""
    rows = lines.select("stream_id", "seq", F.trim(F.regexp_replace(F.trim("line"), r"^data:\s*", "")).alias("body")).where("body <> ''")
    good = F.expr("try_parse_json(body) is not null")
    said = F.when(F.col("body") == "[DONE]", "").when(good, T.event_text(F.when(good, F.col("body")))).otherwise(T.salvaged_text(F.col("body")))
    return rows.select("stream_id", "seq", said.alias("text"), (F.col("body") == "[DONE]").alias("last")).where("last or text <> ''")


def whole_answers(pieces: DataFrame) -> DataFrame:
    """(stream_id, text, ended) of pieces (stream_id, seq, text, last): each stream's texts before its end, in order; a piece that came twice counts once."""
    end = F.min(F.when(F.col("last"), F.col("seq")))
    once = pieces.groupBy("stream_id", "seq").agg(F.max("text").alias("text"), F.bool_or("last").alias("last"))
    each = once.groupBy("stream_id").agg(end.alias("end"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    before = F.filter("p", lambda x: F.col("end").isNull() | (x["seq"] < F.col("end")))
    return each.select("stream_id", F.array_join(F.transform(before, lambda x: x["text"]), "").alias("text"), F.col("end").isNotNull().alias("ended"))
