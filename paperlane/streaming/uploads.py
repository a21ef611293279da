"""Uploads in slices, as a stream with state: what an upload has received so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from ..operators.events import UPLOAD_SECONDS, UPLOAD_VERDICTS, upload_expired, upload_requests, upload_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def assemble(slices: DataFrame) -> DataFrame:
    """(upload_id, arrival, accepted, expected) of a stream of slices (upload_id, arrival, offset, size).

    A slice counts only if it begins where what came before it ends; a refused one leaves the state as it is. The slices of a
    micro-batch are taken in order of arrival. What is held of an upload is one number.
    """
    kind = slices.schema["upload_id"].dataType.simpleString()

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        received = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["arrival", "offset", "size"], kind="stable")
        accepted, expected = [], []
        for offset, size in zip(rows["offset"].tolist(), rows["size"].tolist(), strict=True):
            accepted.append(offset == received)
            expected.append(received)
            received += size if offset == received else 0
        state.update((received,))
        yield pd.DataFrame({"upload_id": rows["upload_id"], "arrival": rows["arrival"], "accepted": accepted, "expected": expected})

    rows = slices.selectExpr("upload_id", "cast(arrival AS long) AS arrival", "cast(offset AS long) AS offset", "cast(size AS long) AS size")
    return rows.groupBy("upload_id").applyInPandasWithState(fold, f"upload_id {kind}, arrival long, accepted boolean, expected long", "received long", "append", "NoTimeout")


def _row(upload: str, answer: tuple) -> Row:
    return Row(**dict(zip((c.split()[0] for c in UPLOAD_VERDICTS.split(", ")), (upload, *answer), strict=True)))


class Upload(StatefulProcessor):
    """An upload as a state machine: its state is one small row, and a timer gives it up when nothing is heard of it."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("upload", "run long, name string, received long, last long")

    def _set(self, state: tuple | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state is None:
            self.state.clear()
            return
        self.state.update(state)
        if state[3] is not None:
            self.handle.registerTimer(state[3] + self.seconds * 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = state = self.state.get() if self.state.exists() else None
        for r in sorted(rows, key=lambda r: (r.arrival is None, r.arrival)):
            state, said = upload_step(state, (r.arrival, r.kind, r.name, r.offset, r.size, r.ms), self.seconds)
            for x in said:
                yield _row(key[0], x)
        if state != before:
            self._set(state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            state = self.state.get()
            self.state.clear()
            yield _row(key[0], upload_expired(tuple(state)))

    def close(self) -> None:
        pass


def uploads(requests: DataFrame, seconds: int = UPLOAD_SECONDS, late: str = "0 seconds") -> DataFrame:
    """What events.uploads() gives, of a stream of requests, with state that survives a restart.

    An upload is given up when the stream's time, its latest request less late, has passed its last request by so many seconds. The session's
    state store must hold several kinds of state; where none is set, it is RocksDB.
    """
    conf = requests.sparkSession.conf
    if "RocksDB" not in (conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = upload_requests(requests).withWatermark("at", late)
    return timed.groupBy("upload_id").transformWithState(Upload(seconds), UPLOAD_VERDICTS, "append", "eventTime")
