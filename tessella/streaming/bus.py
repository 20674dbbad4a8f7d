"""A keyed event bus on Structured Streaming.

Requests (id, type, message, cancel, at) come in; an event takes `pace` seconds for each character of its message and tells
each one; an event that is active ignores further requests of its id, a request with cancel ends it with the part it has
reached, and when it is done its id is free again.

Each id has its own state: the event that is active, a list of requests whose turn hasn't come, and one timer for what is
next. In event time a request's turn comes when the watermark has passed it, so requests may arrive in any order and
batches of any size give the same updates; in processing time it comes at once. Nothing is left of an id without an active
event or a waiting request, so state is bounded by the active ids. State and timers live in the checkpointed state store, and
a restarted stream goes on where it was."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: at_us: microseconds since 1970.
UPDATES = "id long, name string, status string, step int, message string, percent int, complete boolean, at_us long"
NAMES = {"reverse": "ReverseMessage", "compress": "CompressMessage", "yell": "YellMessage"}
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def apply_kind(kind: str, text: str) -> str:
    if kind == "yell":
        return text.upper()
    if kind == "compress":
        return "".join(c for c in text.lower() if "a" <= c <= "z")
    return text[::-1]


class Bus(StatefulProcessor):
    """Keeps one id's event; `turn` is all that happens."""

    def __init__(self, pace_us: int, event_time: bool):
        self.pace, self.event_time = pace_us, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "kind string, message string, start long, reached int")
        self.waiting = handle.getListState("waiting", "at long, kind string, message string, cancel boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs() * 1000
        come = [(r.at_us if now is None else now, self._kind(r.type), r.message or "", bool(r.cancel)) for r in rows]
        if now is None:
            self.waiting.appendList(come)
            self._wake(min(r[0] for r in come))
        else:
            yield from self.turn(key[0], come, now + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        come = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        yield from self.turn(key[0], come, now * 1000)

    @staticmethod
    def _kind(name: str | None) -> str:
        low = (name or "").lower()
        return low if low in NAMES else "reverse"

    def _wake(self, at_us: int) -> None:
        if at_us // 1000 not in list(self.handle.listTimers()):
            self.handle.registerTimer(at_us // 1000)

    def turn(self, id_, requests: list[tuple], now: int) -> Iterator[Row]:
        """All that happens to the id before `now`: steps of its event and requests, in order of time."""
        active = tuple(self.active.get()) if self.active.exists() else None
        done = 0

        def told(kind, status, step, text, percent, at) -> Row:
            return Row(id=id_, name=NAMES[kind], status=status, step=step, message=text, percent=percent, complete=status == "DONE", at_us=at)

        while True:
            come = requests[done] if done < len(requests) else None
            if active:
                kind, message, start, reached = active
                at = start + (reached + 1) * self.pace
                if at < now and (come is None or at <= come[0]):
                    reached += 1
                    yield told(kind, "RUNNING", reached, apply_kind(kind, message[:reached]), int(reached / len(message) * 100), at)
                    active = (kind, message, start, reached)
                    if reached == len(message):
                        yield told(kind, "DONE", reached + 1, apply_kind(kind, message), None, at)
                        active = None
                    continue
            if come is None or come[0] >= now:
                break
            done += 1
            at, kind, message, cancel = come
            if cancel and active:
                kind, message, _, reached = active
                yield told(kind, "CANCELED", reached + 1, "cancelling", None, at)
                yield told(kind, "DONE", reached + 2, apply_kind(kind, message[:reached]), None, at)
                active = None
            elif not cancel and not active:
                if message:
                    active = (kind, message, at, 0)
                else:
                    yield told(kind, "DONE", 1, "", None, at)
        rest = requests[done:]
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        if active:
            self.active.update(active)
        elif self.active.exists():
            self.active.clear()
        nexts = [active[2] + (active[3] + 1) * self.pace] if active else []
        if nexts := nexts + ([rest[0][0]] if rest else []):
            self._wake(min(nexts))

    def close(self) -> None:
        pass


def bus(requests: DataFrame, pace: float = 1.0, delay: str = "0 seconds", event_time: bool = True) -> DataFrame:
    """Updates (UPDATES) of a stream of requests; at is a timestamp, and requests later than `delay` behind the newest are
    lost. With event_time false, `at` isn't needed."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    columns = ["id", "type", "message", "cancel"]
    if event_time:
        rows = requests.select(*columns, "at", F.unix_micros("at").alias("at_us")).withWatermark("at", delay)
    else:
        rows = requests.select(*columns)
    mode = "EventTime" if event_time else "ProcessingTime"
    return rows.groupBy("id").transformWithState(Bus(int(pace * 1_000_000), event_time), UPDATES, "Append", mode)


def replayed(spark: SparkSession, updates: DataFrame, path: str) -> DataFrame:
    """A stream over stored requests run to its end into a table below path; run again on the same path, it goes on with
    what is new."""
    stream = updates.writeStream.format("parquet").option("path", f"{path}/updates").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(UPDATES).parquet(f"{path}/updates")


def insert_if_absent_sink(stream: DataFrame, path: str, checkpoint: str, *keys: str):
    """A writer that appends to a Parquet table the rows of each batch whose keys it doesn't have yet. A batch that is
    replayed finds its rows there, so the result is exactly once."""
    from pyspark.errors import AnalysisException

    from tessella.operators.stores import insert_if_absent

    def put(batch: DataFrame, _: int) -> None:
        try:
            stored = batch.sparkSession.read.parquet(path)
        except AnalysisException:  # no table yet
            stored = batch.limit(0)
        insert_if_absent(batch, stored, *keys).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
