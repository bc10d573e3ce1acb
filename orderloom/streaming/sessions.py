"""Order sessions: a start opens an order, confirmations, corrections and edits gather, completion emits the record.

The stream keeps one small state per session (transformWithState, RocksDB); the batch twin gets the same records
with running counts. Rules: a new start discards an open order; cancel discards it; events without an open order
count for nothing, but a completion always emits a record.
"""

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import running_count

START, END = "store_confirm_needed", ("order_complete", "order_cancelled")
RECORD = (
    "session_id bigint, completed_at timestamp_ntz, event_id bigint, had_start boolean, store_confirmed boolean, "
    "n_corrections bigint, user_modified boolean, value double")
CORRECTIONS = ("sku_corrected", "store_corrected")
STATE = "opened_at timestamp, store_confirmed boolean, n_corrections bigint, user_modified boolean"

# Spark also unpickles a processor in a process of its own beside the driver, which need not find this package:
# neither added files nor the driver's sys.path reach it. So the processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def segments(events: DataFrame) -> DataFrame:
    """Events with `_seg`, the number of their order in the session: a start begins the next one, an end is its last event."""
    kind = F.col("event_type")
    ends = kind.isin(*END)
    counted = running_count(events, ["session_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), (kind == START) | ends, "_n")
    return counted.withColumn("_seg", F.col("_n") - F.when(ends, 1).otherwise(0))


def sessions_batch(events: DataFrame, limit: str | None = None) -> DataFrame:
    """events: event_id, ts, session_id, event_type, value. One record per completed order.

    An order that is completed more than `limit` (an interval) after its start counts as one without a start.
    """
    kind = F.col("event_type")
    done = kind == "order_complete"
    per = segments(events).groupBy("session_id", "_seg").agg(
        F.max(F.when(kind == START, F.col("ts"))).alias("_start"),
        F.max(kind == START).alias("had_start"), F.max(kind == "store_confirmed").alias("_ok"),
        F.count_if(kind.isin("sku_corrected", "store_corrected")).alias("_c"), F.max(kind == "user_modified").alias("_m"),
        F.max(F.when(done, F.col("ts"))).alias("completed_at"), F.max(F.when(done, F.col("event_id"))).alias("event_id"),
        F.max(F.when(done, F.col("value"))).alias("value"))
    if limit:
        per = per.withColumn("had_start", F.col("had_start") & F.coalesce(F.col("completed_at") - F.col("_start") <= F.expr(f"INTERVAL {limit}"), F.lit(False)))
    return per.where("completed_at is not null").select(
        "session_id", "completed_at", "event_id", "had_start", (F.col("had_start") & F.col("_ok")).alias("store_confirmed"),
        F.when(F.col("had_start"), F.col("_c")).otherwise(0).cast("bigint").alias("n_corrections"),
        (F.col("had_start") & F.col("_m")).alias("user_modified"), "value")


def corrections_batch(events: DataFrame, limit: str) -> DataFrame:
    """One row for each correction inside an order that was completed within `limit`, with the completing event."""
    seg = segments(events)
    done = sessions_batch(events, limit).where("had_start").select("session_id", F.col("event_id").alias("order_event_id"))
    ends = seg.where("event_type = 'order_complete'").select("session_id", "_seg", F.col("event_id").alias("order_event_id"))
    return seg.where(F.col("event_type").isin(*CORRECTIONS)).join(ends.join(done, ["session_id", "order_event_id"]), ["session_id", "_seg"]).select(
        "session_id", "order_event_id", "event_id", F.col("ts").alias("at"), "event_type", "value")


def open_outcomes_batch(events: DataFrame, limit: str) -> DataFrame:
    """Outcomes of layers inside an order that was open and not older than `limit`: events without a start do not count."""
    seg = segments(events)
    starts = seg.where(F.col("event_type") == START).select("session_id", "_seg", F.col("ts").alias("_start"))
    inside = seg.where(F.col("event_type").isin(*OUTCOMES)).join(starts, ["session_id", "_seg"])
    return inside.where(F.col("ts") - F.col("_start") <= F.expr(f"INTERVAL {limit}")).drop("_seg", "_n", "_start")


class OrderSessions(StatefulProcessor):
    """State of one session: the open order, or nothing. Orders without an end are dropped after `idle_ms` of event time."""

    def __init__(self, idle_ms: int = 24 * 3600 * 1000):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        open_order = self.order.get() if self.order.exists() else None
        for e in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            kind = e.event_type
            if kind == START:
                open_order = (e.ts, False, 0, False)
            elif kind == "order_cancelled":
                open_order = None
            elif kind == "order_complete":
                _, ok, n, modified = open_order or (None, False, 0, False)
                yield Row(session_id=key[0], completed_at=e.ts.replace(tzinfo=None), event_id=e.event_id, had_start=open_order is not None,
                          store_confirmed=ok, n_corrections=n, user_modified=modified, value=e.value)
                open_order = None
            elif open_order is not None:
                at, ok, n, modified = open_order
                open_order = (at, ok or kind == "store_confirmed", n + (kind in ("sku_corrected", "store_corrected")),
                              modified or kind == "user_modified")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_order is None:
            self.order.clear()
        else:
            self.order.update(tuple(open_order))
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.order.clear()
        return iter(())

    def close(self) -> None:
        pass


def sessions_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The same records from a stream with an event-time column `ts` (timestamp)."""
    return events.withWatermark("ts", watermark).groupBy("session_id").transformWithState(
        statefulProcessor=OrderSessions(), outputStructType=RECORD, outputMode="Append", timeMode="EventTime")


OUTCOMES = ("store_confirmed", "store_corrected", "sku_confirmed", "sku_corrected")
EVENT = "ts timestamp, event_id bigint, event_type string, value double, layer_name string, match_score double"
OUTPUT = f"kind string, {RECORD}, order_event_id bigint, at timestamp_ntz, event_type string, layer_name string, match_score double"


class OrderedSessions(StatefulProcessor):
    """State of one session whose events are taken in order of event time, whatever order they arrive in.

    Events wait in a list until the watermark has passed them. A timer then releases them in order of (ts, event_id), so
    memory is bounded by what one session sends within the watermark's delay. Corrections of the open order are a list
    of their own. An order is given up `limit_ms` after its start. Completion emits a row of kind `record` and, where
    the order was open, one of kind `correction` for each of its corrections. A layer's outcome inside an open order gives
    a row of kind `outcome` at once.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.order = handle.getValueState("order", STATE)
        self.corrections = handle.getListState("corrections", EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(e.ts, e.event_id, e.event_type, e.value, e.layer_name, e.match_score) for e in rows]
        self.waiting.appendList(new)
        self._wake(min(_ms(e[0]) for e in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2])
        ready = [e for e in waiting if _ms(e[0]) <= passed]
        rest = waiting[len(ready):]
        order = tuple(self.order.get()) if self.order.exists() else None
        corrections = [tuple(c) for c in self.corrections.get()] if order else []
        for at, event_id, kind, value, layer, score in ready:
            if order and _ms(at) - _ms(order[0]) > self.limit_ms:
                order = None
            if kind == START:
                order, corrections = (at, False, 0, False), []
            elif kind == "order_cancelled":
                order = None
            elif kind == "order_complete":
                yield from _emitted(key[0], at, event_id, value, order, corrections)
                order = None
            elif order:
                opened, ok, n, modified = order
                if kind in OUTCOMES:
                    yield Row(kind="outcome", session_id=key[0], completed_at=None, event_id=event_id, had_start=True, store_confirmed=None,
                              n_corrections=None, user_modified=None, value=value, order_event_id=None, at=at.replace(tzinfo=None),
                              event_type=kind, layer_name=layer, match_score=score)
                if kind in CORRECTIONS:
                    corrections.append((at, event_id, kind, value, layer, score))
                order = (opened, ok or kind == "store_confirmed", n + (kind in CORRECTIONS), modified or kind == "user_modified")
        if order and _ms(order[0]) + self.limit_ms < passed:
            order = None
        for state, held in ((self.waiting, rest), (self.corrections, corrections if order else [])):
            state.put(held) if held else state.clear()
        self.order.update(order) if order else self.order.clear()
        wake = [_ms(rest[0][0])] if rest else []
        if order:
            wake.append(_ms(order[0]) + self.limit_ms + 1)
        if wake:
            self._wake(min(wake), passed)

    def _wake(self, at: int, passed: int = -1) -> None:
        """Leave one timer, at `at` or where an earlier one is due. The timer that runs now is still listed; it does not count."""
        timers = [t for t in self.handle.listTimers() if t > passed]
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _ms(at) -> int:
    """Milliseconds since 1970, rounded up, so that no event is passed before all of its millisecond is."""
    return -int(-at.timestamp() * 1_000_000 // 1000)


def _emitted(session, at, event_id, value, order, corrections) -> Iterator[Row]:
    """The record of a completed order and its corrections."""
    _, ok, n, modified = order or (None, False, 0, False)
    base = dict(session_id=session, completed_at=at.replace(tzinfo=None))
    yield Row(kind="record", **base, event_id=event_id, had_start=order is not None, store_confirmed=ok, n_corrections=n,
              user_modified=modified, value=value, order_event_id=event_id, at=at.replace(tzinfo=None), event_type="order_complete",
              layer_name=None, match_score=None)
    for when, number, kind, own, layer, score in corrections if order else ():
        yield Row(kind="correction", **base, event_id=number, had_start=True, store_confirmed=ok, n_corrections=n,
                  user_modified=modified, value=own, order_event_id=event_id, at=when.replace(tzinfo=None), event_type=kind,
                  layer_name=layer, match_score=score)


def ordered_sessions_stream(events: DataFrame, watermark: str = "1 hour", limit_hours: float = 24) -> DataFrame:
    """Records and corrections (column `kind`) of a stream with an event-time column `ts`, late and shuffled events put in order."""
    own = {"layer_name": F.lit(None).cast("string"), "match_score": F.lit(None).cast("double")}
    events = events.withColumns({name: column for name, column in own.items() if name not in events.columns})
    return events.withWatermark("ts", watermark).groupBy("session_id").transformWithState(
        statefulProcessor=OrderedSessions(round(limit_hours * 3_600_000)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
