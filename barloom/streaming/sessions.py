"""Keyed state on a stream: session VWAP with re-sent bars and bars from the future, alert cooldowns."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import AlertCooldowns
from ..operators.calendar import at_local, local_day
from ..plans.alerts import KEY, cooldown_minutes

#: State of keyed processors lives in RocksDB: it is larger than memory allows and is written as changes.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

OUT = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("session_date", T.DateType()), T.StructField("kind", T.StringType()),
    T.StructField("bar_time", T.TimestampType()), T.StructField("bars", T.LongType()), T.StructField("vwap", T.DoubleType()),
])
BAR = T.StructType([T.StructField("arrival", T.LongType()), T.StructField("pv", T.DoubleType()), T.StructField("v", T.DoubleType())])
AT = T.StructType([T.StructField("ts", T.TimestampType())])


class SessionVwap(StatefulProcessor):
    """One session's bars by their times, the last version of each; closed and forgotten when the watermark passes its end.

    A session holds at most the bars of its grid. A bar that was received before its own time is reported and not kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", AT, BAR)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ends = None
        for r in rows:
            if r.ts > r.received_at:
                yield Row(ticker=key[0], session_date=key[1], kind="future_bar", bar_time=r.ts, bars=None, vwap=None)
                continue
            ends = r.session_end
            at = (r.ts,)
            held = self.bars.getValue(at) if self.bars.containsKey(at) else None
            if held is None or held[0] <= r.arrival:
                self.bars.updateValue(at, (r.arrival, (r.high + r.low + r.close) / 3.0 * r.volume, r.volume))
        if ends is not None:
            due = int(ends.timestamp() * 1000)
            if due not in list(self.handle.listTimers()):
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = list(self.bars.iterator())
        volume = sum(v[2] for _, v in held)
        if held:
            vwap = sum(v[1] for _, v in held) / volume if volume > 0 else None
            yield Row(ticker=key[0], session_date=key[1], kind="session", bar_time=max(k[0] for k, _ in held), bars=len(held), vwap=vwap)
        self.bars.clear()

    def close(self) -> None:
        pass


def session_vwaps(bars: DataFrame, delay: str = "3 hours", end_minute: int = 24 * 60) -> DataFrame:
    """Final VWAP of every session of a stream of bars, and an error row for each bar from the future.

    ``bars`` has ticker, ts, open to volume, ``arrival`` (later versions of a bar have higher ones; the last counts) and ``received_at``.
    Time goes on with what has been received, so a bar from the future does not close sessions. A session is given out once, when the
    watermark passes ``end_minute`` of its local day; state is gone then.
    """
    day = local_day("ts")
    timed = bars.withColumns({
        "event_time": F.least("ts", "received_at"), "session_date": day, "session_end": at_local(day, F.lit(end_minute)),
    }).withWatermark("event_time", delay)
    return timed.groupBy("ticker", "session_date").transformWithState(SessionVwap(), OUT, "Append", "EventTime")


WAITING = T.StructType([
    T.StructField("at", T.LongType()), T.StructField("tie", T.StringType()), T.StructField("delivered", T.BooleanType()), T.StructField("minutes", T.LongType()),
])
DECIDED = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("alert_type", T.StringType()), T.StructField("timeframe", T.StringType()),
    T.StructField("observed_at", T.TimestampType()), T.StructField("tie", T.StringType()), T.StructField("decision", T.StringType()),
])
#: What the processor gives out: the instant as microseconds.
DECIDED_AT = T.StructType([T.StructField("at", T.LongType()) if f.name == "observed_at" else f for f in DECIDED.fields])


def cooldowns(at: np.ndarray, delivered: np.ndarray, minutes: np.ndarray, until: int) -> tuple[np.ndarray, int]:
    """Decisions of alerts in time order (microseconds) after a cooldown that ends at ``until``, and the end of the last cooldown.

    One step an alert that is sent: those up to the end of its cooldown are suppressed.
    """
    out = np.full(len(at), "failed", object)
    able = np.flatnonzero(delivered)
    i = 0
    while True:
        free = max(i, int(np.searchsorted(at, until)))
        out[i:free] = "suppressed"
        k = int(np.searchsorted(able, free))
        if k == len(able):
            return out, until
        i = int(able[k])
        out[i] = "sent"
        until = int(at[i]) + int(minutes[i]) * 60_000_000
        i += 1


class Cooldown(StatefulProcessor):
    """Alerts of one key, decided in time order as soon as none before them can come; forgotten when the cooldown is over.

    An alert is decided with its batch if it is older than the key's newest one by more than the delay: no later batch brings one before it.
    The others wait for the watermark, at most what arrives within the delay.
    """

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.until = handle.getValueState("until", T.StructType([T.StructField("until", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[WAITING.names] for r in rows], ignore_index=True)
        if len(new):
            held = pd.concat([self._held(), new], ignore_index=True) if self.waiting.exists() else new
            yield from self._decide(key, held, int(held["at"].max()) // 1000 * 1000 - self.delay)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._decide(key, self._held(), timerValues.getCurrentWatermarkInMs() * 1000)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=WAITING.names)

    def _decide(self, key: tuple, held: pd.DataFrame, passed: int) -> Iterator[pd.DataFrame]:
        """Decides what is held from before ``passed`` and keeps the rest."""
        before = int(self.until.get()[0]) if self.until.exists() else 0
        until, rest = before, held[held["at"] >= passed]
        due = held[held["at"] < passed].sort_values(["at", "tie"], kind="stable")
        if len(due):
            decisions, until = cooldowns(due["at"].to_numpy(np.int64), due["delivered"].to_numpy(bool), due["minutes"].to_numpy(np.int64), before)
            yield pd.DataFrame({"ticker": key[0], "alert_type": key[1], "timeframe": key[2], "at": due["at"].astype("int64"), "tie": due["tie"], "decision": decisions})
        if len(rest):
            self.waiting.put([(int(a), t, bool(d), int(m)) for a, t, d, m in rest.itertuples(index=False)])
            self.handle.registerTimer(int(rest["at"].min()) // 1000 + 1)
        elif self.waiting.exists():
            self.waiting.clear()
        if until > passed:
            if until != before:
                self.until.update((until,))
            self.handle.registerTimer(until // 1000 + 1)
        elif not len(rest):
            self.until.clear()
        elif until != before:
            self.until.update((until,))

    def close(self) -> None:
        pass


def cooldown_decisions(alerts: DataFrame, config: AlertCooldowns, tie: str, delay: str = "1 hour") -> DataFrame:
    """sent, failed or suppressed for every alert of a stream (key, observed_at, delivered), as ``plans.alerts.decide`` decides a table.

    Alerts of one key are taken in the order of their times and, at one microsecond, of the text column ``tie``, in whatever order they arrive
    within ``delay``.
    """
    micros = alerts.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {delay})").first()[0]
    keyed = alerts.withColumns({"minutes": cooldown_minutes(config).cast("bigint"), "at": F.unix_micros("observed_at")})
    keyed = keyed.select(*KEY, "observed_at", "at", F.col(tie).cast("string").alias("tie"), "delivered", "minutes")
    decided = keyed.withWatermark("observed_at", delay).groupBy(*KEY).transformWithStateInPandas(Cooldown(micros), DECIDED_AT, "Append", "EventTime")
    return decided.withColumn("observed_at", F.timestamp_micros("at")).select(*DECIDED.names)
