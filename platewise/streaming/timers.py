"""Monitors with keyed state and event-time timers: outages that expire, jobs that are stuck.

Rows wait in list state until the watermark has passed them, so each key is stepped through in order of time however its rows
arrive, and an event is sent once: what was sent is part of the state, and a restart goes on from the checkpoint. State is kept
in RocksDB, outside the heap; ``with_rocksdb`` sets that for a session. Each monitor has a batch twin that gives the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

#: An outage: of the last LAST outcomes at least FAILURES failed; it is over EXPIRY seconds after the last outcome that said so.
LAST, FAILURES, EXPIRY = 20, 11, 300
#: Minutes after which a job that is still processing has failed.
STUCK = 12
#: Shards of the jobs that are watched.
SHARDS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _millis(values: pd.Series) -> list[int]:
    return [int(x.value // 1_000_000) for x in pd.to_datetime(values)]


class Ordered(StatefulProcessor):
    """Rows of a key in order of (ms, seq), each once the watermark has passed it.

    ``fields`` are further columns of a row. A subclass steps through rows and the deadlines that it sets, both in order of time;
    a row at the time of a deadline comes after it. Its state is loaded and saved once for all rows of a key that are due.
    """

    fields: tuple[str, ...] = ()
    types = ""
    out: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ms long, seq long{', ' * bool(self.types)}{self.types}")
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self) -> None:
        raise NotImplementedError

    def save(self) -> None:
        raise NotImplementedError

    def step(self, ms: int, seq: int, *values: Any) -> list[tuple]:
        """Events of the next row."""
        raise NotImplementedError

    def deadline(self) -> int | None:
        """When something is due if no row changes it."""
        raise NotImplementedError

    def due(self, ms: int) -> list[tuple]:
        """Events of a deadline."""
        raise NotImplementedError

    def _next_timer(self, waiting: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        times = [r[0] for r in waiting] + [x for x in [self.deadline()] if x is not None]
        if times:
            self.handle.registerTimer(min(times))

    def _frame(self, key: tuple, events: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame([(key[0], *e) for e in events], columns=["series", *self.out])
        frame["happened"] = pd.to_datetime(frame["happened"], unit="ms")
        yield frame

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = list(zip(_millis(batch["ts"]), (int(x) for x in batch["seq"]), *(batch[f].tolist() for f in self.fields), strict=True))
            self.waiting.appendList(new)
        self.load()
        self._next_timer([tuple(r) for r in self.waiting.get()])
        yield from self._frame(key, [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, events = timerValues.getCurrentWatermarkInMs(), []
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in waiting if r[0] <= now]
        self.load()
        for row in [*ready, None]:
            until = now if row is None else row[0]
            while (at := self.deadline()) is not None and at <= until:
                events += self.due(at)
            if row is not None:
                events += self.step(*row)
        self.save()
        rest = waiting[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self._next_timer(rest)
        yield from self._frame(key, events)

    def close(self) -> None:
        pass


class OutageProcessor(Ordered):
    """(series, happened, event): the flag is raised, cleared by an outcome, or expired."""

    fields, types, out = ("success",), "success boolean", ("happened", "event")

    def __init__(self, last: int, failures: int, expiry: int):
        self.last, self.failures, self.expiry = last, failures, expiry * 1000

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.outcomes = handle.getListState("outcomes", "success boolean")
        self.flag = handle.getValueState("flag", "until long")

    def load(self) -> None:
        self.recent = [r[0] for r in self.outcomes.get()]
        self.until = self.flag.get()[0] if self.flag.exists() else None

    def save(self) -> None:
        if self.recent:
            self.outcomes.put([(x,) for x in self.recent])
        self.flag.update((self.until,))

    def step(self, ms: int, seq: int, success: bool) -> list[tuple]:
        self.recent = [*self.recent, bool(success)][-self.last :]
        was_up, up = self.until is not None, len(self.recent) == self.last and self.recent.count(False) >= self.failures
        self.until = ms + self.expiry if up else None
        return [(ms, "raised" if up else "cleared")] if up != was_up else []

    def deadline(self) -> int | None:
        return self.until

    def due(self, ms: int) -> list[tuple]:
        self.until = None
        return [(ms, "expired")]


class StuckProcessor(StatefulProcessor):
    """(series, happened): a job was processing for so long without an end; sent once a job.

    A key is a shard of jobs, as a call for each job would cost more than its few rows. Rows wait as in ``Ordered``; what is known
    of each job of a shard is a row of its list, which is loaded and saved once for all rows that are due.
    """

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "series long, ms long, seq long, status string")
        # settled: the job has ended, or was reported
        self.jobs = handle.getListState("jobs", "series long, due long, settled boolean")

    def _timers(self) -> list[int]:
        return [t if isinstance(t, int) else t[0] for t in self.handle.listTimers()]

    def _frame(self, events: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(events, columns=["series", "happened"]).astype({"series": "Int64"})
        frame["happened"] = pd.to_datetime(frame["happened"], unit="ms")
        return frame

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            ms = _millis(batch["ts"])
            if ms:
                self.waiting.appendList(list(zip((None if pd.isna(x) else int(x) for x in batch["series"]), ms, (int(x) for x in batch["seq"]), batch["status"].tolist(), strict=True)))
                first = min(ms) if first is None else min(first, *ms)
        timers = self._timers()
        if first is not None and (not timers or first < min(timers)):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        yield self._frame([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, events = timerValues.getCurrentWatermarkInMs(), []
        ready, rest = [], []
        for r in self.waiting.get():
            (ready if r[1] <= now else rest).append(tuple(r))
        known = {r[0]: (r[1], r[2]) for r in self.jobs.get()}
        for series, ms, _, status in sorted(ready, key=lambda r: r[1:3]):
            due, settled = known.get(series, (None, False))
            if due is not None and due <= ms:
                events.append((series, due))
                due, settled = None, True
            if status != "processing":
                due, settled = None, True
            elif due is None and not settled:
                due = ms + self.wait
            known[series] = (due, settled)
        for series, (due, _) in known.items():
            if due is not None and due <= now:
                events.append((series, due))
                known[series] = (None, True)
        if known:
            self.jobs.put([(s, *v) for s, v in known.items()])
        self.waiting.put(rest) if rest else self.waiting.clear()
        for timer in self._timers():
            self.handle.deleteTimer(timer)
        times = [r[1] for r in rest] + [due for due, _ in known.values() if due is not None]
        if times:
            self.handle.registerTimer(min(times))
        yield self._frame(events)

    def close(self) -> None:
        pass


def outage_events(outcomes: DataFrame, last: int = LAST, failures: int = FAILURES, expiry: int = EXPIRY, late: str = "10 minutes") -> DataFrame:
    """Stream of (series, happened, event) of outcomes (series, ts, seq, success), up to the watermark; rows later than ``late`` are dropped."""
    rows = outcomes.select("series", F.col("ts").cast("timestamp").alias("ts"), "seq", "success").withWatermark("ts", late)
    return rows.groupBy("series").transformWithStateInPandas(OutageProcessor(last, failures, expiry), "series long, happened timestamp, event string", "Append", "EventTime")


def outage_periods(outcomes: DataFrame, last: int = LAST, failures: int = FAILURES, expiry: int = EXPIRY) -> DataFrame:
    """Batch twin of ``outage_events``: the same rows, of outcomes to milliseconds."""
    order = W.partitionBy("series").orderBy("ts", "seq")
    frame = order.rowsBetween(-(last - 1), 0)
    bad = (F.count("*").over(frame) == last) & (F.sum((~F.col("success")).cast("int")).over(frame) >= failures)
    rows = outcomes.select("series", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), "seq", "success").withColumn("bad", bad)
    ends = F.col("ts") + F.make_dt_interval(secs=F.lit(float(expiry)))
    rows = rows.withColumns({"before": F.lag("bad").over(order), "until": F.lag(ends).over(order), "next": F.lead("ts").over(order), "ends": ends})
    was_up = F.coalesce(F.col("before") & (F.col("ts") < F.col("until")), F.lit(False))
    event = lambda at, name, test: F.when(test, F.struct(at.alias("happened"), F.lit(name).alias("event")))
    found = F.array(event(F.col("ts"), "raised", F.col("bad") & ~was_up), event(F.col("ts"), "cleared", ~F.col("bad") & was_up), event(F.col("ends"), "expired", F.col("bad") & (F.col("next").isNull() | (F.col("next") >= F.col("ends")))))
    return rows.select("series", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select("series", "e.*")


def stuck_events(statuses: DataFrame, minutes: int = STUCK, late: str = "10 minutes") -> DataFrame:
    """Stream of (series, happened): jobs ``series`` whose statuses (series, ts, seq, status) leave them processing for ``minutes``.

    The clock starts at a job's first ``processing``; any other status ends the job for good. A redelivered status changes nothing.
    Jobs are kept in ``SHARDS`` shards, each of which a task holds while it works on it; raise it with the number of jobs.
    """
    # rows without a job are a shard of their own, so that no batch mixes them with numbers
    shard = F.when(F.col("series").isNull(), -1).otherwise(F.pmod(F.xxhash64("series"), F.lit(SHARDS))).alias("shard")
    rows = statuses.select(shard, "series", F.col("ts").cast("timestamp").alias("ts"), "seq", "status").withWatermark("ts", late)
    return rows.groupBy("shard").transformWithStateInPandas(StuckProcessor(minutes), "series long, happened timestamp", "Append", "EventTime")


def stuck_jobs(statuses: DataFrame, minutes: int = STUCK) -> DataFrame:
    """Batch twin of ``stuck_events``: the same rows, as if the clock had run on."""
    ts = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    going: Column = F.col("status") == "processing"
    first = F.min_by(F.when(going, F.struct(ts.alias("ts"), "seq")), F.when(going, F.struct(ts.alias("ts"), "seq")))
    per = statuses.groupBy("series").agg(F.min(F.when(going, ts)).alias("start"), F.min(F.when(~going, ts)).alias("ended"), first.alias("first"), F.min(F.when(~going, F.struct(ts.alias("ts"), "seq"))).alias("end"))
    at = F.col("start") + F.make_dt_interval(mins=F.lit(minutes))
    return per.where(F.col("start").isNotNull() & (F.col("end").isNull() | ((F.col("end") > F.col("first")) & (F.col("ended") >= at)))).select("series", at.alias("happened"))


def expired_tokens(tokens: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Stream of (series, happened): tokens ``series`` (series, ts, seq, status) that are ``issued`` and expire; a revoked one does not.

    It is the stuck-job timer with other words: the clock starts at the first issue, and any other status ends it.
    """
    return stuck_events(tokens.withColumn("status", F.when(F.col("status") == "issued", "processing").otherwise(F.col("status"))), minutes, late)


class NewestProcessor(StatefulProcessor):
    """The newest ``n`` rows (ts, event_id) of a key, sent anew whenever they change."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ns long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = [tuple(r) for r in self.kept.get()]
        known = set(before)
        for batch in rows:
            known.update(zip((int(x.value) for x in pd.to_datetime(batch["ts"])), (int(x) for x in batch["event_id"]), strict=True))
            known = set(sorted(known, reverse=True)[: self.n])
        now = sorted(known, reverse=True)
        self.kept.put(now)
        sent = now if now != before else []
        frame = pd.DataFrame([(key[0], t, e, place) for place, (t, e) in enumerate(sent, 1)], columns=["series", "ts", "event_id", "place"])
        frame["ts"] = pd.to_datetime(frame["ts"])
        yield frame

    def close(self) -> None:
        pass


def keep_newest(events: DataFrame, n: int, path: str, checkpoint: str):
    """Keep the newest ``n`` events (series, ts, event_id) of each series: only series that change are written, a folder for each batch.

    A batch that is run again writes its own folder again, so nothing is counted twice; see ``kept_newest`` for what holds now.
    """
    rows = events.select("series", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    changed = rows.groupBy("series").transformWithStateInPandas(NewestProcessor(n), "series long, ts timestamp, event_id long, place int", "Update", "None")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_newest(spark: SparkSession, path: str) -> DataFrame:
    """(series, ts, event_id, place) that hold now: of each series the rows of its last batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("series").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["series", "batch"]).select("series", "ts", "event_id", "place")
