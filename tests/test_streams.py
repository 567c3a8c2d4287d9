"""Stateful monitors: equal to their batch twins on replayed input, each event once, over restarts."""

import datetime as dt
import random

import pytest

from platewise.streaming import monitors, timers

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield timers.with_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def run(spark, plan, schema, folder):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = plan(stream).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out", format="parquet", outputMode="append")
    query.awaitTermination(240)
    return rows_of(spark.read.parquet(f"{folder}/out"))


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_outages_are_raised_cleared_and_expire(stateful, tmp_path):
    rng, rows = random.Random(2), []
    for series, gap, bad in ((1, 20, 0.6), (2, 200, 0.7), (3, 50, 0.2), (4, 400, 1.0)):
        now = 0
        for seq in range(60):
            now += rng.randrange(1, gap * 2)
            rows.append((series, START + dt.timedelta(seconds=now), seq, rng.random() > bad))
    rows.append((9, minutes(100_000), 0, True))  # carries the watermark past the others
    schema = "series long, ts timestamp, seq long, success boolean"
    rows.sort(key=lambda r: r[1])
    # late by less than the watermark allows
    parts = [rows[:90] + rows[95:100], rows[90:95] + rows[100:]]
    want = rows_of(timers.outage_periods(stateful.createDataFrame(rows, schema)))
    assert {w[2] for w in want} == {"raised", "cleared", "expired"}
    found = []
    for part in parts:
        stateful.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = run(stateful, timers.outage_events, schema, tmp_path)  # a restart from the checkpoint each time
    assert found == want
    assert run(stateful, timers.outage_events, schema, tmp_path) == want


def test_an_outage_is_over_after_five_minutes(spark):
    failed = [(1, START + dt.timedelta(seconds=s), s, False) for s in range(20)]
    got = rows_of(timers.outage_periods(spark.createDataFrame(failed, "series long, ts timestamp, seq long, success boolean")))
    assert got == sorted([(1, START + dt.timedelta(seconds=19), "raised"), (1, START + dt.timedelta(seconds=319), "expired")], key=str)


def test_a_stuck_job_fails_once(stateful, tmp_path):
    rows = [
        (1, minutes(0), 1, "processing"), (1, minutes(0), 1, "processing"), (1, minutes(30), 2, "processing"), (1, minutes(40), 3, "complete"),
        (2, minutes(0), 4, "processing"), (2, minutes(11), 5, "complete"), (3, minutes(1), 6, "complete"), (3, minutes(2), 7, "processing"),
        (4, minutes(5), 8, "processing"), (4, minutes(17), 9, "failed"), (5, minutes(3), 10, "queued"), (6, minutes(50), 11, "processing"), (9, minutes(1000), 12, "queued"),
    ]
    schema = "series long, ts timestamp, seq long, status string"
    want = [(1, minutes(12)), (4, minutes(17)), (6, minutes(62))]
    assert rows_of(timers.stuck_jobs(stateful.createDataFrame(rows, schema))) == want
    early = [r for r in rows if r[1] <= minutes(11)]
    for part in (early, [r for r in rows if r not in early]):
        stateful.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stateful, timers.stuck_events, schema, tmp_path)
    assert run(stateful, timers.stuck_events, schema, tmp_path) == want


def test_newest_events_are_kept_as_state(stateful, sf, tmp_path):
    events = stateful.read.parquet(f"{sf}/events.parquet").selectExpr("user_id AS series", "CAST(ts AS TIMESTAMP) AS ts", "event_id")
    for part in (events.where("event_id % 3 > 0"), events.where("event_id % 3 = 0 OR event_id % 7 = 0")):
        part.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        timers.keep_newest(stream, 4, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(240)
    got = timers.kept_newest(stateful, f"{tmp_path}/out")
    want = monitors.newest(events.distinct(), ["series"], 4).select("series", "ts", "event_id", "place")
    assert rows_of(got) == rows_of(want)


def test_tokens_expire_unless_revoked(stateful, tmp_path):
    rows = [(1, minutes(0), 1, "issued"), (2, minutes(0), 2, "issued"), (2, minutes(5), 3, "revoked"), (3, minutes(1), 4, "issued"), (3, minutes(40), 5, "revoked"), (9, minutes(500), 6, "other")]
    schema = "series long, ts timestamp, seq long, status string"
    stateful.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    assert run(stateful, lambda s: timers.expired_tokens(s, 30), schema, tmp_path) == [(1, minutes(30)), (3, minutes(31))]


def test_many_jobs_share_a_shard(stateful, tmp_path, monkeypatch):
    monkeypatch.setattr(timers, "SHARDS", 2)
    schema = "series long, ts timestamp, seq long, status string"
    rows = [(j, START + dt.timedelta(minutes=j % 7 + 6 * k), 3 * j + k, "processing" if (j + k) % 3 else "complete") for j in range(40) for k in range(2)]
    rows += [(None, START, 900, "processing"), (1000, START + dt.timedelta(days=1), 901, "complete")]
    stateful.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    want = rows_of(timers.stuck_jobs(stateful.createDataFrame(rows, schema)))
    assert len(want) > 10 and run(stateful, timers.stuck_events, schema, tmp_path) == want
    assert "shard" in timers.stuck_events(stateful.readStream.schema(schema).parquet(str(tmp_path / "in")))._jdf.queryExecution().toString()
