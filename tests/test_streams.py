"""Stateful streams over several batches against plain loops over all events."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quillon.streaming import ticks

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events():
    """Five batches in order of time, users with long pauses; one user leaves after the first batch."""
    rng, out, at = random.Random(6), [], START
    for k in range(400):
        at += dt.timedelta(minutes=rng.choice([1, 5, 30, 60]))
        out.append((k, at, rng.randint(1, 5) if k >= 80 else rng.randint(1, 6), "view", float(rng.randint(0, 6)), None))
    return [out[n : n + 80] for n in range(0, 400, 80)]


@pytest.fixture
def stream(spark, events, tmp_path):
    for batch in events:
        spark.createDataFrame(random.Random(1).sample(batch, len(batch)), ticks.EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return ticks.event_stream(spark, f"file://{tmp_path}/in")


def streaks_of(rows, idle):
    last, out = {}, {}
    for i, ts, user, _, v, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        value, at, up, down = last.get(user, (None, None, 0, 0))
        if value is None or ts - at > idle:
            up = down = 0
        else:
            up, down = (up + 1 if v > value else 0), (down + 1 if v < value else 0)
        last[user] = (v, ts, up, down)
        out[i] = (user, up, down)
    return out


@pytest.mark.parametrize("hours", [1, 12])
def test_streaks_over_batches(spark, events, stream, tmp_path, hours):
    """The files' rows come in any order, batch after batch; pauses end a streak, and the state of who is idle goes."""
    out = ticks.streaks(stream, f"{hours} hours", "10 minutes")
    query = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    got = {r.event_id: (r.user_id, r.up, r.down) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == streaks_of([r for b in events for r in b], dt.timedelta(hours=hours))
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 5


def test_sessions_and_collection(spark, events, stream, tmp_path):
    """Sessions that the watermark has passed; a second run finds nothing new."""
    paths = f"file://{tmp_path}/c", f"file://{tmp_path}/rows"
    for _ in range(2):
        ticks.collect_once(ticks.sessions(stream, "20 minutes", "30 minutes"), *paths)
    rows = [r for b in events for r in b]
    limit, expected = max(r[1] for r in rows) - dt.timedelta(minutes=30), set()
    for user in {r[2] for r in rows}:
        own = sorted(r[1] for r in rows if r[2] == user)
        first = last = own[0]
        n = 1
        for ts in [*own[1:], None]:
            if ts is not None and ts < last + dt.timedelta(minutes=20):
                last, n = ts, n + 1
                continue
            if last + dt.timedelta(minutes=20) <= limit:
                expected.add((user, first, last + dt.timedelta(minutes=20), n))
            first = last = ts
            n = 1
    assert {(r.user_id, r.start, r.stop, r.n) for r in spark.read.parquet(paths[1]).collect()} == expected
