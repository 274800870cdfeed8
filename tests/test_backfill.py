"""Backfills that are stopped anywhere give the table of one run; paged replies are followed to their end."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from quillon.sources import paged
from quillon.streaming import backfill

SCHEMA = "k int, date date, at int, v double"


def history(path):
    return backfill.History(f"file://{path}", SCHEMA, ("k", "date"), ("at",))


def delivered(seed=1, files=6):
    rng = random.Random(seed)
    return [[(rng.randint(0, 9), dt.date(2024, 1, rng.randint(1, 5)), rng.randint(0, 99), rng.random()) for _ in range(40)] for _ in range(files)]


def last_of(rows):
    out = {}
    for k, date, at, v in rows:
        if (k, date) not in out or at >= out[k, date][0]:
            out[k, date] = (at, v)
    return {(*k, *v) for k, v in out.items()}


def write(spark, folder, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def rows_of(spark, h):
    return {tuple(r) for r in h.read(spark).collect()}


@pytest.mark.parametrize("where", ["before", "written", "committed"])
def test_stopped_and_started_again(spark, tmp_path, monkeypatch, where):
    """Stopped at batch 2 before anything is written, after its data, and after its commit but before the stream's own."""
    # Equal times would be settled by the order of batches, which is that of the files.
    batches = [[(k, d, 6 * at + n, v) for k, d, at, v in b] for n, b in enumerate(delivered())]
    for b in batches:
        write(spark, tmp_path / "in", b)
    h = history(tmp_path / "out")
    commit, publish = backfill.History.commit, backfill.History._publish

    def broken_commit(self, fresh, batch):
        if batch == 2 and where == "before":
            raise RuntimeError("stopped")
        done = commit(self, fresh, batch)
        if batch == 2 and where == "committed":
            raise RuntimeError("stopped")
        return done

    def broken_publish(self, session, batch, days):
        if batch == 2 and where == "written":
            raise RuntimeError("stopped")
        publish(self, session, batch, days)

    monkeypatch.setattr(backfill.History, "commit", broken_commit)
    monkeypatch.setattr(backfill.History, "_publish", broken_publish)
    with pytest.raises(Exception, match="stopped"):
        backfill.backfill(stream(spark, tmp_path / "in"), h, f"file://{tmp_path}/checkpoint")
    assert sorted(h.commits(spark)) == ([0, 1, 2] if where == "committed" else [0, 1])
    seen = rows_of(spark, h)
    monkeypatch.undo()
    assert rows_of(spark, h) == seen  # nothing of an open batch is read
    backfill.backfill(stream(spark, tmp_path / "in"), h, f"file://{tmp_path}/checkpoint")
    assert sorted(h.commits(spark)) == list(range(6))
    once = history(tmp_path / "once")
    assert backfill.backfill(stream(spark, tmp_path / "in"), once, f"file://{tmp_path}/checkpoint2") == 6
    assert rows_of(spark, h) == rows_of(spark, once) == last_of(r for b in batches for r in b)
    assert h.vacuum(spark) > 0 and rows_of(spark, h) == rows_of(spark, once)


def test_batches_touch_their_dates_only(spark, tmp_path):
    h = history(tmp_path)
    day = lambda n: dt.date(2024, 1, n)
    assert rows_of(spark, h) == set()
    assert h.commit(spark.createDataFrame([(1, day(1), 1, 1.0), (1, day(2), 1, 2.0), (2, None, 1, 9.0)], SCHEMA), 0)
    assert h.commit(spark.createDataFrame([(1, day(2), 0, 5.0), (3, day(2), 1, 6.0)], SCHEMA), 1)
    assert h.newest_versions(spark) == {"date=2024-01-01": 0, "date=2024-01-02": 1}
    assert rows_of(spark, h) == {(1, day(1), 1, 1.0), (1, day(2), 1, 2.0), (3, day(2), 1, 6.0)}
    assert not h.commit(spark.createDataFrame([(1, day(1), 9, 9.0)], SCHEMA), 1)  # delivered again
    assert h.commit(spark.createDataFrame([], SCHEMA), 2)
    assert rows_of(spark, h) == {(1, day(1), 1, 1.0), (1, day(2), 1, 2.0), (3, day(2), 1, 6.0)}


def page(path, name, results, following=None, **more):
    path.joinpath(name).write_text(json.dumps({"results": results, **({"next_url": f"https://host/x/{following}"} if following else {}), **more}))


def test_pages_are_followed_and_only_asked_files_opened(spark, tmp_path):
    page(tmp_path, "A.json", [1, 2], "A@1.json", status="OK")
    page(tmp_path, "A@1.json", [3], "A@2.json")
    page(tmp_path, "A@2.json", [{"x": 4}])
    page(tmp_path, "B.json", [])
    page(tmp_path, "C.json", [7], "C.json")  # leads back to itself
    tmp_path.joinpath("D.json").write_text(json.dumps([{"status": 429}, {"status": "THROTTLED"}, {"status": "OK", "results": [8]}]))
    tmp_path.joinpath("E.json").write_text(json.dumps({"status": 429}))
    tmp_path.joinpath("F.json").write_text("{broken")
    page(tmp_path, "G.json", [5], "G@1.json")  # the next page is missing
    page(tmp_path, "H.json", {"name": "one"})
    page(tmp_path, "I.json", None, status="NOT_FOUND")
    paged.register(spark)

    def read(**more):
        return spark.read.format("paged_replies").options(path=str(tmp_path), wait="0", **more).load()

    got = {(r.ticker, r.page, r.result, r.fetch_status, r.retries) for r in read().collect()}
    assert got == {
        ("A", 0, "1", "ok", 0), ("A", 0, "2", "ok", 0), ("A", 1, "3", "ok", 0), ("A", 2, '{"x":4}', "ok", 0), ("B", 0, None, "empty_result", 0), ("C", 0, "7", "ok", 0), ("C", 0, None, "malformed", 0), ("D", 0, "8", "ok", 2),
        ("E", 0, None, "throttled", 2), ("F", 0, None, "malformed", 0), ("G", 0, "5", "ok", 0), ("G", 1, None, "not_found", 0), ("H", 0, '{"name":"one"}', "ok", 0), ("I", 0, None, "not_found", 0),
    }
    asked = read(tickers="A, none")
    assert asked.rdd.getNumPartitions() == 2
    assert {(r.ticker, r.fetch_status) for r in asked.collect()} == {("A", "ok"), ("none", "not_found")}
    tmp_path.joinpath("F.json").unlink()
    tmp_path.joinpath("F.json").mkdir()  # opening it would fail the task
    for some, names in ((read().where("ticker = 'A'"), {"A"}), (read().where("ticker in ('D', 'E') and page = 0"), {"D", "E"}), (asked.where("ticker in ('B', 'A')"), {"A"})):
        assert some.rdd.getNumPartitions() == len(names) and {r.ticker for r in some.collect()} == names
    assert {r.item for r in read(most=3).where("ticker = 'A'").collect()} == {0, 1, 2}


def test_many_instruments_share_tasks():
    """Tasks grow with a share of the instruments; each is in one of them, in order."""
    for n, most in ((1, 1), (64, 64), (1000, 64), (60_000, 60_000 // 256 + 1)):
        names = [f"{k:05d}" for k in range(n)]
        parts = paged.PagedReader({"path": "/none", "tickers": ",".join(names)}).partitions()
        assert [t for p in parts for t in p.tickers] == names and len(parts) <= most
