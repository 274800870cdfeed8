"""Sources and sinks over small files."""

from __future__ import annotations

import datetime as dt
import json

from quillon.operators import text
from quillon.sources import files, sinks


def test_raw_prices_take_the_ticker_from_the_file(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    import pandas as pd

    pd.DataFrame({"Date": [dt.date(2024, 1, 2)], "Close": [5.0], "Volume": [7.0]}).to_parquet(folder / "abc.parquet")
    pd.DataFrame({"Date": [dt.date(2024, 1, 3)], "Close": [6.0], "Volume": [8.0]}).to_parquet(folder / "xyz.parquet")
    rows = files.raw_prices(spark, str(folder)).orderBy("ticker").collect()
    assert [(r.ticker, r.close, r.open) for r in rows] == [("ABC", 5.0, None), ("XYZ", 6.0, None)]
    (folder / "bad.parquet").write_bytes(b"no parquet")
    assert [p for p, _ in files.unreadable(spark, [str(folder / "abc.parquet"), str(folder / "bad.parquet")])] == [str(folder / "bad.parquet")]


def test_json_bars_and_chain(spark, tmp_path):
    (tmp_path / "bars.json").write_text(json.dumps({"ticker": "A", "results": [{"t": 1704153600000, "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10.0, "vw": 1.2, "n": 3.0}]}) + "\n" + json.dumps({"ticker": "B", "status": "NOT_FOUND"}) + "\n")
    r = files.bars_from_json(spark, str(tmp_path / "bars.json")).collect()
    assert [(x.ticker, x.date, x.close) for x in r] == [("A", dt.date(2024, 1, 2), 1.5)]
    (tmp_path / "chain.json").write_text(json.dumps({"ticker": "A", "results": [{"details": {"ticker": f"O{k}", "strike_price": 10.0 + k, "contract_type": "CALL", "expiration_date": "2024-02-01"}, "greeks": {"delta": 0.5}, "day": {"volume": 1.0}, "open_interest": 2.0} for k in range(3)]}) + "\n")
    assert files.chain_from_json(spark, str(tmp_path / "chain.json"), most=2).count() == 2


def test_overview_and_news(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"ticker":"A","results":{"type":"cs","market_cap":1.0}}\n{"ticker":"B","status":"NOT_FOUND"}\n')
    assert sorted((r.ticker, r.is_common_stock, r.reference_status) for r in files.overview_from_json(spark, str(tmp_path / "o.json")).collect()) == [("A", True, "ok"), ("B", False, "not_found")]
    (tmp_path / "n.json").write_text('{"ticker":"A","results":[{"headline":"h","date":"d"},{"title":"t","published_utc":"p"}]}\n')
    assert [(r.title, r.published) for r in files.news_from_json(spark, str(tmp_path / "n.json")).collect()] == [("h", "d"), ("t", "p")]


def test_upsert_replaces_keys_and_keeps_the_rest(spark, tmp_path):
    path = f"file://{tmp_path}/history"
    make = lambda rows: spark.createDataFrame(rows, "ticker string, date date, x double")
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    sinks.upsert(spark, make([("A", one, 1.0), ("B", one, 2.0), ("A", two, 3.0)]), path, ("ticker", "date"))
    sinks.upsert(spark, make([("A", two, 4.0), ("C", two, 5.0)]), path, ("ticker", "date"))
    assert sorted((r.ticker, r.date, r.x) for r in spark.read.parquet(path).collect()) == [("A", one, 1.0), ("A", two, 4.0), ("B", one, 2.0), ("C", two, 5.0)]
    assert files.first_readable(spark, [f"file://{tmp_path}/none", path]).count() == 4
    assert sinks.status(spark.read.parquet(path).selectExpr("count(*) AS n"), f"file://{tmp_path}/status", run="x") == {"n": 4, "run": "x"}
    sinks.csv(spark.read.parquet(path), f"file://{tmp_path}/csv")
    assert files.csv_series(spark, f"file://{tmp_path}/csv", "ticker string, x double, date date").count() == 4


def test_reply_parsing(spark):
    good = '[{"ticker":"A","sentiment":0.5}]'
    df = spark.createDataFrame([(f"```json\n{good}\n```",), (good[1:-1],), (f"Sure: {good} done",), ("nothing",), (None,)], "r string")
    got = [r.x for r in df.select(text.parse_reply(df.r).alias("x")).collect()]
    assert [None if g is None else [(y.ticker, y.sentiment) for y in g] for g in got] == [[("A", 0.5)]] * 3 + [None, None]


def test_chunks_cut_between_words(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd"), (2, None), (3, "x" * 30)], "k int, text string")
    got = sorted(map(tuple, text.chunks(df, "k", size=5, most=2).collect()))
    assert got == [(1, 0, "aa bb"), (1, 1, "cc dd"), (3, 0, "x" * 30)]
