"""The panel assembler and the job parameters."""

from __future__ import annotations

from quillon import config
from quillon.operators import models
from quillon.operators.assemble import assemble, with_sector


def test_overlays_join_without_losing_or_doubling_columns(spark):
    base = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "ticker string, date int, x double")
    over = spark.createDataFrame([("A", 1, 9.0, 5.0)], "ticker string, date int, x double, y double")
    out = assemble(base, {"ctx": over})
    assert out.columns == ["ticker", "date", "x", "ctx_x", "y"]
    assert sorted(map(tuple, out.collect()), key=str) == [("A", 1, 1.0, 9.0, 5.0), ("B", 1, 2.0, None, None)]


def test_sector_comes_from_the_base_first(spark):
    base = spark.createDataFrame([("A", "own"), ("B", None)], "ticker string, sector string")
    master = spark.createDataFrame([("A", "m", "i"), ("B", "m", "i")], "ticker string, sector string, industry string")
    assert sorted((r.ticker, r.sector, r.industry) for r in with_sector(base, master).collect()) == [("A", "own", "i"), ("B", "m", "i")]


def test_environment_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nA='1'\nB=2\nbad\n")
    monkeypatch.setenv("B", "3")
    assert config.environment_file(str(tmp_path / ".env")) == {"A": "1", "B": "3"}
    assert config.environment_file(str(tmp_path / "none")) == {}


def test_pattern_features():
    assert models.pattern_features(["a_zscore", "fwd_b_zscore", "c_pctrank", "d"]) == ["a_zscore", "c_pctrank"]
