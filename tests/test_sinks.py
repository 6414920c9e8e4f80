"""Watch-lists as files."""

from pathlib import Path

from pyspark.sql import functions as F

from tickloom.plans import source_queries as Q
from tickloom.sources import sinks as W


def test_long_list_is_written_by_ranges(spark, tmp_path, monkeypatch):
    """The query's list goes to several files, whose names are in the order of the lines."""
    buckets = spark.range(500).select(
        F.concat(F.lit("S"), F.col("id")).alias("symbol"), F.col("id").cast("double").alias("ltp"), (F.floor(F.col("id") / 100) * 100 + 100).alias("below")
    )
    path, name = str(tmp_path / "list"), "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(Q.A, "base_bars", lambda *_: None)
    monkeypatch.setattr(Q.G, "surge_scan", lambda *_: None)
    monkeypatch.setattr(Q.G, "price_buckets", lambda *_: buckets)
    monkeypatch.setattr(Q, "scratch_path", lambda *_: path)
    spark.conf.set(name, "false")
    try:
        lines = Q.bucketed_watch_list(spark, None)
        assert lines.count() == 506
    finally:
        spark.conf.unset(name)
    files = sorted(Path(path).glob("part-*.txt"))
    got = [line for f in files for line in f.read_text().splitlines()]
    assert len([f for f in files if f.stat().st_size]) > 1
    assert got == [r["line"] for r in W.bucketed_lines(buckets, "Timeframe: 3").collect()]


def test_bars_of_a_day_go_to_several_tasks(spark, tmp_path, monkeypatch):
    """A file has the bars of a bounded number of symbols; a day that is written again is replaced as a whole."""
    monkeypatch.setattr(W, "SYMBOLS_A_FILE", 10, raising=False)
    path = str(tmp_path / "bars")
    bars = spark.range(80).selectExpr("concat('S', id % 40) AS symbol", "DATE'2024-01-01' + CAST(id DIV 40 AS INT) AS day", "CAST(id AS INT) AS bar", "1 AS last_bar")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        W.write_bars(bars, path, "3")
        W.write_bars(bars.filter("day = DATE'2024-01-02'"), path, "3")
    finally:
        spark.conf.unset(name)
    assert sorted(r.bar for r in W.read_bars(spark, path, "3").collect()) == list(range(80))
    for day in ("2024-01-01", "2024-01-02"):
        assert 1 < len(list(Path(path).glob(f"tf=3/day={day}/part-*.parquet"))) <= 4
