"""Slots, gaps, deltas, rollups, and the file source against a hand-made directory."""

import os
from datetime import datetime
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalar as X
from tickloom.operators import bars as B
from tickloom.operators import scan as C
from tickloom.sources import files as R
from tickloom.sources import sinks as W
from tickloom.streaming import streams as S
from tickloom.streaming.segments import Segments, files_of

HEAD = '﻿"symbol","vol_cum","vol_val_cum","price"\n'


def snap(spark, rows):
    return spark.createDataFrame(rows, "symbol STRING, snap_ts TIMESTAMP_NTZ, vol_cum DOUBLE, price DOUBLE")


def at(day, hm):
    return datetime(2026, 5, day, *map(int, hm.split(":")))


def filled(spark, cum, price=None, day_idx=2):
    rows = [("A", day_idx, i, (day_idx - 1) * 5 + i, c, p) for i, (c, p) in enumerate(zip(cum, price or cum), 1)]
    df = spark.createDataFrame(rows, "symbol STRING, day_idx INT, slot INT, bar INT, vol_cum DOUBLE, price DOUBLE")
    return B.fill_gaps(df).orderBy("bar").collect()


def test_slot_edges(spark):
    times = ["09:15", "09:16", "09:18", "09:19", "15:30", "15:31"]
    df = spark.createDataFrame([(i, at(4, t)) for i, t in enumerate(times)], "i INT, ts TIMESTAMP_NTZ")
    got = [r.s for r in df.orderBy("i").select(X.slot_of(F.col("ts"), 3).alias("s")).collect()]
    assert got == [None, 1, 1, 2, 125, None]


@pytest.mark.parametrize(
    "cum, want",
    [
        ([10, None, None, 40, None], [10, 20, 30, 40, 40]),
        ([None, None, 30], [30, 30, 30]),
        ([None, None, None], [0, 0, 0]),
    ],
)
def test_gaps_inside_a_day(spark, cum, want):
    cum = [None if c is None else float(c) for c in cum]
    assert [r.vol_cum for r in filled(spark, cum)] == want


def test_first_bar_of_all(spark):
    rows = filled(spark, [None, None, 30.0], [None, None, 5.0], day_idx=1)
    assert [r.vol_cum for r in rows] == [0, 15, 30]
    assert [r.price for r in rows] == [5, 5, 5]


def test_delta_and_rollup(spark):
    rows = [("A", None, 1, i, i, 7, float(c), float(i)) for i, c in enumerate([10, 20, 15, 40, 50, 60, 90], 1)]
    df = spark.createDataFrame(
        rows, "symbol STRING, day DATE, day_idx INT, slot INT, bar INT, last_bar INT, vol_cum DOUBLE, price DOUBLE"
    )
    assert [r.volume for r in B.volume_delta(df).orderBy("bar").collect()] == [10, 10, 0, 25, 10, 10, 30]
    coarse = B.rollup(df, 5, 125).orderBy("bar").collect()
    assert [(r.bar, r.vol_cum, r.price, r.volume, r.last_bar) for r in coarse] == [(1, 50, 5, 50, 2), (2, 90, 7, 40, 2)]


def write(root, day, hm, lines):
    os.makedirs(f"{root}/{day:02d}052026", exist_ok=True)
    with open(f"{root}/{day:02d}052026/snap_{hm}.csv", "w", encoding="utf-8") as f:
        f.write(HEAD + "".join(f"{x}\n" for x in lines))


FILES = [
    (4, "0916", ["A,10,1.0,100", "LTIM,5,1.0,50"]),
    (4, "0918", ["A,12,1.0,101", "LTIM,7,1.0,bad"]),
    (4, "0921", ['"A","20","1.0","102"', "short"]),
    (4, "0927", ["A,40,1.0,104", "LTIM,9,1.0,52"]),
    (4, "0800", ["A,1,1.0,1"]),
    (5, "0918", ["A,5,1.0,105", "NEW,3,1.0,7"]),
    (5, "0924", ["A,9,1.0,106", "NEW,8,1.0,8", "LTIM,1,1.0,53"]),
    (6, "0918", ["A,2,1.0,107"]),
    (6, "0921", []),
]


@pytest.fixture()
def corpus(tmp_path):
    for day, hm, lines in FILES:
        write(tmp_path, day, hm, lines)
    return str(tmp_path)


def test_snapshot_files(spark, corpus):
    rows = R.read_snapshots(spark, corpus)
    got = {(r.symbol, r.snap_ts.strftime("%d%H%M")): (r.vol_cum, r.price) for r in rows.collect()}
    assert got["A", "040921"] == (20, 102)  # quoted
    assert got["LTM", "040918"] == (7, None)  # renamed; the price does not parse
    assert ("A", "040800") not in got and not any(s == "short" for s, _ in got)
    files = R.snapshot_manifest(spark, corpus)
    assert files.count() == 8  # the header-only file counts, the early one does not
    assert {r.day.day for r in R.snapshot_manifest(spark, corpus, 2).collect()} == {5, 6}
    assert {r.snap_ts.day for r in R.read_snapshots(spark, corpus, 2).collect()} == {5, 6}


def test_last_write_wins_and_keeps_parsed_values(spark, corpus):
    slots = B.slot_snapshots(R.read_snapshots(spark, corpus))
    got = {(r.symbol, r.day.day, r.slot): (r.vol_cum, r.price) for r in slots.collect()}
    assert got["A", 4, 1] == (12, 101)
    assert got["LTM", 4, 1] == (7, 50)


def test_header_only_last_file(spark, corpus):
    """It sets the length of the day and contributes no symbol."""
    snaps, files = R.read_snapshots(spark, corpus), R.snapshot_manifest(spark, corpus)
    bars = B.build_bars(snaps, files.select("snap_ts"))
    assert bars.agg(F.max("bar")).first()[0] == 2 * 125 + 2
    assert {r.symbol for r in bars.select("symbol").distinct().collect()} == {"A", "LTM", "NEW"}
    new = {r.bar: r.volume for r in bars.filter("symbol = 'NEW'").collect()}
    assert new[126] == 3 and new[127] == 2.5 and new[1] == 0  # first seen on day 2


def test_row_order_does_not_matter(spark, corpus):
    snaps = R.read_snapshots(spark, corpus)
    a = B.build_bars(snaps).orderBy("symbol", "bar").collect()
    b = B.build_bars(snaps.orderBy(F.rand(3))).orderBy("symbol", "bar").collect()
    assert a == b


def test_stream_equals_batch(spark, corpus, tmp_path_factory):
    """Files arrive one by one, out of order within the run; the table equals a full load."""
    live, store = str(tmp_path_factory.mktemp("live")), str(tmp_path_factory.mktemp("store"))
    check = str(tmp_path_factory.mktemp("check"))
    for part in (FILES[:3], FILES[3:6], FILES[6:8]):
        for day, hm, lines in part:
            write(live, day, hm, lines)
        q = (
            S.stream_snapshots(spark, live)
            .writeStream.foreachBatch(S.bar_table_writer(store))
            .option("checkpointLocation", check)
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    cols = ["symbol", "bar", "vol_cum", "price", "volume"]
    got = W.read_bars(spark, f"{store}/bars", "3").select(*cols).orderBy("symbol", "bar").collect()
    want = B.build_bars(R.read_snapshots(spark, live)).select(*cols).orderBy("symbol", "bar").collect()
    assert got == want


@pytest.mark.parametrize(
    "batches",
    [
        # A day that was cut short ends when the next begins.
        [[("A", 1, "09:16"), ("A", 1, "09:20")], [("A", 2, "09:16")]],
        # A symbol that the last file lacks leaves the universe.
        [[("A", 1, "09:16"), ("B", 1, "09:16")], [("A", 1, "09:20")]],
        # An earlier day comes late and moves the number of the others.
        [[("A", 2, "09:16")], [("A", 3, "09:16")], [("A", 1, "09:19"), ("A", 1, "15:30")]],
    ],
)
def test_bar_table_equals_reload(spark, tmp_path, batches):
    writer, rows = S.bar_table_writer(str(tmp_path / "store")), []
    cols = ["symbol", "day", "bar", "vol_cum", "price", "volume", "last_bar"]
    for k, batch in enumerate(batches):
        new = [(s, f"2024-01-0{d} {t}:00", 10.0 * k + i, 5.0) for i, (s, d, t) in enumerate(batch)]
        rows += new
        frame = lambda r: spark.createDataFrame(r, "symbol STRING, t STRING, vol_cum DOUBLE, price DOUBLE").selectExpr(
            "symbol", "CAST(t AS TIMESTAMP_NTZ) AS snap_ts", "vol_cum", "price"
        )
        writer(frame(new), k)
        got = W.read_bars(spark, str(tmp_path / "store/bars"), "3").select(*cols).orderBy("symbol", "bar").collect()
        assert got == B.build_bars(frame(rows)).select(*cols).orderBy("symbol", "bar").collect()


def test_replayed_batch_changes_nothing(spark, corpus, tmp_path):
    snaps = R.read_snapshots(spark, corpus)
    writer = S.bar_table_writer(str(tmp_path / "store"))
    writer(snaps, 0)
    first = W.read_bars(spark, str(tmp_path / "store/bars"), "3").orderBy("symbol", "bar").collect()
    writer(snaps, 0)
    assert W.read_bars(spark, str(tmp_path / "store/bars"), "3").orderBy("symbol", "bar").collect() == first


def test_segments_stay_few_and_replay(spark, tmp_path):
    """After 40 batches a day has few files; a batch that runs again, or broke off before its manifest, changes nothing."""
    root, schema = str(tmp_path / "s"), "n LONG, day STRING"
    store = Segments(spark, root, ["day"], fan=3)
    frame = lambda k: spark.range(k * 4, k * 4 + 4).selectExpr("id AS n", "concat('d', id % 2) AS day")
    most = 0
    for k in range(40):
        if k == 20:  # broken off: data without a manifest
            store._write(frame(999), (0, k, k))
        own = store.add(frame(k), k, schema)
        assert own.count() == 4
        if k in (7, 8, 26):
            store.add(frame(k), k, schema)
        most = max(most, len(store.manifest()))
    assert sorted(r.n for r in store.read(schema).collect()) == list(range(160))
    assert sorted(r.n for r in store.read(schema, 39).collect()) == list(range(156))
    assert most <= 2 * 4
    counts = {r.value: r.files for r in files_of(spark, root, "day").collect()}
    assert set(counts) == {"d0", "d1"} and max(counts.values()) <= 2 * 4 + 3


def test_lists_and_labels(spark, tmp_path):
    (tmp_path / "list.txt").write_text("AAA\n\n# note\n BBB \n")
    got = R.read_symbol_list(spark, str(tmp_path / "list.txt")).collect()
    assert [r.symbol for r in got] == ["AAA", "BBB"]
    names = ["Nifty MidSmall IT & Telecom", "Nifty Financial Services 25/50"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING").select(X.index_slug(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["nifty_midsmall_it_telecom.csv", "nifty_financial_services_25_50.csv"]
    df = spark.createDataFrame([("nse:nifty1!",), ("M&M",)], "n STRING").select(X.clean_symbol(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["NSENIFTY", "M&M"]


def test_simple_averages_of_a_scan_do_not_depend_on_the_order_of_bars(spark):
    prices = [107.76, 12.34, 0.1, 33.07, 250.19, 71.3]
    rows = [(f"S{k}", b, 130, p, 0.0) for k, p in enumerate(prices) for b in range(1, 131)]
    df = spark.createDataFrame(rows, "symbol STRING, bar INT, last_bar INT, price DOUBLE, volume DOUBLE")

    def action(p):
        # One by one: Python's sum() corrects its rounding.
        fast, slow = (list(accumulate([p] * n))[-1] / n for n in (8, 21))
        return (fast > slow) - (fast < slow)

    for parts in (1, 3, 7):
        got = C.surge_scan(df.repartition(parts, "bar"), "sma").orderBy("symbol").collect()
        assert [r.price_ma_action for r in got] == [action(p) for p in prices], parts
