"""Stateful streams over several batches against their batch forms."""

import random

from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.streaming import streams as S


def feed(spark, tmp_path, df, parts, key):
    """Write ``df`` in ``parts`` files and follow them one file per batch."""
    root = str(tmp_path / "in")
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    step = (hi - lo + parts) // parts
    for i in range(parts):
        a, b = lo + i * step, lo + (i + 1) * step
        df.filter((F.col(key) >= a) & (F.col(key) < b)).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)


def run(stream, tmp_path):
    return S.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"))


def test_average_over_batches(spark, tmp_path):
    S.use_rocksdb(spark)
    rows = [(s, f"d{b // 20}", b, float((b % 20) * 7 + b % 3)) for s in ("A", "B") for b in range(1, 80)]
    df = spark.createDataFrame(rows, "symbol STRING, day STRING, bar INT, vol_cum DOUBLE")
    got = run(S.stream_moving_average(feed(spark, tmp_path, df, 4, "bar"), "rma", 8), tmp_path)
    out = got.withColumn("want", I.rma("volume", 8)).collect()
    assert len(out) == len(rows)
    assert all(abs(r.ma - r.want) < 1e-9 for r in out)


def test_alerts_over_batches(spark, tmp_path):
    S.use_rocksdb(spark)
    rows = [(f"S{i % 3}", i, "BUY" if (i // 4) % 2 else "SELL") for i in range(60)]
    df = spark.createDataFrame(rows, "symbol STRING, alert_id LONG, signal STRING")
    got = run(S.dedup_alerts(feed(spark, tmp_path, df, 5, "alert_id")), tmp_path)
    want = S.dedup_alerts(df, block=7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert S.dedup_alerts(df, enabled=False).count() == 60


def test_late_bars_are_told(spark, tmp_path):
    S.use_rocksdb(spark)
    root, schema = str(tmp_path / "in"), "symbol STRING, day STRING, bar INT, vol_cum DOUBLE"
    want = []
    for bars, late in (([1, 2, 5], []), ([3, 6], [3]), ([6, 7], [6])):
        spark.createDataFrame([("A", "d", b, float(b)) for b in bars], schema).coalesce(1).write.mode("append").parquet(root)
        got = run(S.stream_moving_average(spark.readStream.schema(schema).parquet(root)), tmp_path)
        want += late
    rows = got.collect()
    assert sorted(r.bar for r in rows if r.late) == want and sorted(r.bar for r in rows if not r.late) == [1, 2, 5, 6, 7]


def test_bars_of_one_batch_come_in_any_order(spark, tmp_path):
    """A key's micro-batch is handed over in several parts, none of them in order; nothing of it is late."""
    S.use_rocksdb(spark)
    bars = [(b * 37) % 101 for b in range(1, 101)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        rows = [("A", f"d{b // 20}", b, float((b % 20) * 7 + b % 3)) for b in bars]
        df = spark.createDataFrame(rows, "symbol STRING, day STRING, bar INT, vol_cum DOUBLE").coalesce(1)
        (tmp_path / "ma").mkdir()
        got = run(S.stream_moving_average(feed(spark, tmp_path / "ma", df, 1, "bar"), "rma", 8), tmp_path / "ma")
        out = got.withColumn("want", I.rma("volume", 8)).collect()
        assert len(out) == 100 and not any(r.late for r in out) and all(abs(r.ma - r.want) < 1e-9 for r in out)
        osc = df.selectExpr("symbol", "bar", "sin(bar / 5D) AS fast", "sin((bar - 2) / 5D) AS sig").coalesce(1)
        codes = []
        for name, rows, many in (("mixed", osc, "7"), ("whole", osc.orderBy("bar"), "10000")):
            spark.conf.set(size, many)
            (tmp_path / name).mkdir()
            got = run(S.stream_osc_signal(feed(spark, tmp_path / name, rows, 1, "bar")), tmp_path / name)
            codes.append(sorted((r.bar, r.code, r.late) for r in got.collect()))
        assert len(codes[0]) == 100 and codes[0] == codes[1] and not any(late for _, _, late in codes[0])
    finally:
        spark.conf.set(size, before)


def test_same_deal_passes_once_in_each_scan(spark, tmp_path):
    rows = [("NSE", "A", "BUY", f"2024-01-01 {h}:0{m}:00") for h in (10, 11, 12) for m in (0, 1)]
    rows += [("NSE", "A", "SELL", "2024-01-01 10:01:00"), ("NSE", "A", "BUY", "2024-01-01 10:03:00")]
    df = spark.createDataFrame(rows, "exch STRING, symbol STRING, signal STRING, t STRING").selectExpr("*", "CAST(t AS TIMESTAMP) AS ts").drop("t")
    df.write.parquet(str(tmp_path / "in"))
    got = run(S.once_per_scan(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path)
    assert sorted((r.signal, r.scan_start.strftime("%H:%M")) for r in got.collect()) == [
        ("BUY", "10:00"), ("BUY", "10:03"), ("BUY", "11:00"), ("BUY", "12:00"), ("SELL", "10:00")
    ]


def test_live_cadence_starts_at_once_and_counts_broken_files(spark, tmp_path):
    """The polling trigger: what is there is read when the job starts, new files at the next poll; broken ones are counted."""
    root, store = tmp_path / "in", str(tmp_path / "store")
    (root / "02012024").mkdir(parents=True)
    (root / "02012024" / "v_0916.csv").write_text("symbol,vol_cum,vol_val_cum,price\nA,1,0,10\nB,x,0,20\nC,3\n")
    (root / "02012024" / "notes.csv").write_text("symbol,vol_cum,vol_val_cum,price\nD,1,0,10\n")
    lines = S.stream_lines(spark, str(root), 1).withColumn("path", F.col("_metadata.file_path"))
    q = S.follow(lines, S.snapshot_writer(store), str(tmp_path / "cp"), live=True)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.parquet(f"{store}/snapshots").collect()
    assert sorted((r.symbol, r.vol_cum, r.price) for r in rows if r.symbol == "A") == [("A", 1.0, 10.0)]
    assert [r.vol_cum for r in rows if r.symbol == "B"] == [None] and len(rows) == 2
    broken = spark.read.parquet(f"{store}/broken").groupBy("reason").agg(F.sum("n").alias("n")).collect()
    assert {r.reason: r.n for r in broken} == {"no time in the name": 1, "short row": 1, "not a number": 1}


def test_late_bars_within_the_window_correct_what_followed(spark, tmp_path):
    """Bars in any order over many batches, repeated and changed ones; the last versions equal folding all at once."""
    S.use_rocksdb(spark)
    rng, root, schema = random.Random(3), str(tmp_path / "in"), "symbol STRING, day STRING, bar INT, vol_cum DOUBLE"
    true = {b: (f"d{b // 10}", float((b % 10) * 7 + b % 3)) for b in range(1, 61)}
    order = sorted(true, key=lambda b: b + rng.randrange(12))
    batches = [order[k : k + 12] for k in range(0, 60, 12)]
    for k, batch in enumerate(batches):
        rows = [("A", true[b][0], b, true[b][1]) for b in batch]
        rows += [("A", true[b][0], b, true[b][1] + 1000.0) for b in batch[:1] if k < 4]  # wrong, put right in the next batch
        rows = [r for r in rows if k == 4 or r[2] != batch[0] or r[3] >= 1000] + [("A", true[b][0], b, true[b][1]) for b in (batches[k - 1][:1] if k else [])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        got = run(S.stream_moving_average(spark.readStream.schema(schema).parquet(root), "rma", 8, window=40), tmp_path)
    rows = got.collect()
    assert not any(r.late for r in rows) and max(r.version for r in rows) > 1
    assert len({(r.bar, r.version) for r in rows}) == len(rows)
    whole = spark.createDataFrame([("A", b, v) for b, v in ((b, true[b][1] if b == 1 or true[b][0] != true[b - 1][0] else max(true[b][1] - true[b - 1][1], 0.0)) for b in true)], "symbol STRING, bar INT, volume DOUBLE")
    want = {r.bar: (r.volume, r.ma) for r in whole.withColumn("ma", I.rma("volume", 8)).collect()}
    last = {r.bar: (r.volume, r.ma) for r in S.latest_version(got).collect()}
    assert last.keys() == want.keys() and all(abs(last[b][k] - want[b][k]) < 1e-9 for b in want for k in (0, 1))
    spark.createDataFrame([("A", "d0", 5, 1.0)], schema).coalesce(1).write.mode("append").parquet(root)
    got = run(S.stream_moving_average(spark.readStream.schema(schema).parquet(root), "rma", 8, window=40), tmp_path)
    assert [r.bar for r in got.collect() if r.late] == [5]


def test_symbols_share_groups_of_state(spark, tmp_path, monkeypatch):
    """Many symbols in few groups, over several batches, without and with missing values: as each on its own."""
    S.use_rocksdb(spark)
    monkeypatch.setattr(S, "GROUPS", 2)
    rows = [(f"S{i % 7}" if i % 7 else None, i, (None, "BUY", "SELL")[(i // 9) % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol STRING, alert_id LONG, signal STRING")
    (tmp_path / "alerts").mkdir()
    got = run(S.dedup_alerts(feed(spark, tmp_path / "alerts", df, 3, "alert_id")), tmp_path / "alerts")
    last, want = {}, []
    for symbol, i, signal in rows:
        want += [(symbol, i, signal)] if last.get(symbol) != signal else []
        last[symbol] = signal
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    osc = spark.range(1, 61).selectExpr("CAST(id AS INT) AS bar", "explode(sequence(1, 5)) AS k")
    osc = osc.selectExpr("concat('S', k) AS symbol", "bar", "sin(bar / (3D + k)) AS fast", "sin((bar - 2) / (3D + k)) AS sig").filter("bar > 4 * k")
    codes = []
    for name, parts, groups in (("few", 3, 2), ("many", 1, 1000)):
        monkeypatch.setattr(S, "GROUPS", groups)
        (tmp_path / name).mkdir()
        got = run(S.stream_osc_signal(feed(spark, tmp_path / name, osc, parts, "bar")), tmp_path / name)
        codes.append(sorted((r.symbol, r.bar, r.code, r.late) for r in got.collect()))
    assert len(codes[0]) == 240 and codes[0] == codes[1] and len({c for _, _, c, _ in codes[0]}) > 3
