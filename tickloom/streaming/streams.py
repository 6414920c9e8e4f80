"""Structured Streaming twins of the bar, average, alert and signal operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions import constants as K
from tickloom.functions import scalar as X
from tickloom.operators import bars as B
from tickloom.session import ROCKSDB_PROVIDER
from tickloom.sources import files, sinks
from tickloom.streaming.segments import Segments

# Polling cadence of the snapshots.
CADENCE = {"processingTime": "3 minutes"}


def use_rocksdb(spark: SparkSession) -> None:
    """Per-key state on local disk with checkpointed changes; needed by the stateful jobs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def stream_snapshots(
    spark: SparkSession, root: str, pattern: str = files.SNAPSHOT_PATH, max_files: int | None = None
) -> DataFrame:
    """New snapshot files under the dated folders, as they land."""
    return files._clean(stream_lines(spark, root, max_files), pattern)


def stream_lines(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """The lines of new snapshot files as they are; each file is read in one batch, at most ``max_files`` a batch."""
    reader = (
        spark.readStream.schema(files.SNAPSHOT_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(root)


def snapshot_writer(store: str, pattern: str = files.SNAPSHOT_PATH):
    """A foreachBatch function over lines with their ``path``: snapshots go to one table, what is broken is counted in another.

    Both are written under the batch id, so a batch that runs again after a failure replaces what it wrote.
    """
    snaps, broken = f"{store}/snapshots", f"{store}/broken"

    def write(batch: DataFrame, batch_id: int) -> None:
        path, number = F.col("path"), F.lit(batch_id)
        for rows, to in ((files._clean(batch, pattern, path), snaps), (files.broken_rows(batch, pattern, path), broken)):
            out = rows.withColumn("batch", number).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("batch").parquet(to)

    return write


def stream_bars(
    snaps: DataFrame,
    tf_minutes: int = 3,
    delay: str = "6 minutes",
    open_min: int = K.SESSION_OPEN_MIN,
    length: int = K.SESSION_MINUTES,
) -> DataFrame:
    """Bars by right-closed end time; a bar is final once later bars pass it by ``delay``."""
    slot = X.slot_of(F.col("snap_ts"), tf_minutes, open_min, length)
    end = X.bar_end_ts(F.to_date("snap_ts"), slot, tf_minutes, open_min).cast("timestamp")
    rows = snaps.withColumn("bar_end", end).filter("bar_end IS NOT NULL").withWatermark("bar_end", delay)
    return rows.groupBy("symbol", "bar_end").agg(
        F.max_by("vol_cum", "snap_ts").alias("vol_cum"), F.max_by("price", "snap_ts").alias("price")
    )


def _last_of_days(slots: DataFrame) -> DataFrame:
    """Per day the rows of its last snapshot: all that calendar and universe depend on."""
    last = slots.groupBy("day").agg(F.max("snap_ts").alias("snap_ts"))
    return slots.join(last, ["day", "snap_ts"]).select("symbol", "day", "snap_ts").distinct()


LASTS = "symbol STRING, day DATE, snap_ts TIMESTAMP_NTZ"


def bar_table_writer(store: str, tf_minutes: int = 3, fan: int = 8):
    """A foreachBatch function that keeps a bar table equal to a full reload.

    The slotted rows of a batch and the symbols of the last snapshots of its days are
    stored as a segment of their own (a replay replaces them; ``segments`` merges them in
    time, so a day has few files after any number of batches). Calendar and universe come
    from the second, small table. Days are rebuilt that the batch touched, that were the
    newest until now (a newest day ends at its last snapshot), or whose number changed
    because an earlier day came late; all days if the universe gained or lost a symbol,
    since each day has a row for every symbol.
    """
    table = f"{store}/bars"
    per_day = -(-K.SESSION_MINUTES // tf_minutes)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slots = Segments(spark, f"{store}/slots", ["day"], fan)
        lasts = Segments(spark, f"{store}/lasts", [], fan, _last_of_days)
        rows = B.slot_snapshots(batch, tf_minutes)
        # The partition column is read last.
        kinds = [f for f in rows.schema if f.name != "day"] + [f for f in rows.schema if f.name == "day"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
        mine = slots.add(rows, batch_id, schema)
        touched = {r["day"] for r in mine.select("day").distinct().collect()}  # of one batch, at most the calendar
        lasts.add(_last_of_days(mine), batch_id, LASTS)
        if not touched:
            return

        def state(rows: DataFrame) -> tuple[DataFrame, DataFrame, list]:
            calendar = B.snapshot_calendar(rows, tf_minutes)
            return B.symbol_universe(rows, calendar), calendar, [r["day"] for r in calendar.select("day").orderBy("day").collect()]

        universe, calendar, days = state(lasts.read(LASTS))
        old, _, old_days = state(lasts.read(LASTS, batch_id))
        moved = universe.exceptAll(old).unionByName(old.exceptAll(universe))
        first_new = min(set(days) - set(old_days), default=None)
        if not moved.isEmpty():
            again = days
        else:
            again = [d for d in days if d in touched or d == old_days[-1] or (first_new and d >= first_new)]

        def latest(c: str):
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("snap_ts"))).alias(c)

        # The day is a partition of the store: only the rebuilt days' values are read.
        wanted = F.col("day").isin(again)
        known = slots.read(schema).filter(wanted).groupBy("symbol", "day", "slot").agg(latest("vol_cum"), latest("price"))
        grid = B.dense_grid(universe, calendar, per_day).filter(wanted)
        rows = grid.join(known, ["symbol", "day", "slot"], "left")
        sinks.write_bars(B.volume_delta(B.fill_gaps(rows)), table, str(tf_minutes), universe.count())

    return write


class _Average(StatefulProcessor):
    """Cumulative volume to bar volume and its moving average, across batches."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seed", "bar INT, day STRING, cum DOUBLE, ma DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        bar, day, cum, ma = self.state.get() if self.state.exists() else (0, None, 0.0, None)
        # A key's rows come in parts of no order; what is late was told by the state before all of them.
        part = pd.concat(list(rows), ignore_index=True).sort_values("bar")
        new = part[part["bar"] > bar]
        if len(new):
            cums, before = new["vol_cum"].to_numpy(float), new["day"].shift(1)
            before.iloc[0] = day
            same = (before == new["day"]).to_numpy()
            vol = np.where(same, np.maximum(cums - np.r_[cum, cums[:-1]], 0.0), cums)
            chain = vol if ma is None else np.r_[ma, vol]
            mas = pd.Series(chain).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[-len(vol) :]
            bar, day, cum, ma = int(new["bar"].iloc[-1]), new["day"].iloc[-1], float(cums[-1]), float(mas[-1])
            self.state.update((bar, day, cum, ma))
            yield pd.DataFrame({"symbol": key[0], "bar": new["bar"], "volume": vol, "ma": mas, "late": False})
        old = part[~part.index.isin(new.index)]
        if len(old):
            yield pd.DataFrame({"symbol": key[0], "bar": old["bar"], "volume": np.nan, "ma": np.nan, "late": True})

    def close(self) -> None:
        pass


class _Corrected(StatefulProcessor):
    """The same average with the last ``window`` bars open to correction.

    State is those bars, and of the bar before them what its successor needs. Whatever comes in is put in its place
    among them; from the first place that changed on, bars are folded again and come out with a higher version.
    """

    def __init__(self, alpha: float, window: int):
        self.alpha, self.window = alpha, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "open",
            "base INT, base_day STRING, base_cum DOUBLE, base_ma DOUBLE, "
            "bars ARRAY<INT>, days ARRAY<STRING>, cums ARRAY<DOUBLE>, mas ARRAY<DOUBLE>, versions ARRAY<INT>",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        start = (0, None, 0.0, None, [], [], [], [], [])
        base, day, cum, ma, bars, days, cums, mas, versions = self.state.get() if self.state.exists() else start
        late, held = [], {b: [d, c, m, v, False] for b, d, c, m, v in zip(bars, days, cums, mas, versions, strict=True)}
        for part in rows:
            for b, d, c in zip(part["bar"].tolist(), part["day"].tolist(), part["vol_cum"].tolist(), strict=True):
                if b <= base:
                    late.append(b)
                elif b not in held or held[b][:2] != [d, c]:
                    held[b] = [d, c, None, held[b][3] + (not held[b][4]) if b in held else 0, True]
        if late:
            yield pd.DataFrame({"symbol": key[0], "bar": late, "volume": np.nan, "ma": np.nan, "late": True, "version": 0})
        order = sorted(held)
        first = next((k for k, b in enumerate(order) if held[b][4]), None)
        if first is None:
            return
        if first:
            day, cum, ma = held[order[first - 1]][:3]
        new = order[first:]
        cums = np.array([held[b][1] for b in new], float)
        before = [day] + [held[b][0] for b in new[:-1]]
        same = np.array([held[b][0] == d for b, d in zip(new, before, strict=True)])
        vol = np.where(same, np.maximum(cums - np.r_[cum, cums[:-1]], 0.0), cums)
        chain = vol if ma is None else np.r_[ma, vol]
        mas = pd.Series(chain).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[-len(vol) :]
        for b, m in zip(new, mas.tolist(), strict=True):
            row = held[b]
            row[3] += not row[4] and row[2] is not None  # was told before, and is told again
            row[2] = m
        out = {"symbol": key[0], "bar": new, "volume": vol, "ma": mas, "late": False, "version": [held[b][3] for b in new]}
        yield pd.DataFrame(out)
        closed, kept = order[: -self.window], order[-self.window :]
        if closed:
            base, (day, cum, ma) = closed[-1], held[closed[-1]][:3]
        else:
            base, day, cum, ma = (self.state.get() if self.state.exists() else start)[:4]
        self.state.update((base, day, cum, ma, kept, *([held[b][k] for b in kept] for k in range(4))))

    def close(self) -> None:
        pass


def latest_version(rows: DataFrame) -> DataFrame:
    """(symbol, bar, volume, ma) as last corrected; late bars are left out."""
    values = F.max_by(F.struct("volume", "ma"), "version").alias("v")
    return rows.filter("NOT late").groupBy("symbol", "bar").agg(values).select("symbol", "bar", "v.*")


def stream_moving_average(bars: DataFrame, kind: str = "rma", n: int = K.FAST_LEN, window: int = 0) -> DataFrame:
    """(symbol, day, bar, vol_cum) stream to per-bar volume and its moving average.

    A bar that is not newer than what was folded in comes out as a row with ``late``
    set and no values, so that late bars can be counted and reloaded. With a ``window``
    the last so many bars of a symbol can still be corrected: a late one among them, or a
    changed one, comes out with all after it, with a higher ``version``; only older ones are late.
    """
    alpha = 2.0 / (n + 1) if kind == "ema" else 1.0 / n
    rows = bars.select("symbol", F.col("day").cast("string").alias("day"), "bar", "vol_cum")
    if window:
        return rows.groupBy("symbol").transformWithStateInPandas(
            _Corrected(alpha, window), "symbol STRING, bar INT, volume DOUBLE, ma DOUBLE, late BOOLEAN, version INT", "append", "None"
        )
    return rows.groupBy("symbol").transformWithStateInPandas(
        _Average(alpha), "symbol STRING, bar INT, volume DOUBLE, ma DOUBLE, late BOOLEAN", "append", "None"
    )


#: Groups that symbols are dealt to: a group's symbols share one call and one state, as both cost more than the rows of one.
GROUPS = 1024


def _dealt(rows: DataFrame):
    """``rows`` grouped by the number of their symbol's group."""
    return rows.withColumn("_group", F.pmod(F.xxhash64("symbol"), F.lit(GROUPS)).cast("int")).groupBy("_group")


def _by_symbol(rows: Iterator[pd.DataFrame], order: str) -> tuple[pd.DataFrame, list, np.ndarray]:
    """The rows of a group by symbol and ``order``, the symbols, and where the rows of each begin."""
    # A group's rows come in parts of no order.
    part = pd.concat(list(rows), ignore_index=True)
    code, names = pd.factorize(part["symbol"], use_na_sentinel=False)
    at = np.lexsort((part[order].to_numpy(), code))
    begins = np.flatnonzero(np.diff(code[at], prepend=-1))
    return part.iloc[at].reset_index(drop=True), [None if pd.isna(n) else n for n in names], begins


class _NewSignals(StatefulProcessor):
    """Passes an alert when its signal differs from the last one of its symbol; a key is a group of symbols."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "symbols ARRAY<STRING>, signals ARRAY<STRING>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last = dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}
        rows, names, begins = _by_symbol(rows, "alert_id")
        signals = rows["signal"].astype(object).where(rows["signal"].notna(), None).to_numpy()
        before = np.r_[np.array([None], object), signals[:-1]]
        before[begins] = [last.get(n) for n in names]
        last.update(zip(names, signals[np.r_[begins[1:] - 1, len(rows) - 1]].tolist(), strict=True))
        self.state.update((list(last.keys()), list(last.values())))
        yield rows[signals != before][["symbol", "alert_id", "signal"]]

    def close(self) -> None:
        pass


def dedup_alerts(alerts: DataFrame, enabled: bool = True, block: int = 100_000) -> DataFrame:
    """(symbol, alert_id, signal): keep alerts whose signal changed. Batch or stream.

    Batch form: alerts are ordered only inside blocks of ``block`` ids, and each block
    learns the last signal before it from a table with one row per symbol and block, so
    a symbol with very many alerts spreads over tasks. In a stream the micro-batch
    (``maxFilesPerTrigger`` of the source) bounds what one symbol can bring at once.
    """
    if not enabled:
        return alerts
    rows = alerts.select("symbol", "alert_id", "signal")
    if alerts.isStreaming:
        return _dealt(rows).transformWithStateInPandas(
            _NewSignals(), "symbol STRING, alert_id LONG, signal STRING", "append", "None"
        )
    rows = rows.withColumn("_b", F.floor(F.col("alert_id") / block))
    ends = rows.groupBy("symbol", "_b").agg(F.max("alert_id").alias("alert_id"))
    ends = ends.join(rows, ["symbol", "_b", "alert_id"])
    chain = Window.partitionBy("symbol").orderBy("_b")
    carry = ends.select("symbol", "_b", F.lag("signal").over(chain).alias("_carry"))
    inside = Window.partitionBy("symbol", "_b").orderBy("alert_id")
    before = F.coalesce(F.lag("signal").over(inside), F.col("_carry"))
    return (
        rows.join(carry, ["symbol", "_b"])
        .withColumn("_before", before)
        .filter(~F.col("signal").eqNullSafe(F.col("_before")))
        .select("symbol", "alert_id", "signal")
    )


def once_per_scan(deals: DataFrame, ts: str = "ts", scan: str = "3 minutes") -> DataFrame:
    """Stream guard: one deal per exchange, symbol and signal in each scan, with the start of the scan.

    Scans are the windows of length ``scan``; the next one lets the same deal pass again.
    """
    keys = ["exch", "symbol", "signal"]
    # The deal's own time travels inside a struct: state is dropped by the end of the window alone.
    deal = F.struct(*[c for c in deals.columns if c not in keys]).alias("deal")
    rows = deals.withWatermark(ts, scan).select(F.window(ts, scan).alias("window"), *keys, deal)
    rows = rows.dropDuplicates(["window", *keys])
    return rows.select(*keys, "deal.*", F.col("window.start").alias("scan_start"))


class _Oscillator(StatefulProcessor):
    """The oscillator positions of a group of symbols, bar by bar, from (fast, sig)."""

    def __init__(self, center: float, short_ok: bool):
        self.center, self.short_ok = center, short_ok

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "pos",
            "symbols ARRAY<STRING>, bars ARRAY<INT>, recent ARRAY<ARRAY<DOUBLE>>, angles ARRAY<ARRAY<DOUBLE>>, sigs ARRAY<DOUBLE>, "
            "active ARRAY<BOOLEAN>, was_long ARRAY<BOOLEAN>, was_short ARRAY<BOOLEAN>",
        )

    def _trend(self, recent: np.ndarray, angles: np.ndarray, fast: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direction of each new bar, and the angles with the carried ones in front."""
        n = K.TREND_RANGE
        # A window that is not full, or has a value missing, has no range.
        windows = np.lib.stride_tricks.sliding_window_view(np.r_[np.full(n - 1, np.nan), recent, fast], n)[len(recent) :]
        top, low = windows.max(axis=1), windows.min(axis=1)
        before = np.r_[recent[-1:] if len(recent) else np.nan, fast[:-1]]
        before = np.where(np.isnan(before), 0.0, before)
        with np.errstate(divide="ignore", invalid="ignore"):
            steep = K.RAD_TO_DEG * np.arctan((fast - before) / np.where(top > low, top - low, np.nan))
        angles = np.r_[angles, steep]
        slope = np.full(len(angles), np.nan)
        slope[2:] = (-angles[:-2] + 2 * angles[1:-1] + 5 * angles[2:]) / 6
        slope = slope[-len(fast) :]
        up = (slope >= K.TREND_THRESHOLD) | (fast >= top)
        down = (slope <= -K.TREND_THRESHOLD) | (fast <= low)
        return np.where(up, K.UP, np.where(down, K.DOWN, K.FLAT)), angles

    @staticmethod
    def _latch(go: np.ndarray, stop: np.ndarray, active: bool) -> np.ndarray:
        """On at go, off at stop, turned where both meet: turns are counted since the last plain step."""
        at = np.arange(len(go))
        plain = go != stop
        last = np.maximum.accumulate(np.where(plain, at, -1))
        turns = np.cumsum(go & stop)
        start = np.where(last >= 0, go[last], active)
        return start ^ ((turns - np.where(last >= 0, turns[last], 0)) % 2 == 1)

    def _codes(self, held: tuple, fast: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Codes of one symbol's new bars, and what its next ones need."""
        _, recent, angles, sig, active, was_l, was_s = held
        recent, angles = np.array(recent, float), np.array(angles, float)
        trend, angles = self._trend(recent, angles, fast)
        old_fast, old_sig = np.r_[recent[-1:] if len(recent) else np.nan, fast[:-1]], np.r_[sig, sigs[:-1]]
        above = fast >= sigs
        crossed = ((fast > sigs) & (old_fast <= old_sig)) | ((fast < sigs) & (old_fast >= old_sig))
        buy, sell = above & (fast >= self.center), ~above & (fast < self.center)
        go_l, go_s = buy & (trend == K.UP), sell & (trend == K.DOWN) & self.short_ok
        stop = ~(buy | sell) | crossed
        on = self._latch(go_l | go_s, stop, active)
        was = np.r_[active, on[:-1]]
        long, short = buy & on, sell & on
        had_l, had_s = np.r_[was_l, long[:-1]], np.r_[was_s, short[:-1]]
        code = np.select(
            [stop & had_l, stop & had_s, go_l & ~was, go_s & ~was, long, short],
            [K.EXIT_LONG, K.EXIT_SHORT, K.ENTER_LONG, K.ENTER_SHORT, K.LONG, K.SHORT],
            K.NEUTRAL,
        )
        recent = np.r_[recent, fast][-K.TREND_RANGE :]
        return code, (recent.tolist(), angles[-2:].tolist(), float(sigs[-1]), bool(on[-1]), bool(long[-1]), bool(short[-1]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = {s: x for s, *x in zip(*self.state.get(), strict=True)} if self.state.exists() else {}
        part, names, begins = _by_symbol(rows, "bar")
        bars, fast, sigs = part["bar"].to_numpy(), part["fast"].to_numpy(float), part["sig"].to_numpy(float)
        code, late = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
        for name, a, b in zip(names, begins, np.r_[begins[1:], len(part)], strict=True):
            own = held.get(name, (0, [], [], np.nan, False, False, False))
            # What is late is told by the state before the whole batch.
            first = a + int(np.searchsorted(bars[a:b], own[0], "right"))
            late[a:first] = True
            if first < b:
                code[first:b], rest = self._codes(own, fast[first:b], sigs[first:b])
                held[name] = (int(bars[b - 1]), *rest)
        self.state.update((list(held.keys()), *map(list, zip(*held.values(), strict=True))))
        out = pd.DataFrame({"symbol": part["symbol"], "bar": bars, "code": code, "late": late})
        if not late.all():
            yield out[~late]
        if late.any():
            yield out[late].assign(code=None)

    def close(self) -> None:
        pass


def stream_osc_signal(rows: DataFrame, center: float = 0.0, short_ok: bool = True) -> DataFrame:
    """(symbol, bar, fast, sig) of closed bars to signal codes; state is some 30 values per symbol, kept by groups.

    Late bars come out with ``late`` set and no code, as in ``stream_moving_average``.
    """
    return _dealt(rows.select("symbol", "bar", "fast", "sig")).transformWithStateInPandas(
        _Oscillator(center, short_ok), "symbol STRING, bar INT, code INT, late BOOLEAN", "append", "None"
    )


def follow(stream: DataFrame, write, checkpoint: str, live: bool = True):
    """Start a foreachBatch job: at the polling cadence, or once over what is there."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(CADENCE if live else {"availableNow": True})).start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str, output: T.StructType | None = None) -> DataFrame:
    """Process what is there, into Parquet; a rerun continues from the checkpoint."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(output or stream.schema).parquet(path)
