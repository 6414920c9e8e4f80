"""SQL text for the indicator and signal chains (self-joins and recursive queries)."""

from __future__ import annotations

from tickloom.plans import adapters as A


class Chain:
    """Builds one WITH list over the hourly bars; every column becomes its own step."""

    def __init__(self):
        self.parts = [A.HOURLY_SQL]
        self.top = "hourly"
        self.n = 0

    def step(self, exprs: str) -> "Chain":
        """Add columns; window ``w`` is the symbol's bar order."""
        self.n += 1
        name = f"s{self.n}"
        self.parts.append(
            f"{name} AS MATERIALIZED (SELECT *, {exprs} FROM {self.top} "
            "WINDOW w AS (PARTITION BY symbol ORDER BY bar), "
            "g AS (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING))"
        )
        self.top = name
        return self

    def rma(self, jobs: dict[str, tuple[str, int]]) -> "Chain":
        for out, (x, n) in jobs.items():
            t = f"{out}_{self.n}"
            self.parts.append(
                f"""i_{t} AS (SELECT symbol, bar, {x} AS x, sum(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) OVER
      (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS isl FROM {self.top}),
k_{t} AS MATERIALIZED (SELECT symbol, bar, isl, x, row_number() OVER q AS k,
      avg(x) OVER (PARTITION BY symbol, isl ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m
      FROM i_{t} WHERE x IS NOT NULL WINDOW q AS (PARTITION BY symbol, isl ORDER BY bar)),
r_{t} AS MATERIALIZED (SELECT a.symbol, a.bar, sum(pow(1 - 1.0::DOUBLE / {n}, a.k - b.k) *
      CASE WHEN b.k = {n} THEN b.m ELSE b.x / {n} END) AS {out}
      FROM k_{t} a JOIN k_{t} b ON a.symbol = b.symbol AND a.isl = b.isl AND b.k >= {n} AND b.k <= a.k GROUP BY 1, 2)"""
            )
            self.n += 1
            self.parts.append(
                f"s{self.n} AS MATERIALIZED (SELECT l.*, r.{out} FROM {self.top} l LEFT JOIN r_{t} r USING (symbol, bar))"
            )
            self.top = f"s{self.n}"
        return self

    def rsi(self, c="close", n=8, out="rsi") -> "Chain":
        self.step(f"greatest({c} - lag({c}) OVER w, 0 * ({c} - lag({c}) OVER w)) AS up_{out}, greatest(lag({c}) OVER w - {c}, 0 * ({c} - lag({c}) OVER w)) AS dn_{out}")
        self.step(
            f"CASE WHEN lag({c}) OVER w IS NOT NULL THEN up_{out} END AS u_{out}, CASE WHEN lag({c}) OVER w IS NOT NULL THEN dn_{out} END AS d_{out}"
        )
        self.rma({f"ru_{out}": (f"u_{out}", n), f"rd_{out}": (f"d_{out}", n)})
        return self.step(
            f"CASE WHEN ru_{out} IS NULL THEN NULL WHEN rd_{out} = 0 THEN 100 WHEN ru_{out} = 0 THEN 0 ELSE 100 - 100 / (1 + ru_{out} / rd_{out}) END AS {out}"
        )

    def full(self, c: str, n: int, fn: str, out: str) -> str:
        f = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
        o = f"(PARTITION BY symbol ORDER BY bar {f})"
        return f"CASE WHEN count({c}) OVER {o} = {n} THEN {fn}({c}) OVER {o} END AS {out}"

    def rsi_osc(self) -> "Chain":
        self.rsi("close", 8, "rsi8")
        self.rma({"rsi_a": ("rsi8", 13)}).rma({"rsi_fast": ("rsi_a", 3)})
        return self.rma({"rsi_sig": ("rsi_fast", 13)})

    def scaled(self, raw: str, tag: str) -> "Chain":
        self.step(self.full(raw, 89, "stddev_pop", f"{tag}_sd"))
        self.rma({f"{tag}_sm": (raw, 3)})
        self.step(f"CASE WHEN {tag}_sd <> 0 THEN 100 * {tag}_sm / (3 * {tag}_sd) END AS {tag}_fast")
        return self.rma({f"{tag}_sig": (f"{tag}_fast", 13)})

    def kst_raw(self, c: str, tag: str) -> "Chain":
        ns = (8, 13, 21, 34)
        self.step(", ".join(
            f"CASE WHEN lag({c}, {n}) OVER w <> 0 THEN 100 * ({c} - lag({c}, {n}) OVER w) / lag({c}, {n}) OVER w END AS {tag}_o{i}"
            for i, n in enumerate(ns, 1)
        ))
        self.rma({f"{tag}_m{i}": (f"{tag}_o{i}", m) for i, m in enumerate((8, 8, 8, 13), 1)})
        return self.step(f"{tag}_m1 + 2 * {tag}_m2 + 3 * {tag}_m3 + 4 * {tag}_m4 AS {tag}_raw")

    def kst(self, c: str = "close", tag: str = "kst") -> "Chain":
        return self.kst_raw(c, tag).scaled(f"{tag}_raw", tag)

    def roc(self, c: str = "close", tag: str = "roc") -> "Chain":
        self.rma({f"{tag}_a": (c, 8), f"{tag}_b": (c, 21)})
        self.step(f"CASE WHEN {tag}_b <> 0 THEN 100 * ({tag}_a - {tag}_b) / {tag}_b END AS {tag}_raw")
        return self.scaled(f"{tag}_raw", tag)

    def trend(self, c: str, out: str) -> "Chain":
        self.step(self.full(c, 20, "max", f"hi_{out}") + ", " + self.full(c, 20, "min", f"lo_{out}"))
        self.step(
            f"CASE WHEN hi_{out} <> lo_{out} THEN 180.0::DOUBLE / 3.14159265359::DOUBLE * atan(({c} - coalesce(lag({c}) OVER w, 0)) / (hi_{out} - lo_{out})) END AS an_{out}"
        )
        self.step(f"(-lag(an_{out}, 2) OVER w + 2 * lag(an_{out}) OVER w + 5 * an_{out}) / 6 AS sl_{out}")
        return self.step(
            f"CASE WHEN coalesce(sl_{out} >= 5.2::DOUBLE, false) OR coalesce({c} >= hi_{out}, false) THEN 1 "
            f"WHEN coalesce(sl_{out} <= -5.2::DOUBLE, false) OR coalesce({c} <= lo_{out}, false) THEN 2 ELSE 0 END AS {out}"
        )

    def machine(self, el: str, es: str, st: str, buy: str, sell: str, out: str) -> "Chain":
        """Bar-by-bar state machine as a recursive query."""
        t = f"{out}_{self.n}"
        self.parts.append(
            f"""f_{t} AS MATERIALIZED (SELECT symbol, bar, {el} AS el, {es} AS es, {st} AS st, {buy} AS buy, {sell} AS sell FROM {self.top}),
m_{t} AS (
  SELECT symbol, bar, (el OR es) AS act, buy AND (el OR es) AS lng, sell AND (el OR es) AS sht,
    CASE WHEN el THEN 3 WHEN es THEN 4 ELSE 0 END AS code FROM f_{t} WHERE bar = 1
  UNION ALL
  SELECT symbol, bar, act, buy AND act, sell AND act,
    CASE WHEN st AND pl THEN 5 WHEN st AND ps THEN 6 WHEN el AND NOT pa THEN 3 WHEN es AND NOT pa THEN 4
         WHEN buy AND act THEN 1 WHEN sell AND act THEN 2 ELSE 0 END
  FROM (SELECT f.*, p.act AS pa, p.lng AS pl, p.sht AS ps,
          CASE WHEN (el OR es) AND NOT p.act THEN true WHEN st THEN false ELSE p.act END AS act
        FROM m_{t} p JOIN f_{t} f ON f.symbol = p.symbol AND f.bar = p.bar + 1))"""
        )
        self.n += 1
        self.parts.append(
            f"s{self.n} AS MATERIALIZED (SELECT l.*, m.code AS {out} FROM {self.top} l JOIN m_{t} m USING (symbol, bar))"
        )
        self.top = f"s{self.n}"
        return self

    def osc(self, fast: str, sig: str, out: str, center: float = 0, short: bool = True) -> "Chain":
        self.trend(fast, f"t_{out}")
        self.step(
            f"(coalesce({fast} > {sig} AND lag({fast}) OVER w <= lag({sig}) OVER w, false) OR "
            f"coalesce({fast} < {sig} AND lag({fast}) OVER w >= lag({sig}) OVER w, false)) AS x_{out}, "
            f"(coalesce({fast} >= {sig}, false) AND coalesce({fast} >= {center}, false)) AS b_{out}, "
            f"(NOT coalesce({fast} >= {sig}, false) AND coalesce({fast} < {center}, false)) AS e_{out}"
        )
        return self.machine(
            f"(b_{out} AND t_{out} = 1)",
            f"(e_{out} AND t_{out} = 2 AND {'true' if short else 'false'})",
            f"(NOT (b_{out} OR e_{out}) OR x_{out})",
            f"b_{out}",
            f"e_{out}",
            out,
        )

    def ma_bundle(self) -> "Chain":
        self.rma({f"ma{i}": ("close", n) for i, n in enumerate((8, 21, 55, 233), 1)})
        return self.trend("ma1", "ma1_trend").trend("ma2", "ma2_trend")

    def signals(self) -> "Chain":
        self.rsi_osc().osc("rsi_fast", "rsi_sig", "rsi_code", 50)
        self.kst().osc("kst_fast", "kst_sig", "kst_code")
        self.kst("volume", "vol_kst").osc("vol_kst_fast", "vol_kst_sig", "vol_kst_code", 0, False)
        return self

    def final(self, long_ok: str, short_ok: str, allowed: str = "true", forced: str = "false", out: str = "code") -> "Chain":
        num = "CASE WHEN {c} IN (3, 1, 6) THEN 1 WHEN {c} IN (4, 2, 5) THEN -1 ELSE 0 END"
        self.step(f"{num.format(c='rsi_code')} + {num.format(c='kst_code')} AS cons")
        t = f"{out}_{self.n}"
        self.parts.append(
            f"""f_{t} AS MATERIALIZED (SELECT symbol, bar, cons > 0 AS buy, cons < 0 AS sell, cons = 0 AS neu,
    (cons = 2 AND {long_ok} AND {allowed} AND NOT {forced}) AS vl, (cons = -2 AND {short_ok} AND {allowed} AND NOT {forced}) AS vs, {forced} AS fx FROM {self.top}),
m_{t} AS (
  SELECT symbol, bar, (vl OR vs) AS act, vl AS lng, vs AS sht, CASE WHEN vl THEN 3 WHEN vs THEN 4 ELSE 0 END AS code
  FROM f_{t} WHERE bar = 1
  UNION ALL
  SELECT symbol, bar, CASE WHEN xl OR xs THEN false ELSE a1 END, lng, sht,
    CASE WHEN xl THEN 5 WHEN xs THEN 6 WHEN en_l THEN 3 WHEN en_s THEN 4 WHEN lng THEN 1 WHEN sht THEN 2 ELSE 0 END
  FROM (SELECT *, ((pl AND sell) OR (ps AND buy) OR fx) AND pl AND pa AS xl, ((pl AND sell) OR (ps AND buy) OR fx) AND ps AND pa AS xs
    FROM (SELECT *, a1 AND (buy OR (pl AND neu)) AS lng, a1 AND (sell OR (ps AND neu)) AS sht
      FROM (SELECT f.*, p.act AS pa, p.lng AS pl, p.sht AS ps, vl AND NOT p.act AS en_l, vs AND NOT p.act AS en_s, (vl AND NOT p.act) OR (vs AND NOT p.act) OR p.act AS a1
        FROM m_{t} p JOIN f_{t} f ON f.symbol = p.symbol AND f.bar = p.bar + 1))))"""
        )
        self.n += 1
        self.parts.append(f"s{self.n} AS MATERIALIZED (SELECT l.*, m.code AS {out} FROM {self.top} l JOIN m_{t} m USING (symbol, bar))")
        self.top = f"s{self.n}"
        return self

    def sql(self, select: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(p.strip() for p in self.parts) + f"\nSELECT {select.replace('TOP', self.top)}"


LONG_OK = "coalesce(ma1_trend = 1 AND close >= ma1, false)"
SHORT_OK = "coalesce(ma1_trend = 2 AND close <= ma1, false)"
TR_STEP = (
    "CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, "
    "abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr"
)
