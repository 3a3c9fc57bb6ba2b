"""DuckDB SQL that says what the registered queries say. Money is in integers of 1e-8."""

from __future__ import annotations

H1, H4 = 3_600_000_000, 14_400_000_000
AS_OF = 1_706_000_000_000_000
LENGTH, STEP, CONTEXT = 30, 10, 5

EV = "ev AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type AS symbol, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def _bars(dur: int, name: str = "b") -> str:
    return f"""{name} AS (SELECT symbol, (ts_us // {dur}) * {dur} AS open_us, arg_min(v, (ts_us, event_id)) AS o, max(v) AS h,
    min(v) AS l, arg_max(v, (ts_us, event_id)) AS c, count(*) AS n FROM ev GROUP BY 1, 2)"""


def _range(dur: int, bars: str = "b", name: str = "r") -> str:
    return f"{name} AS (SELECT symbol, min(open_us) AS lo, max(open_us) + {dur} AS hi FROM {bars} GROUP BY 1)"


def _grid(dur: int) -> str:
    return f"grid AS (SELECT symbol, unnest(range(lo, hi, {dur})) AS open_us FROM r)"


MISS = "miss AS (SELECT g.symbol, g.open_us FROM grid g LEFT JOIN b USING (symbol, open_us) WHERE b.symbol IS NULL)"
RUNS = f"""isl AS (SELECT *, open_us - row_number() OVER (PARTITION BY symbol ORDER BY open_us) * {H4} AS head FROM b),
runs AS (SELECT *, symbol || '|' || CAST(min(open_us) OVER (PARTITION BY symbol, head) AS VARCHAR) AS run_id FROM isl)"""
FUND = """fund AS (SELECT symbol, ts_us AS event_us, CASE WHEN event_id % 2 = 0 THEN 'Regular' ELSE 'Special' END AS rate_type,
    arg_min((event_id % 21 - 10), event_id) AS rate4, arg_min(100 + event_id % 7, event_id) AS ref FROM ev GROUP BY 1, 2, 3)"""
COV = "cov AS (SELECT symbol, ts_us AS s, ts_us + (1 + event_id % 90) * 60000000 AS e FROM ev)"
CUT = "cut AS (SELECT cov.symbol, lo, hi, greatest(s, lo) AS s, least(e, hi) AS e FROM cov JOIN r USING (symbol) WHERE e > lo AND s < hi)"
GAPS = """allc AS (SELECT symbol, lo, s, e FROM cut UNION ALL SELECT symbol, lo, hi, hi FROM r),
reach AS (SELECT *, max(e) OVER (PARTITION BY symbol ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM allc),
gaps AS (SELECT symbol, CASE WHEN m IS NULL THEN lo ELSE m END AS gap_start, s AS gap_end FROM reach WHERE s > CASE WHEN m IS NULL THEN lo ELSE m END)"""
TARGET = "CASE WHEN lag(c) OVER w IS NULL THEN 0 WHEN c > lag(c) OVER w THEN 1 ELSE -1 END"


def _ledger(source: str = "runs", keep: str = "", start: str = "TRUE", funding: str = "") -> str:
    """CTEs up to led, from bars with run_id in `source`."""
    join = "LEFT JOIN due USING (run_id, mark_us)" if funding else ""
    fsum = "coalesce(f, 0)" if funding else "0"
    has = "f" if funding else "NULL"
    return f"""{funding}tgt AS (SELECT *, {TARGET} AS target, open_us + {H4} AS mark_us FROM {source} WINDOW w AS (PARTITION BY run_id ORDER BY open_us)),
evl AS (SELECT * FROM tgt WHERE {start}),
pos AS (SELECT run_id, symbol, open_us, mark_us, o, c, target, 2 * coalesce(lag(target, 1) OVER w, 0) AS position,
    2 * coalesce(lag(target, 2) OVER w, 0) AS before FROM evl WINDOW w AS (PARTITION BY run_id ORDER BY open_us)),
fil AS (SELECT *, position - before AS delta, CASE WHEN position <> before THEN o END AS px, {has} AS f,
    CASE WHEN position <> before THEN abs(position - before) * o * 2500 ELSE 0 END AS tc, position * {fsum} AS fc FROM pos {join}),
led AS (SELECT *, 100000000000 - sum(delta * o * 1000000 + tc + fc) OVER u AS cash,
    100000000000 - sum(delta * o * 1000000 + tc + fc) OVER u + position * c * 1000000 AS equity,
    CASE WHEN position <> 0 THEN last_value(px IGNORE NULLS) OVER u END AS entry,
    CASE WHEN delta <> 0 AND before <> 0 THEN before * (o - last_value(px IGNORE NULLS) OVER p) * 1000000 ELSE 0 END AS realized,
    CASE WHEN delta = 0 THEN 0 WHEN before = 0 OR position = 0 THEN 1 ELSE 2 END AS trades
    FROM fil WINDOW u AS (PARTITION BY run_id ORDER BY open_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    p AS (PARTITION BY run_id ORDER BY open_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


DUE = f"""due AS (SELECT run_id, greatest(-((-event_us) // {H4} + CASE WHEN (-event_us) % {H4} < 0 THEN -1 ELSE 0 END) * {H4}, st + {H4}) AS mark_us, sum(rate4 * 10000 * ref) AS f
    FROM fund JOIN runs ON fund.symbol = runs.symbol AND runs.open_us = (event_us // {H4}) * {H4}
    JOIN (SELECT run_id, min(open_us) AS st FROM runs GROUP BY 1) USING (run_id) GROUP BY 1, 2),
"""
# the mark is the event's time rounded up to the grid
DUE = DUE.replace(f"-((-event_us) // {H4} + CASE WHEN (-event_us) % {H4} < 0 THEN -1 ELSE 0 END) * {H4}", f"((event_us + {H4} - 1) // {H4}) * {H4}")


def _m(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE) / 100000000, 6) AS {name}"


def _p(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE) / 100, 6) AS {name}"


B1, B4 = f"WITH {EV}, {_bars(H1)}", f"WITH {EV}, {_bars(H4)}"
R4 = f"{B4}, {RUNS}"
L4, L4F = f"{R4}, {_ledger()}", f"{R4}, {FUND}, {_ledger(funding=DUE)}"
EQ = "CAST(equity AS DOUBLE) / 100000000"
DRAW = f"""pk AS (SELECT *, greatest(1000.0, max({EQ}) OVER (PARTITION BY run_id ORDER BY open_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM led)"""
RETS = f"""rt AS (SELECT *, {EQ} / coalesce(lag({EQ}) OVER (PARTITION BY run_id ORDER BY open_us), 1000.0) - 1 AS ret,
    coalesce(lag({EQ}) OVER (PARTITION BY run_id ORDER BY open_us), 1000.0) AS den FROM led)"""
SUMMARY = f"""SELECT run_id, {_m("arg_max(cash, open_us)", "final_cash")}, {_m("arg_max(equity, open_us)", "final_equity")}, {_m("sum(realized)", "realized")},
    {_m("arg_max(CASE WHEN position = 0 THEN 0 ELSE position * (c - entry) * 1000000 END, open_us)", "unrealized")}, {_m("sum(tc + fc)", "total_cost")},
    CAST(arg_max(position, open_us) AS BIGINT) AS final_position, CAST(count_if(delta <> 0) AS BIGINT) AS fills, CAST(sum(trades) AS BIGINT) AS trades, count(*) AS bars FROM led GROUP BY 1"""


def _windows(context: int) -> str:
    return f"""rr AS (SELECT run_id AS run, min(open_us) AS lo, max(open_us) + {H4} AS hi FROM runs GROUP BY 1),
wi AS (SELECT run, lo + {context * H4} AS f0, unnest(range(0, (hi - lo - {(context + LENGTH) * H4}) // {STEP * H4} + 1)) AS window_idx FROM rr WHERE hi - lo >= {(context + LENGTH) * H4}),
win AS (SELECT run, window_idx, f0 + window_idx * {STEP * H4} AS start_us, f0 + window_idx * {STEP * H4} + {LENGTH * H4} AS end_us FROM wi)"""


def _window_bars(context: int) -> str:
    return f"""wb AS (SELECT run || '#' || CAST(window_idx AS VARCHAR) AS run_id, symbol, open_us, o, c, start_us FROM win JOIN runs ON runs.run_id = win.run AND open_us >= start_us - {context * H4} AND open_us < end_us)"""


def _window_figures() -> str:
    return f"""SELECT run_id, {_m("arg_max(equity, open_us)", "final_equity")}, CAST(count_if(delta <> 0) AS BIGINT) AS fills, CAST(sum(trades) AS BIGINT) AS trades, count(*) AS bars,
    round(arg_max({EQ}, open_us) / 1000.0 - 1, 6) AS total_return, round(max((peak - {EQ}) / peak), 6) AS max_drawdown FROM pk GROUP BY 1"""


def _rolling(context: int) -> str:
    return f"""{R4}, {_windows(context)}, {_window_bars(context)}, {_ledger("wb", start="open_us >= start_us")}, {DRAW} {_window_figures()}"""


def _text(number: str, places: int = 18) -> str:
    """An integer of so many places as plain decimal text."""
    digits = f"lpad(CAST(abs({number}) AS VARCHAR), {places + 1}, '0')"
    digits = f"CASE WHEN length(CAST(abs({number}) AS VARCHAR)) > {places + 1} THEN CAST(abs({number}) AS VARCHAR) ELSE {digits} END"
    return f"CASE WHEN {number} < 0 THEN '-' ELSE '' END || left({digits}, -{places}) || '.' || right({digits}, {places})"


def _ten(power: str) -> str:
    return f"CAST('1' || repeat('0', CAST({power} AS INT)) AS HUGEINT)"


def _report(dur: int, name: str) -> str:
    return f"""SELECT r.symbol, CAST((hi - lo) // {dur} AS BIGINT) AS expected, a.n AS actual, coalesce(m.n, 0) AS missing, CAST(0 AS BIGINT) AS unaligned, first_us, last_us,
    CASE WHEN coalesce(m.n, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, '{name}' AS timeframe
    FROM r JOIN (SELECT symbol, count(*) AS n, min(open_us) AS first_us, max(open_us) AS last_us FROM b GROUP BY 1) a USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) AS n FROM miss GROUP BY 1) m USING (symbol)"""


def _candles(dur: int) -> str:
    return f"WITH {EV}, {_bars(dur)} SELECT symbol, open_us, {_p('o', 'open')}, {_p('h', 'high')}, {_p('l', 'low')}, {_p('c', 'close')}, n AS volume FROM b"


MISS1 = f"{B1}, {_range(H1)}, {_grid(H1)}, {MISS}"
_LO, _HI = AS_OF - AS_OF % H1 - 240 * H1, AS_OF - AS_OF % H1
PAGES = f"""pg AS (SELECT *, ts_us // {H1} AS page_no FROM ev UNION ALL SELECT *, ts_us // {H1} + 1 FROM ev WHERE ts_us % {H1} >= 3000000000)"""

STATS = "a AS (SELECT run_id, avg(ret) AS m, stddev_samp(ret) AS s, count(*) AS n, min(den) > 0 AS ok FROM rt GROUP BY 1)"
STAGE2 = ", ".join(f"round(CASE WHEN ok AND n >= 2 AND s > 0 THEN {x} END, 6) AS {name}" for x, name in (("m", "mean_return"), ("s", "return_stdev"), ("m / s", "sharpe_ratio")))
STAGE1 = f"SELECT run_id, round(arg_max({EQ}, open_us) / 1000.0 - 1, 6) AS total_return, round(max((peak - {EQ}) / peak), 6) AS max_drawdown FROM pk GROUP BY 1"
FLAT = "CASE WHEN lag(c) OVER w IS NULL THEN 0 WHEN c > lag(c) OVER w THEN 1 WHEN lag(c, 2) OVER w IS NOT NULL AND c < lag(c) OVER w AND c < lag(c, 2) OVER w THEN -1 ELSE 0 END"
CROSS = "CASE WHEN c * n = t THEN 0 WHEN c * n > t THEN 1 ELSE -1 END"
SEEN = "PARTITION BY run_id ORDER BY open_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _flat(sql: str) -> str:
    return sql.replace(TARGET, FLAT)


def _rich(sql: str) -> str:
    """One unit, and an initial cash of 9973: no quotient ends at a tie."""
    return sql.replace("2 * coalesce(lag", "1 * coalesce(lag").replace("100000000000 -", "997300000000 -").replace("1000.0", "9973.0")


# a zero below zero is a zero
_PLUS = ", ".join(f"{c} + 0.0 AS {c}" for c in ("total_return", "max_drawdown", "mean_return", "return_stdev", "sharpe_ratio"))
SHIFT = f"b0 AS (SELECT * FROM b), b1 AS (SELECT symbol, open_us + CASE WHEN (open_us // {H1}) % 11 = 0 THEN 420000000 ELSE 0 END AS open_us FROM b)"
SOLVENT = _rich(_flat(f"{L4}, {DRAW}, {RETS}, {STATS}, s1 AS ({STAGE1}), s2 AS (SELECT run_id, {STAGE2}, n, ok, s FROM a)"))

ORACLES = {
    "candles_1h": _candles(H1),
    "candles_4h": _candles(H4),
    "grid_alignment": f"WITH {EV} SELECT event_id, ts_us % {H1} = 0 AS aligned, (ts_us // {H1}) * {H1} AS slot_us FROM ev",
    "availability": f"{B4} SELECT symbol, open_us, open_us + {H4} AS available_us, {AS_OF} >= open_us + {H4} AS available FROM b",
    "effective_end_clamp": f"""WITH {EV}, a AS (SELECT symbol, max(ts_us) AS as_of_us FROM ev GROUP BY 1)
SELECT symbol, as_of_us, (as_of_us // {H1}) * {H1} + {5 * H1} AS requested_end, least((as_of_us // {H1}) * {H1} + {5 * H1}, (as_of_us // {H1}) * {H1}) AS effective_end, CAST(5 AS BIGINT) AS excluded FROM a""",
    "finalized_filter": f"{B1} SELECT symbol, open_us, (open_us + {H1}) // 1000 - 1 AS close_ms FROM b WHERE {AS_OF} >= open_us + {H1}",
    "missing_slots": f"{MISS1} SELECT symbol, open_us FROM miss",
    "quality_report": f"""SELECT * FROM ({MISS1} {_report(H1, "1h")}) UNION ALL SELECT * FROM ({B4}, {_range(H4)}, {_grid(H4)}, {MISS} {_report(H4, "4h")})""",
    "quality_samples": f"""{MISS1} SELECT * FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY open_us) AS "rank", open_us FROM miss) WHERE "rank" <= 20""",
    "range_scan_half_open": f"{B1} SELECT symbol, open_us, {_p('c', 'close')} FROM b WHERE open_us >= {_LO} AND open_us < {_HI}",
    "event_scan_tie_order": f"""WITH {EV}, {FUND} SELECT symbol, event_us, rate_type, round(CAST(rate4 AS DOUBLE) / 10000, 6) AS funding_rate, row_number() OVER (PARTITION BY symbol, event_us ORDER BY rate_type) AS tie FROM fund""",
    "coverage_overlap": f"""{B4}, {_range(H4)}, {COV}, {CUT} SELECT symbol, count(*) AS intervals, CAST(sum(e - s) AS BIGINT) AS covered_us, min(s) AS first_us, max(e) AS last_us FROM cut GROUP BY 1""",
    "coverage_gaps": f"{B4}, {_range(H4)}, {COV}, {CUT}, {GAPS} SELECT * FROM gaps",
    "funding_quality": f"""{B4}, {_range(H4)}, {FUND}, {COV}, {CUT}, {GAPS} SELECT r.symbol, coalesce(n, 0) AS event_count, coalesce(k, 0) AS gap_count, coalesce(u, 0) AS gap_us, CASE WHEN coalesce(k, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM r LEFT JOIN (SELECT fund.symbol, count(*) AS n FROM fund JOIN r ON fund.symbol = r.symbol AND event_us >= lo AND event_us < hi GROUP BY 1) a USING (symbol)
LEFT JOIN (SELECT symbol, count(*) AS k, CAST(sum(gap_end - gap_start) AS BIGINT) AS u FROM gaps GROUP BY 1) g USING (symbol)""",
    "batch_classify": """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_quantity * 100) AS BIGINT) AS q FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min((l_partkey, q)) AS lo, max((l_partkey, q)) AS hi FROM t GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, n AS "rows", CASE WHEN lo <> hi THEN 'conflict' WHEN l_linenumber <= 3 THEN 'duplicate' ELSE 'new' END AS status FROM g""",
    "cross_page_dedup": f"""WITH {EV}, {PAGES}, p AS (SELECT symbol, ts_us, user_id, page_no, count(*) AS n, min(v) AS lo, max(v) AS hi FROM pg GROUP BY 1, 2, 3, 4),
k AS (SELECT symbol, ts_us, user_id, max(n) AS most, min(lo) AS lo, max(hi) AS hi, count(*) AS pages FROM p GROUP BY 1, 2, 3)
SELECT symbol, CASE WHEN most > 1 THEN 'page_duplicate' WHEN lo <> hi THEN 'conflict' ELSE 'ok' END AS status, count(*) AS keys, CAST(sum(pages) AS BIGINT) AS pages FROM k GROUP BY 1, 2""",
    "page_order": f"""WITH {EV}, {PAGES}, o AS (SELECT page_no, lag(ts_us) OVER (PARTITION BY page_no ORDER BY event_id) > ts_us AS bad FROM pg)
SELECT page_no, coalesce(CAST(count_if(bad) AS BIGINT), 0) AS faults FROM o GROUP BY 1""",
    "order_contiguity_check": f"""{B1}, o AS (SELECT *, lag(open_us) OVER (PARTITION BY symbol ORDER BY open_us) AS p FROM b) SELECT symbol, count(*) AS bars, CAST(count_if(p >= open_us) AS BIGINT) AS not_ascending, CAST(count_if(p + {H1} <> open_us) AS BIGINT) AS gaps FROM o GROUP BY 1""",
    "positions": f"{L4} SELECT run_id, open_us, CAST(target AS BIGINT) AS target, CAST(position AS BIGINT) AS position, CAST(delta AS BIGINT) AS delta FROM led",
    "fills": f"{L4} SELECT run_id, open_us, CAST(delta AS BIGINT) AS delta, {_p('px', 'fill_price')}, {_m('tc', 'cost')}, CAST(trades AS BIGINT) AS trades FROM led WHERE delta <> 0",
    "cost_components": f"{L4} SELECT run_id, {_m('sum(abs(delta) * o * 1000)', 'commission')}, {_m('sum(abs(delta) * o * 500)', 'half_spread')}, {_m('sum(abs(delta) * o * 1000)', 'slippage')}, {_m('sum(tc)', 'total')} FROM led WHERE delta <> 0 GROUP BY 1",
    "trade_counts": f"{L4} SELECT symbol, CAST(sum(trades) AS BIGINT) AS trades, CAST(count_if(delta <> 0) AS BIGINT) AS fills FROM led GROUP BY 1",
    "funding_asof": f"{L4F} SELECT run_id, mark_us, CAST(position AS BIGINT) AS position, {_m('f', 'funding')}, {_m('fc', 'funding_cost')} FROM led WHERE f IS NOT NULL",
    "equity_curve": f"{L4F} SELECT run_id, mark_us, {_m('cash', 'cash')}, {_m('equity', 'equity')} FROM led",
    "backtest_summary": f"{L4F} {SUMMARY}",
    "pnl_reconciliation": f"""{L4F} SELECT run_id, arg_max(equity, open_us) - 100000000000 = sum(realized) + arg_max(CASE WHEN position = 0 THEN 0 ELSE position * (c - entry) * 1000000 END, open_us) - sum(tc + fc) AS balanced,
{_m("arg_max(equity, open_us) - 100000000000", "total_pnl")} FROM led GROUP BY 1""",
    "context_evaluation": f"""{R4}, rs AS (SELECT *, min(open_us) OVER (PARTITION BY run_id) + {CONTEXT * H4} AS st FROM runs), {_ledger("rs", start="open_us >= st")}
SELECT run_id, open_us, CAST(target AS BIGINT) AS target, CAST(position AS BIGINT) AS position, {_m("equity", "equity")} FROM led""",
    "periodic_returns": f"{L4}, {RETS} SELECT run_id, open_us, round(CASE WHEN den > 0 THEN ret END, 6) AS ret, den <= 0 AS bad_denominator FROM rt",
    "drawdown_curve": f"{L4}, {DRAW} SELECT run_id, open_us, round(peak, 6) AS peak, round((peak - {EQ}) / peak, 6) AS drawdown FROM pk",
    "stage1_metrics": f"{L4}, {DRAW} SELECT run_id, round(arg_max({EQ}, open_us) / 1000.0 - 1, 6) AS total_return, round(max((peak - {EQ}) / peak), 6) AS max_drawdown FROM pk GROUP BY 1",
    "stage2_metrics": f"{L4}, {RETS}, {STATS} SELECT run_id, {STAGE2} FROM a",
    "is_oos_split": f"{R4}, {_windows(0)} SELECT run, window_idx, start_us, start_us + {20 * H4} AS cut_us, end_us, TRUE AS valid FROM win",
    "rolling_zero_context": _rolling(0),
    "rolling_context_aware": _rolling(CONTEXT),
    "transport_bounds": f"""WITH {EV}, u AS (SELECT event_id, ts_us + event_id % 3 AS us FROM ev) SELECT event_id, us // 1000 AS start_ms, (us + 999) // 1000 AS end_ms, CASE WHEN us % 1000 = 0 THEN us // 1000 END AS exact_ms FROM u""",
    "kline_parse": f"""WITH {EV} SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'number' WHEN 2 THEN 'high_low' WHEN 3 THEN 'fields' ELSE 'ok' END AS reject,
CASE WHEN event_id % 7 NOT IN (1, 2, 3) THEN (ts_us // {H1}) * {H1} END AS open_us, CASE WHEN event_id % 7 NOT IN (1, 2, 3) THEN round(CAST(v AS DOUBLE) / 100, 6) END AS close FROM ev""",
    "funding_parse": f"""WITH {EV} SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'rate' WHEN 2 THEN 'price' WHEN 3 THEN 'rate_type' WHEN 4 THEN 'symbol' ELSE 'ok' END AS reject,
CASE WHEN event_id % 6 IN (0, 5) THEN (ts_us // 1000) * 1000 END AS event_us, CASE WHEN event_id % 6 IN (0, 5) THEN CAST(100 + event_id % 50 AS DOUBLE) END AS reference_price FROM ev""",
    "kline_parse_six": f"""WITH {EV} SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'fields' WHEN 2 THEN 'number' ELSE 'ok' END AS reject,
CASE WHEN event_id % 5 NOT IN (1, 2) THEN (ts_us // {H1}) * {H1} END AS open_us, CAST(NULL AS BIGINT) AS close_ms FROM ev""",
    "kline_close_time": f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'ok' ELSE 'close_time' END AS reject, CASE WHEN event_id % 4 = 0 THEN (ts_us // {H1}) * 3600000 + 3599999 END AS close_ms FROM ev""",
    "flat_fills": _flat(f"{L4} SELECT run_id, open_us, CAST(before AS BIGINT) AS before, CAST(position AS BIGINT) AS position, {_m('tc', 'cost')}, {_m('realized', 'realized')}, CAST(trades AS BIGINT) AS trades FROM led WHERE delta <> 0"),
    "unaligned_report": f"""{B1}, {_range(H1)}, {_grid(H1)}, {SHIFT},
x AS (SELECT symbol, count(*) AS actual, count_if(open_us % {H1} <> 0) AS unaligned, min(open_us) AS first_us, max(open_us) AS last_us FROM b1 GROUP BY 1),
y AS (SELECT symbol, count(*) AS missing FROM grid WHERE (symbol, open_us) NOT IN (SELECT symbol, open_us FROM b1) GROUP BY 1)
SELECT r.symbol, CAST((hi - lo) // {H1} AS BIGINT) AS expected, actual, coalesce(missing, 0) AS missing, CAST(unaligned AS BIGINT) AS unaligned, first_us, last_us,
CASE WHEN coalesce(missing, 0) > 0 OR unaligned > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM r JOIN x USING (symbol) LEFT JOIN y USING (symbol)""",
    "unaligned_samples": f"""{B1}, {SHIFT} SELECT * FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY open_us) AS "rank", open_us FROM b1 WHERE open_us % {H1} <> 0) WHERE "rank" <= 20""",
    "gap_samples": f"""{B4}, {_range(H4)}, {COV}, {CUT}, {GAPS} SELECT * FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY gap_start) AS "rank", gap_start, gap_end FROM gaps) WHERE "rank" <= 20""",
    "order_violations": f"""WITH {EV}, o AS (SELECT symbol, event_id, (ts_us // {H1}) * {H1} AS t FROM ev), r AS (SELECT symbol, min(t) AS lo, max(t) + {H1} - {24 * H1} AS hi FROM o GROUP BY 1),
p AS (SELECT o.symbol, t, lo, hi, lag(t) OVER (PARTITION BY o.symbol ORDER BY event_id) AS q FROM o JOIN r USING (symbol))
SELECT symbol, CAST(count_if(t < lo OR t >= hi) AS BIGINT) AS out_of_range, CAST(count_if(q = t) AS BIGINT) AS repeated, CAST(count_if(q > t) AS BIGINT) AS backward FROM p GROUP BY 1""",
    "backward_order_check": f"""{B1}, o AS (SELECT *, lag(open_us) OVER (PARTITION BY symbol ORDER BY open_us - (n % 3) * {5 * H1}, open_us) AS p FROM b)
SELECT symbol, count(*) AS bars, CAST(count_if(p >= open_us) AS BIGINT) AS not_ascending, CAST(count_if(p + {H1} <> open_us) AS BIGINT) AS gaps FROM o GROUP BY 1""",
    "event_order_faults": f"""WITH {EV}, {FUND}, o AS (SELECT *, (event_us, rate_type) AS k, lag((event_us, rate_type)) OVER (PARTITION BY symbol ORDER BY event_us // {H4}, rate4, ref, event_us, rate_type) AS p FROM fund)
SELECT symbol, count(*) AS events, CAST(count_if(p > k) AS BIGINT) AS backward, CAST(count_if(p = k) AS BIGINT) AS repeated FROM o GROUP BY 1""",
    "page_disorder": f"""WITH {EV}, {PAGES}, o AS (SELECT page_no, lag(ts_us) OVER (PARTITION BY page_no ORDER BY (event_id * 7919) % 101, event_id) > ts_us AS bad FROM pg)
SELECT page_no, coalesce(CAST(count_if(bad) AS BIGINT), 0) AS faults FROM o GROUP BY 1""",
    "effective_ends": f"""WITH {EV}, e AS (SELECT event_id, ts_us AS as_of_us, (ts_us // {H1}) * {H1} + (event_id % 9 - 3) * {H1} AS requested_end, (ts_us // {H1}) * {H1} AS closed FROM ev)
SELECT event_id, as_of_us, requested_end, least(requested_end, closed) AS effective_end, (requested_end - least(requested_end, closed)) // {H1} AS excluded FROM e""",
    "split_checks": f"""{R4}, {_windows(0)}, q AS (SELECT run, window_idx, start_us AS is_start, start_us + {20 * H4} + CASE window_idx % 5 WHEN 1 THEN 1 WHEN 2 THEN {5 * H4} ELSE 0 END AS is_end,
start_us + CASE WHEN window_idx % 5 = 3 THEN {30 * H4} ELSE {22 * H4} END AS oos_start, end_us AS oos_end FROM win)
SELECT *, CASE WHEN is_end % {H4} <> 0 THEN 'grid' WHEN oos_start >= oos_end THEN 'empty' WHEN is_end > oos_start THEN 'order' END AS fault FROM q""",
    "solvent_metrics": f"{SOLVENT} SELECT run_id, {_PLUS} FROM s1 JOIN s2 USING (run_id)",
    "exact_metrics": f"""{SOLVENT} SELECT run_id, {_PLUS.replace("total_return + 0.0", "CASE WHEN n >= 2 AND s > 0 THEN total_return + 0.0 END").replace("max_drawdown + 0.0", "CASE WHEN n >= 2 AND s > 0 THEN max_drawdown + 0.0 END")},
CASE WHEN n < 2 THEN 'at least two returns are needed' WHEN s <= 0 THEN 'the deviation must be positive' END AS fault FROM s1 JOIN s2 USING (run_id)""",
    "policy_targets": f"{R4}, q AS (SELECT run_id, open_us, c, sum(c) OVER ({SEEN}) AS t, count(*) OVER ({SEEN}) AS n FROM runs) SELECT run_id, open_us, CAST({CROSS} AS BIGINT) AS target FROM q",
    "python_cost": f"{L4} SELECT run_id, open_us, {_m('tc', 'cost')} FROM led WHERE delta <> 0",
    "store_range_query": f"{B1} SELECT symbol, open_us, {_p('c', 'close')} FROM b WHERE open_us >= {_LO} AND open_us < {_HI}",
    "store_events": f"""{B4}, {_range(H4)}, {FUND}, z AS (SELECT min(lo) + (max(hi) - min(lo)) // 4 AS s, max(hi) - (max(hi) - min(lo)) // 4 AS e FROM r),
h AS (SELECT symbol, lo AS a, lo + (hi - lo) // 2 AS b FROM r UNION ALL SELECT symbol, lo + (hi - lo) // 2, hi FROM r)
SELECT symbol, 'event' AS kind, count(*) AS "rows", min(event_us) AS first_us, max(event_us) AS last_us FROM fund, z WHERE event_us >= s AND event_us < e GROUP BY 1
UNION ALL SELECT symbol, 'coverage', count(*), min(a), max(b) FROM h, z WHERE b > s AND a < e GROUP BY 1""",
    "store_ingest": f"""{B1} SELECT symbol, open_us, {_p('o', 'open')}, {_p('c', 'close')}, round(CAST(n AS DOUBLE), 6) AS volume FROM b WHERE open_us < (SELECT max(open_us) FROM b) - {9 * H1}""",
    "store_quality": f"SELECT * EXCLUDE (timeframe) FROM ({B4}, {_range(H4)}, {_grid(H4)}, {MISS} {_report(H4, '4h')})",
    "store_backtest": f"""{R4}, {FUND}, lb AS (SELECT * FROM (SELECT *, min(open_us) OVER p + {CONTEXT * H4} AS st0, count(*) OVER p AS bars_in FROM runs WINDOW p AS (PARTITION BY run_id)) WHERE bars_in > {CONTEXT}),
{_ledger("lb", start="open_us >= st0", funding=f"""due AS (SELECT run_id, greatest(((event_us + {H4} - 1) // {H4}) * {H4}, st0 + {H4}) AS mark_us, sum(rate4 * 10000 * ref) AS f
FROM fund JOIN lb ON fund.symbol = lb.symbol AND lb.open_us = (event_us // {H4}) * {H4} WHERE event_us >= st0 GROUP BY 1, 2),
""")} {SUMMARY}""",
    "store_rolling": f"""{R4}, {_windows(CONTEXT)}, num AS (SELECT run || '#' || CAST(window_idx AS VARCHAR) AS run_id, split_part(run, '|', 1) AS symbol, row_number() OVER (PARTITION BY split_part(run, '|', 1) ORDER BY start_us) AS k FROM win),
{_window_bars(CONTEXT)}, {_ledger("wb", start="open_us >= start_us")}, {DRAW}, got AS ({_window_figures()})
SELECT num.symbol, CAST(k AS BIGINT) AS window_idx, final_equity, fills, trades, bars, total_return, max_drawdown FROM got JOIN num USING (run_id)""",
    "range_overlaps": f"""{B1}, {COV}, q AS (SELECT symbol, open_us AS lo, open_us + {6 * H1} AS hi FROM b)
SELECT q.symbol, lo AS start_us, count(*) AS intervals, CAST(sum(least(e, hi) - greatest(s, lo)) AS BIGINT) AS covered_us FROM q JOIN cov ON cov.symbol = q.symbol AND e > lo AND s < hi GROUP BY 1, 2""",
    "range_gaps": f"""{B1}, {COV}, r AS (SELECT symbol, open_us AS lo, open_us + {6 * H1} AS hi FROM b), {CUT}, {GAPS.replace("PARTITION BY symbol ORDER", "PARTITION BY symbol, lo ORDER").replace("SELECT symbol, CASE", "SELECT symbol, lo, CASE")}
SELECT symbol, lo AS start_us, gap_start, gap_end FROM gaps""",
    "funding_marks": f"""WITH {EV}, {FUND}, m AS (SELECT DISTINCT symbol, ts_us + CASE WHEN event_id % 7 = 1 THEN 1234567 ELSE 0 END AS mark_us FROM ev WHERE event_id % 7 < 2)
SELECT f.symbol, m.mark_us, count(*) AS events, {_m("sum(rate4 * 10000 * ref)", "funding")} FROM fund f ASOF JOIN m ON f.symbol = m.symbol AND f.event_us <= m.mark_us GROUP BY 1, 2""",
    "fine_costs": f"""WITH {EV}, t AS (SELECT symbol, CAST(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS HUGEINT) * ((user_id % 97) * 1000000000000 + event_id * 104729 % 1000000000000)
  * CASE WHEN v < 0 THEN v::HUGEINT * 10000000000 - event_id * 7919 % 10000000000 ELSE v::HUGEINT * 10000000000 + event_id * 7919 % 10000000000 END * 1234567 AS term FROM ev)
SELECT symbol, count(*) AS terms, CAST(count_if(term > 5000000000000000000000000000000000::HUGEINT) AS BIGINT) AS above, {_text("sum(term)", 34)} AS total FROM t GROUP BY 1""",
    "money_text": f"""{R4}, fine AS (SELECT run_id, symbol, open_us, o::HUGEINT * 1000000 + (open_us // 1000000) % 99991 AS o, c::HUGEINT * 1000000 + (open_us // 1000000) % 99991 + 3 AS c FROM runs),
{_ledger("fine").replace("100000000000 -", "{start} -").replace("1000000", "10000000000").replace("* 2500", "* 1234567").replace("{start}", "1000000000000000000000::HUGEINT")}
SELECT run_id, open_us, {_text("CAST(tc AS HUGEINT)")} AS cost, {_text("CAST(cash AS HUGEINT)")} AS cash, {_text("CAST(equity AS HUGEINT)")} AS equity FROM led""",
    "exact_digits": f"""{_rich(_flat(L4))}, c AS (SELECT run_id, open_us, CAST(equity AS HUGEINT) AS x, coalesce(lag(CAST(equity AS HUGEINT)) OVER w, 997300000000::HUGEINT) AS b,
  greatest(997300000000::HUGEINT, max(CAST(equity AS HUGEINT)) OVER w) AS p FROM led WINDOW w AS (PARTITION BY run_id ORDER BY open_us)),
f AS (SELECT run_id, 'ret' AS what, open_us, x AS n, b AS d FROM c UNION ALL SELECT run_id, 'drop', open_us, p - x, p FROM c UNION ALL SELECT run_id, 'all', max(open_us), arg_max(x, open_us), 997300000000::HUGEINT FROM c GROUP BY 1),
g AS (SELECT *, length(CAST(n AS VARCHAR)) - length(CAST(d AS VARCHAR)) AS k FROM f),
h AS (SELECT *, CASE WHEN n * {_ten("greatest(-k, 0)")} >= d * {_ten("greatest(k, 0)")} THEN 27 - k ELSE 28 - k END AS e FROM g),
i AS (SELECT *, n * {_ten("e - 14")} // d AS q1, n * {_ten("e - 14")} % d AS r1 FROM h),
j AS (SELECT *, q1 * 100000000000000 + r1 * 100000000000000 // d AS q0, r1 * 100000000000000 % d AS r2 FROM i),
v AS (SELECT run_id, what, e, q0 + CASE WHEN 2 * r2 > d OR (2 * r2 = d AND q0 % 2 = 1) THEN 1 ELSE 0 END AS q FROM j),
m AS (SELECT run_id, count(*) AS n, sum((q - {_ten("e")}) * {_ten("28 - e")}) AS s, count(DISTINCT (q - {_ten("e")}) * {_ten("28 - e")}) AS kinds FROM v WHERE what = 'ret' GROUP BY 1),
u AS (SELECT *, abs(CAST(s AS HUGEINT)) AS a, 28 - length(CAST(abs(CAST(s AS HUGEINT)) // n AS VARCHAR)) AS e FROM m WHERE n >= 2 AND kinds > 1),
w AS (SELECT *, a * {_ten("e")} // n AS q0, a * {_ten("e")} % n AS r FROM u),
x AS (SELECT run_id, (q0 + CASE WHEN 2 * r > n OR (2 * r = n AND q0 % 2 = 1) THEN 1 ELSE 0 END) * {_ten("10 - e")} * CASE WHEN s < 0 THEN -1 ELSE 1 END AS mean FROM w)
SELECT x.run_id, {_text("(SELECT CAST((q - " + _ten("e") + ") * " + _ten("38 - e") + " AS HUGEINT) FROM v WHERE v.run_id = x.run_id AND what = 'all')", 38)} AS total_return, {_text("mean", 38)} AS mean_return,
  {_text("(SELECT max(q * " + _ten("38 - e") + ") FROM v WHERE v.run_id = x.run_id AND what = 'drop')", 38)} AS max_drawdown FROM x""",
    "metric_faults": f"""{_rich(_flat(L4))}, c AS (SELECT run_id, open_us, (CAST(equity AS BIGINT) + 500000) // 1000000 AS x, (CAST(split_part(run_id, '|', 2) AS BIGINT) // {H4}) % 6 AS kind,
  (open_us - CAST(split_part(run_id, '|', 2) AS BIGINT)) // {H4} AS i, count(*) OVER (PARTITION BY run_id) AS n FROM led),
d AS (SELECT *, CASE WHEN kind = 4 THEN 997300 ELSE x END AS y FROM c),
e AS (SELECT *, y::DOUBLE / lag(y, 1, 997300) OVER (PARTITION BY run_id ORDER BY open_us) AS q FROM d),
g AS (SELECT run_id, any_value(kind) AS kind, any_value(n) AS n, max(CASE WHEN i = 1 THEN x END) AS one, count(DISTINCT q) AS kinds FROM e GROUP BY 1)
SELECT run_id, CASE WHEN kind = 1 AND n > 2 THEN 'equity at 2 must be finite: NaN' WHEN kind = 3 AND n > 3 THEN 'equity at 3 must be finite: none' WHEN kind = 5 AND n > 4 THEN 'the curve''s times must ascend'
WHEN kind = 3 AND n > 2 THEN 'equity at 1 is the denominator of return 2 and must be positive: 0' WHEN kind = 2 AND n > 2 THEN 'equity at 1 is the denominator of return 2 and must be positive: -' || (one // 100) || '.' || lpad(CAST(one % 100 AS VARCHAR), 2, '0')
WHEN n < 2 THEN 'at least two returns are needed' WHEN kinds = 1 AND NOT (kind IN (2, 3) AND n = 2) THEN 'the deviation must be positive' END AS fault FROM g""",
    "full_report": f"""{B1}, {_range(H1)}, {SHIFT}, q AS (SELECT symbol, lo, hi + {5 * H1} AS ask, hi - {3 * H1} + 420000000 AS as_of_us, hi - {3 * H1} AS eff FROM r),
i AS (SELECT b1.* FROM b1 JOIN q USING (symbol) WHERE open_us >= lo AND open_us < eff), grid AS (SELECT symbol, unnest(range(lo, eff, {H1})) AS open_us FROM q),
x AS (SELECT symbol, count(*) AS actual, count_if(open_us % {H1} <> 0) AS unaligned, min(open_us) AS first_us, max(open_us) AS last_us, string_agg(CAST(open_us AS VARCHAR), ',' ORDER BY open_us) FILTER (open_us % {H1} <> 0 AND k <= 20) AS us
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, open_us % {H1} <> 0 ORDER BY open_us) AS k FROM i) GROUP BY 1),
y AS (SELECT symbol, count(*) AS missing, string_agg(CAST(open_us AS VARCHAR), ',' ORDER BY open_us) FILTER (k <= 20) AS ms FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_us) AS k FROM grid WHERE (symbol, open_us) NOT IN (SELECT symbol, open_us FROM i)) GROUP BY 1)
SELECT 'binance' AS exchange, 'spot' AS market_type, '1h' AS timeframe, symbol, lo AS requested_start, ask AS requested_end, as_of_us, eff AS effective_end, first_us, last_us, (eff - lo) // {H1} AS expected, actual,
  coalesce(missing, 0) AS missing, coalesce(ms, '') AS missing_samples, CAST(unaligned AS BIGINT) AS unaligned, coalesce(us, '') AS unaligned_samples, CAST(8 AS BIGINT) AS excluded_tail, CASE WHEN coalesce(missing, 0) > 0 OR unaligned > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM q JOIN x USING (symbol) LEFT JOIN y USING (symbol)""",
    "dataset_checks": f"""{R4}, k AS (SELECT run_id, count(*) AS n, (CAST(split_part(run_id, '|', 2) AS BIGINT) // {H4}) % 5 AS kind FROM runs GROUP BY 1)
SELECT run_id, CASE WHEN kind = 3 AND n > 1 THEN 'symbol' WHEN kind = 2 AND n > 1 THEN 'ascending' WHEN kind = 1 AND n > 2 THEN 'adjoining' WHEN kind = 4 THEN 'available' END AS fault FROM k""",
    "event_input_checks": f"""{R4}, {FUND}, k AS (SELECT run_id, count(*) AS n, (CAST(split_part(run_id, '|', 2) AS BIGINT) // {H4}) % 4 AS kind FROM fund JOIN runs ON fund.symbol = runs.symbol AND runs.open_us = (event_us // {H4}) * {H4} GROUP BY 1)
SELECT run_id, CASE WHEN kind = 1 THEN 'outside' WHEN kind = 2 AND n > 1 THEN 'order' WHEN kind = 3 THEN 'repeated' END AS fault FROM k""",
    "evaluation_checks": f"""{R4}, k AS (SELECT run_id, min(open_us) AS lo, max(open_us) + {H4} AS hi FROM runs GROUP BY 1), a AS (SELECT *, lo + unnest([{-H4}, 0, 1, {H4}, {30 * H4}]) AS at_us FROM k)
SELECT run_id, at_us, CASE WHEN at_us % {H4} <> 0 THEN 'grid' WHEN at_us < lo OR at_us >= hi THEN 'range' END AS fault FROM a""",
    "request_checks": f"""WITH {EV}, q AS (SELECT event_id, event_id % 11 = 0 AS none, symbol || '%2F%2B+' AS name, event_id % 1003 AS n, CASE WHEN event_id % 5 <> 0 THEN ts_us // 1000 END AS a FROM ev),
f AS (SELECT *, a + event_id % 7 * 1000 - 1000 AS b, CASE WHEN none THEN 'name' WHEN n NOT BETWEEN 1 AND 1000 THEN 'limit' WHEN event_id % 7 = 0 AND a IS NOT NULL THEN 'bounds' END AS fault FROM q)
SELECT event_id, fault, CASE WHEN fault IS NULL THEN 'https://host/klines?symbol=' || name || '&interval=1h&limit=' || n || coalesce('&startTime=' || a, '') || coalesce('&endTime=' || b, '') END AS url FROM f""",
    "instants": f"""WITH {EV}, t AS (SELECT event_id, ts_us - event_id % 100 * 100003 * {H1} AS us, v * (event_id % 5) AS n FROM ev)
SELECT event_id, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS instant, us AS back_us,
  CASE WHEN n < 0 THEN '-' ELSE '' END || abs(n) // 100 || CASE WHEN n % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(n) % 100 AS VARCHAR), 2, '0'), '0') END AS text FROM t""",
    "crossing_backtest": f"{R4}, seen AS (SELECT run_id, symbol, open_us, o, c, sum(c) OVER ({SEEN}) AS t, count(*) OVER ({SEEN}) AS n FROM runs), {_ledger('seen').replace(TARGET, CROSS)} SELECT run_id, open_us, CAST(target AS BIGINT) AS target, {_m('cash', 'cash')}, {_m('equity', 'equity')} FROM led",
}
