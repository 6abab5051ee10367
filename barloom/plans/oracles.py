"""DuckDB SQL of the catalogue's queries: a chain of named steps and one projection for each query."""

from __future__ import annotations

import math
import re

from barloom.operators import features
from barloom.operators.stats import EULER, NEAR, NORMAL, POISSON, PRIME, TAIL, A, B, C

SEQ = "PARTITION BY ticker, seq_id ORDER BY ts"
TICKER = "PARTITION BY ticker ORDER BY ts"


def last(n: int, p: str = SEQ) -> str:
    return f"OVER ({p} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def bars_of(unit: str, ticker: str = "event_type", source: str = "events") -> str:
    return f"""SELECT {ticker} AS ticker, time_bucket(INTERVAL {unit}, ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM {source} GROUP BY 1, 2"""


def seq_of(bars: str, unit: str, by_day: bool = False) -> str:
    day = " AND lag(ts) OVER (PARTITION BY ticker ORDER BY ts)::DATE = ts::DATE" if by_day else ""
    return f"""SELECT *, row_number() OVER (PARTITION BY ticker, seq_id ORDER BY ts) - 1 AS idx FROM (
        SELECT *, sum(brk) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS seq_id FROM (
        SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY ticker ORDER BY ts) = ts - INTERVAL {unit}{day} THEN 0 ELSE 1 END AS brk FROM {bars}))"""


def base_of(seq: str) -> str:
    avg5 = f"avg(volume) {last(5)}"
    return f"""SELECT *, (high - low) / s AS candle_range, (close - open) / s AS candle_body, (high - greatest(open, close)) / s AS upper_wick,
        (least(open, close) - low) / s AS lower_wick, close / lag(close, 3) OVER ({SEQ}) - 1 AS short_term_momentum,
        stddev_pop(log_return) {last(5)} AS rolling_volatility, CASE WHEN {avg5} > 0 THEN volume / {avg5} ELSE 0 END AS relative_volume
        FROM (SELECT *, CASE WHEN open > 0 THEN open ELSE 1 END AS s, coalesce(ln(close / lag(close) OVER ({SEQ})), 0) AS log_return FROM {seq})"""


def labelled_of(feat: str) -> str:
    return f"""SELECT *, CASE WHEN r > 0.0005 THEN 2 WHEN r < -0.0005 THEN 0 ELSE 1 END AS threshold_label,
        CASE WHEN r > vol_threshold THEN 2 WHEN r < -vol_threshold THEN 0 ELSE 1 END AS vol_direction_label, (r > 0)::INT AS label,
        (abs(r) > event_threshold)::INT AS event_label
        FROM (SELECT *, 0.5 * greatest(past_std, 1e-8) AS vol_threshold, greatest(event_std, 1e-8) AS event_threshold
        FROM (SELECT *, ln(next_close / close) AS r FROM (SELECT *, lead(close) OVER ({SEQ}) AS next_close, stddev_pop(log_return) {last(20)} AS past_std,
        avg(log_return) {last(20)} AS past_mean, stddev_pop(log_return) {last(78)} AS event_std FROM {feat}) WHERE next_close IS NOT NULL))"""


def zscore(c: str, by: str = "ts") -> str:
    w = f"OVER (PARTITION BY {by})"
    return f"CASE WHEN min({c}) {w} = max({c}) {w} THEN 0 ELSE ({c} - avg({c}) {w}) / nullif(stddev_pop({c}) {w}, 0) END"


def rank01(c: str) -> str:
    w = "OVER (PARTITION BY ts)"
    return f"CASE WHEN count(*) {w} = 1 OR min({c}) {w} = max({c}) {w} THEN 0.5 ELSE (row_number() OVER (PARTITION BY ts ORDER BY {c}, ticker) - 1) / nullif(count(*) {w} - 1, 0) END"


def executed(signal: str) -> str:
    """From ps (predictions with signal inputs): positions, turnover and returns."""
    return f"""SELECT *, position * (next_close - close) / close AS gross, position * (next_close - close) / close - 1.5 / 1e4 * turnover AS net
        FROM (SELECT *, abs(position - lag(position, 1, 0) OVER (ORDER BY row_id))::DOUBLE AS turnover FROM (
        SELECT *, lag(signal, 1, 0) OVER (ORDER BY row_id) AS position FROM (SELECT *, {signal} AS signal FROM ps)))"""


def by_sign(score: str) -> str:
    return f"(CASE WHEN {score} > 0 THEN 1 WHEN {score} < 0 THEN -1 ELSE 0 END)"


def in_top(share: float, key: str) -> str:
    return f"(row_number() OVER (ORDER BY {key} DESC, row_id) <= greatest(1, floor(count(*) OVER () * {share})))"


EDGE = "(p_up - p_down)"
BLEND = "(0.5 * (p_up - p_down) + 0.5 * mu)"
TOP = f"CASE WHEN {in_top(0.4, f'abs({EDGE})')} THEN {by_sign(EDGE)} ELSE 0 END"
AGREED = f"CASE WHEN {by_sign(BLEND)} = (CASE WHEN p_up >= p_down THEN 1 ELSE -1 END) AND {in_top(0.4, f'abs({BLEND})')} THEN {by_sign(BLEND)} ELSE 0 END"
RATIO = "(mu / greatest(sigma, 1e-6))"
LONG, SHORT = in_top(0.1, RATIO), in_top(0.1, f"-{RATIO}")
SEPARATE = f"CASE WHEN {LONG} AND {SHORT} THEN CASE WHEN {RATIO} >= 0 THEN 1 ELSE -1 END WHEN {LONG} THEN 1 WHEN {SHORT} THEN -1 ELSE 0 END"


def confident(c: float) -> str:
    return f"CASE WHEN p_up >= {c} AND p_up > p_down THEN 1 WHEN p_down >= {c} AND p_down > p_up THEN -1 ELSE 0 END"


EQUITY = """SELECT row_id, equity, (equity - peak) / peak AS drawdown FROM (SELECT *, greatest(1.0, max(equity) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING)) AS peak
        FROM (SELECT row_id, product(1 + net) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS equity FROM {ex}))"""
TWO_PI = repr(2 * math.pi)
LN2 = repr(math.log(2))
FIELDS = ("open", "high", "low", "close")


def fault() -> str:
    rules = [("ts IS NULL", "missing_timestamp")] + [(f"{c} IS NULL OR isnan({c})", f"missing_{c}") for c in (*FIELDS, "volume")]
    for c in FIELDS:
        rules += [(f"isinf({c})", f"invalid_{c}"), (f"{c} <= 0", f"non_positive_{c}")]
    rules += [("isinf(volume)", "invalid_volume"), ("volume < 0", "negative_volume"), ("high < low", "high_below_low")]
    rules += [(f"high < {c}", f"high_below_{c}") for c in ("open", "close")] + [(f"low > {c}", f"low_above_{c}") for c in ("open", "close")]
    return "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for t, n in rules) + " END"


def since(filter_: str) -> str:
    """Bars with the global bars since the ticker's latest snapped event."""
    return f"""SELECT h.ticker, h.ts, i.bar - max(e.bar) AS since FROM bars h JOIN ix i USING (ts)
        LEFT JOIN (SELECT DISTINCT s.ticker, x.bar FROM snap s JOIN ix x ON s.bar_ts = x.ts WHERE {filter_}) e ON e.ticker = h.ticker AND e.bar <= i.bar GROUP BY h.ticker, h.ts, i.bar"""


STEPS = {
    "bars": bars_of("1 HOUR"),
    "bars_d": bars_of("1 DAY"),
    "bars_u": bars_of("5 MINUTE", "'U' || (user_id % 20)"),
    "bars_r": """SELECT n_regionkey::VARCHAR AS ticker, time_bucket(INTERVAL 1 DAY, l_shipdate) AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
        sum(l_quantity)::DOUBLE AS volume FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1, 2""",
    "seq": seq_of("bars", "1 HOUR"),
    "seq_day": seq_of("bars", "1 HOUR", True),
    "seq_d": seq_of("bars_d", "1 DAY"),
    "faulty": """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY hour(ts), ts) AS row_no FROM (SELECT ticker, ts,
        CASE hour(ts) WHEN 1 THEN NULL WHEN 2 THEN -1 ELSE open END AS open, CASE hour(ts) WHEN 3 THEN low - 1 WHEN 4 THEN 'inf'::DOUBLE ELSE high END AS high,
        low, close, CASE hour(ts) WHEN 5 THEN -2 ELSE volume END AS volume FROM bars)""",
    "told": f"SELECT *, {fault()} AS reason FROM faulty",
    "base": base_of("seq"),
    "feat": f"""SELECT *, CASE WHEN lv > 0 THEN volume / lv - 1 ELSE 0 END AS volume_change,
        CASE WHEN min(volume) {last(10)} <> max(volume) {last(10)} THEN (volume - avg(volume) {last(10)}) / stddev_pop(volume) {last(10)} ELSE 0 END AS volume_zscore,
        CASE WHEN avg(volume) {last(20)} > 0 THEN volume / avg(volume) {last(20)} ELSE 0 END AS relative_volume_long,
        open / lag(close) OVER ({SEQ}) - 1 AS gap_return, close / open - 1 AS intrabar_return,
        CASE WHEN high - low > 0 THEN (close - low) / (high - low) ELSE 0.5 END AS close_position,
        (high - low) / greatest(lag(high - low) OVER ({SEQ}), 1e-12) - 1 AS range_expansion,
        sin(least(greatest(hour(ts) * 60 + minute(ts) - 570, 0), 390) / 390.0::DOUBLE * {TWO_PI}::DOUBLE) AS session_pos_sin, cos(least(greatest(hour(ts) * 60 + minute(ts) - 570, 0), 390) / 390.0::DOUBLE * {TWO_PI}::DOUBLE) AS session_pos_cos,
        sin((isodow(ts) - 1) / 5.0::DOUBLE * {TWO_PI}::DOUBLE) AS day_of_week_sin, cos((isodow(ts) - 1) / 5.0::DOUBLE * {TWO_PI}::DOUBLE) AS day_of_week_cos,
        sqrt(avg(cc * cc) {last(20)}) AS rv_close_to_close, sqrt(avg(hl * hl / (4 * {LN2}::DOUBLE)) {last(20)}) AS rv_parkinson,
        sqrt(avg(greatest(0, 0.5 * hl * hl - (2 * {LN2}::DOUBLE - 1) * co * co)) {last(20)}) AS rv_garman_klass
        FROM (SELECT *, lag(volume) OVER ({SEQ}) AS lv, CASE WHEN idx = 0 THEN 0 ELSE ln(high) - ln(low) END AS hl, CASE WHEN idx = 0 THEN 0 ELSE ln(close) - ln(open) END AS co,
        CASE WHEN idx = 0 THEN 0 ELSE ln(close) - lag(ln(close)) OVER ({SEQ}) END AS cc FROM base)""",
    "warm": "SELECT * FROM feat WHERE idx >= 19",
    "lab": labelled_of("warm"),
    "stamps": "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM lab)",
    "spl": "SELECT lab.*, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM lab JOIN stamps USING (ts)",
    "pred": f"""SELECT *, p AS p_up, 1 - p AS p_down, ln(exp(sigma) - 1) AS log_scale, mu / sigma AS score, row_number() OVER (ORDER BY ts, ticker) - 1 AS row_id
        FROM (SELECT ticker, ts, close, close * exp(r * 0.01::DOUBLE) AS next_close, label, r AS ret, round(1 / (1 + exp(-z)), 9) AS p, round(1e-3 * z, 9) AS mu, round(greatest(rolling_volatility, 1e-4), 9) AS sigma
        FROM (SELECT *, {zscore('log_return')} AS z FROM lab))""",
    "ps": "SELECT * FROM pred",
    "ex_top": executed(TOP),
    **{f"ex_share{int(q * 100)}": executed(f"CASE WHEN {in_top(q, f'abs({EDGE})')} THEN {by_sign(EDGE)} ELSE 0 END") for q in (0.1, 0.2)},
    "ex_all": executed(by_sign(EDGE)),
    "ex_flip": executed("-" + by_sign(EDGE)),
    "ex_agree": executed(AGREED),
    "ex_sep": executed(SEPARATE),
    **{f"ex_{int(c * 100)}": executed(confident(c)) for c in (0.55, 0.6, 0.65, 0.7)},
    "ix": "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar FROM (SELECT DISTINCT ts FROM bars)",
    "filed": """SELECT CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'error' END AS ticker, ts AS event_ts, event_id, CASE WHEN event_id % 3 = 0 THEN '2.02' ELSE '8.01' END AS item,
        ['cpi', 'nfp', 'gdp', 'fomc_statement'][event_id % 4 + 1] AS event_type FROM events""",
    "days": "SELECT DISTINCT ts::DATE AS day FROM bars WHERE ts::TIME >= TIME '09:30:00'",
    "anchored": """SELECT *, CASE WHEN event_ts::TIME < TIME '09:30:00' THEN event_ts::DATE + INTERVAL 570 MINUTE WHEN event_ts::TIME >= TIME '16:00:00' THEN event_ts::DATE + INTERVAL 1 DAY + INTERVAL 570 MINUTE ELSE event_ts END AS at FROM filed""",
    "snap": """SELECT a.event_id, a.ticker, a.event_ts, a.item, a.event_type, min(b.ts) AS bar_ts FROM anchored a JOIN (SELECT ts FROM ix WHERE ts::TIME >= TIME '09:30:00') b ON b.ts >= a.at GROUP BY ALL""",
    "proxy": "SELECT ts, avg(close) AS close FROM bars_r GROUP BY ts",
    "mkt": "SELECT ts, greatest(avg(close), 1e-8) AS market_close FROM bars_r GROUP BY ts",
    "mk": "SELECT ts, coalesce(ln(market_close / lag(market_close) OVER (ORDER BY ts)), 0) AS m, ln(market_close) - ln(first_value(market_close) OVER (ORDER BY ts)) AS x FROM mkt",
    "ret_r": f"SELECT *, coalesce(ln(close / lag(close) OVER ({TICKER})), 0) AS log_return FROM bars_r",
    "brd": """SELECT *, sum(net) OVER (PARTITION BY ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum_ad FROM (
        SELECT ts, avg(CASE WHEN log_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ad_share, avg(CASE WHEN log_return < 0 THEN 1.0::DOUBLE ELSE 0 END) AS dec_share,
        CASE WHEN sum(relative_volume) > 0 THEN sum(CASE WHEN log_return > 0 THEN relative_volume ELSE 0 END) / sum(relative_volume) ELSE 0 END AS up_volume_share,
        sum(sign(log_return) * relative_volume) AS signed_volume, median(log_return) AS median_return, stddev_pop(log_return) AS dispersion,
        count(*) FILTER (log_return > 0) - count(*) FILTER (log_return < 0) AS net FROM base GROUP BY ts)""",
    "fdays": "SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts::DATE AS day FROM bars)",
    "fold": """SELECT fold, split, a.day AS first_day, b.day AS last_day FROM (
        SELECT fold, unnest([{'split': 'train', 'a': s, 'b': s + 9}, {'split': 'val', 'a': s + 10, 'b': s + 12}, {'split': 'test', 'a': s + 13, 'b': s + 15}], recursive := true)
        FROM (SELECT fold, fold * 4 AS s FROM range(100) t(fold) WHERE fold * 4 <= (SELECT max(n) FROM fdays) - 16)) f JOIN fdays a ON a.i = f.a JOIN fdays b ON b.i = f.b""",
    "frow": "SELECT fold, split, bars.* FROM bars JOIN fold ON bars.ts::DATE BETWEEN first_day AND last_day",
    "reg": f"""SELECT ts, ret, vol, lag_mean, CASE WHEN stddev_pop(ret) OVER () > 1e-12 THEN (ret - avg(ret) OVER ()) / stddev_pop(ret) OVER () ELSE 0 END AS z_return,
        CASE WHEN stddev_pop(vol) OVER () > 1e-12 THEN (vol - avg(vol) OVER ()) / stddev_pop(vol) OVER () ELSE 0 END AS z_vol,
        CASE WHEN stddev_pop(lag_mean) OVER () > 1e-12 THEN (lag_mean - avg(lag_mean) OVER ()) / stddev_pop(lag_mean) OVER () ELSE 0 END AS z_lag
        FROM (SELECT *, stddev_pop(ret) {last(12, 'ORDER BY ts')} AS vol, avg(lagged) {last(12, 'ORDER BY ts')} AS lag_mean FROM (
        SELECT *, coalesce(ret * lag(ret) OVER (ORDER BY ts), 0) AS lagged FROM (SELECT ts, coalesce(close / lag(close) OVER (ORDER BY ts) - 1, 0) AS ret FROM proxy)))""",
    "sta": "SELECT *, least(floor((row_number() OVER (ORDER BY round(vol, 12), ts) - 1) * 3 / count(*) OVER ()), 2)::INT AS state FROM reg",
    "pv": "SELECT ticker || '-' || h AS test_id, round(1 / (1 + abs(m) * 100), 9) AS p_value FROM (SELECT ticker, hour(ts) AS h, avg(ret) AS m FROM pred GROUP BY ALL)",
    "strat": "SELECT 'all' AS strategy, row_id AS t, net AS ret FROM ex_all UNION ALL SELECT 'top', row_id, net FROM ex_top UNION ALL SELECT 'flip', row_id, net FROM ex_flip",
    "draws": f"""SELECT strategy, rep, sum(c)::DOUBLE AS n, sum(c * x) AS s1, sum(c * x * x) AS s2 FROM (SELECT strategy, rep, x, {' + '.join(f"(z / {PRIME}::DOUBLE >= {c!r}::DOUBLE)::INT" for c in POISSON)} AS c
        FROM (SELECT strategy, rep, x, (z * z + {A}) % {PRIME} AS z FROM (SELECT strategy, rep, x, (z * z + rep * {B}) % {PRIME} AS z FROM (SELECT strategy, rep, ret - avg(ret) OVER (PARTITION BY strategy) AS x, (t * {A} + rep * {B} + {C}) % {PRIME} AS z
        FROM strat, range(500) r(rep))))) WHERE c > 0 GROUP BY strategy, rep""",
}


def needed(sql: str) -> list[str]:
    """The steps that a statement reads, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in STEPS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(STEPS[name])
    return [n for n in STEPS if n in found]


def with_steps(sql: str, recursive: bool = False) -> str:
    steps = ",\n".join(f"{n} AS ({STEPS[n]})" for n in needed(sql))
    return f"WITH {'RECURSIVE ' if recursive else ''}{steps}\n{sql}" if steps else sql


def picked(columns: str) -> str:
    """Expressions of a projection: d: doubles rounded, t: times as text, i: integers as BIGINT."""
    kinds = {"d": "round({}, 6) + 0.0::DOUBLE AS {}", "t": "{}::VARCHAR AS {}", "i": "({})::BIGINT AS {}", "s": "{} AS {}"}
    return ", ".join(kinds[c[0]].format(c[2:], c[2:]) if c[1:2] == ":" else c for c in columns.split())


def out(source: str, columns: str, where: str = "") -> str:
    return with_steps(f"SELECT {picked(columns)} FROM {source}{' WHERE ' + where if where else ''}")


def doubles(names) -> str:
    return " ".join(f"d:{n}" for n in names)


BAR = "ticker t:ts d:open d:high d:low d:close d:volume"
P_SAFE = "least(greatest(p, 1e-6), 1 - 1e-6)"
GRID = "SELECT -1 AS k, 1.0::DOUBLE AS temperature UNION ALL SELECT k, 0.25::DOUBLE + k * (3.75::DOUBLE / 150) AS temperature FROM range(151) t(k)"


def temperature(by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""(SELECT {b}k, temperature, avg(-CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END) AS nll, avg(pow(q - label, 2)) AS brier, count(*) AS n
        FROM (SELECT {b}label, k, temperature, least(greatest(1 / (1 + exp(-logit / temperature)), 1e-6), 1 - 1e-6) AS q
        FROM (SELECT *, ticker AS bucket, ln({P_SAFE} / (1 - {P_SAFE})) AS logit FROM pred), ({GRID}) g) GROUP BY ALL)"""


def best(by: str = "") -> str:
    b, g = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""(SELECT {b}arg_min(temperature, row(round(nll, 12), k)) AS temperature, max(nll) FILTER (k = -1) AS nll_before, min(nll) AS nll_after,
        max(brier) FILTER (k = -1) AS brier_before, arg_min(brier, row(round(nll, 12), k)) AS brier_after, max(n) AS n FROM {temperature(by)}{g})"""


def filled_steps(reject: bool) -> str:
    """Positions after fills of all rows as one instrument, and their modelled costs."""
    short = "r.held" if reject else "r.held + (n.want - r.held) * (n.cap / (0.02::DOUBLE * abs(n.want - r.held)))"
    return f"""n AS (SELECT row_id, position::DOUBLE AS want, sigma, close, next_close, count(*) OVER () AS total, CASE WHEN ts::TIME <= TIME '09:30:00' OR ts::TIME >= TIME '15:55:00' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END AS cap FROM ex_all),
        r AS (SELECT -1::BIGINT AS row_id, 0::DOUBLE AS held UNION ALL
        SELECT n.row_id, CASE WHEN 0.02::DOUBLE * abs(n.want - r.held) <= 1e-12 THEN r.held WHEN 0.02::DOUBLE * abs(n.want - r.held) <= n.cap THEN n.want ELSE {short} END FROM r JOIN n ON n.row_id = r.row_id + 1),
        costed AS (SELECT *, gross - 2 * cost AS net FROM (SELECT *, position * (next_close - close) / close AS gross, total_bps / 2e4 * turnover AS cost, (want <> previous AND turnover <= 1e-12)::BIGINT AS rejected FROM (
        SELECT *, abs(position - previous) AS turnover, (6.0 * sqrt(greatest(sigma, 1e-8) / 0.001) + 25.0 * 0.02::DOUBLE * abs(want - previous) + 10000.0 * greatest(sigma, 1e-8) * 0.05) * CASE WHEN cap > 0.04 THEN 1.0 WHEN row_id < 2 THEN 1.5 WHEN row_id >= greatest(0, total - 2) THEN 1.35 ELSE 1.0 END::DOUBLE AS total_bps
        FROM (SELECT n.*, r.held AS position, b.held AS previous FROM n JOIN r USING (row_id) JOIN r b ON b.row_id = n.row_id - 1))))"""


def figures(ex: str) -> str:
    return f"""(SELECT sum(net) AS net_pnl, sum(gross) AS gross_pnl, sum(turnover) / 1e4 AS cost_pnl, sum(turnover) * 0.5 / 1e4 AS slippage_pnl,
        CASE WHEN stddev_pop(net) > 0 THEN avg(net) / stddev_pop(net) * sqrt(19656) ELSE 0 END AS sharpe, count(*) FILTER (turnover > 0) AS trades,
        count(*) FILTER (position > 0) AS long_bars, count(*) FILTER (position < 0) AS short_bars, count(*) FILTER (position = 0) AS flat_bars,
        coalesce(avg((net > 0)::INT::DOUBLE) FILTER (position <> 0), 0) AS hit_rate,
        (SELECT least(min(drawdown), 0) FROM ({EQUITY.format(ex=ex)})) AS max_drawdown, (SELECT arg_max(equity, row_id) FROM ({EQUITY.format(ex=ex)})) AS final_equity FROM {ex})"""


HIT = "((p >= 0.5) = (label = 1))::INT::DOUBLE"
FLAGS = ("cpi", "nfp", "gdp")
ITEM_202, ITEM_801 = "item = '2.02'", "item = '8.01'"
_COINT = f"""(SELECT *, y - a - b * x AS resid, sqrt(greatest(var_y - 2 * b * cov_xy + b * b * var_x, 0)) AS sd FROM (
    SELECT *, CASE WHEN n < 40 THEN 1 WHEN var_x * n > 1e-12 THEN slope ELSE 0 END AS b, CASE WHEN n < 40 THEN 0 WHEN var_x * n > 1e-12 THEN icept ELSE avg_y END AS a FROM (
    SELECT ticker, ts, x, y, count(*) {last(78, TICKER)} AS n, regr_slope(y, x) {last(78, TICKER)} AS slope, regr_intercept(y, x) {last(78, TICKER)} AS icept, avg(y) {last(78, TICKER)} AS avg_y,
    avg(x) {last(78, TICKER)} AS avg_x, var_pop(x) {last(78, TICKER)} AS var_x, var_pop(y) {last(78, TICKER)} AS var_y, covar_pop(y, x) {last(78, TICKER)} AS cov_xy,
    count(yl) {last(77, TICKER)} AS np, covar_pop(yl, y) {last(77, TICKER)} AS c1, covar_pop(yl, CASE WHEN yl IS NULL THEN NULL ELSE x END) {last(77, TICKER)} AS c2, covar_pop(xl, y) {last(77, TICKER)} AS c3, covar_pop(xl, x) {last(77, TICKER)} AS c4,
    var_pop(yl) {last(77, TICKER)} AS v1, covar_pop(xl, yl) {last(77, TICKER)} AS v2, var_pop(xl) {last(77, TICKER)} AS v3
    FROM (SELECT *, lag(x) OVER ({TICKER}) AS xl, lag(y) OVER ({TICKER}) AS yl FROM (SELECT r.ticker, r.ts, ln(greatest(close, 1e-8)) AS y, x FROM bars_r r JOIN mk USING (ts))))))"""
_PHI = "((c1 - b * (c2 + c3) + b * b * c4) / (v1 - 2 * b * v2 + b * b * v3))"
_KNOWN = "n >= 4 AND np * (v1 - 2 * b * v2 + b * b * v3) > 1e-12"

_TENSOR_8 = last(8, "PARTITION BY ticker, seq_id, split ORDER BY ts")
_SINGLE = "(log_return::FLOAT::DOUBLE + close_position::FLOAT::DOUBLE)"
_BENCH = ("ret_3", "vwap_dev", "intraday_range_pos", "rv_ratio")
_WIDE = ", ".join(f"max({n}) FILTER (ticker = '{b}') AS mctx_{b}_{n}" for b in ("click", "purchase") for n in _BENCH)
_RUN = f"OVER ({SEQ} ROWS UNBOUNDED PRECEDING)"


def recursive(steps: str, select: str) -> str:
    own = ",\n".join(f"{n} AS ({STEPS[n]})" for n in needed(steps))
    return f"WITH RECURSIVE {own},\n{steps}\n{select}"


def ema(c: str, span: int) -> str:
    return f"2.0::DOUBLE / {span + 1} * n.{c} + (1 - 2.0::DOUBLE / {span + 1}) * r.{c}_ema_{span} AS {c}_ema_{span}"


_EMA = [(c, w) for c in ("ad_share", "up_volume_share") for w in (6, 12)]

ORACLE_SQL: dict[str, str] = {
    "benchmark_context": out(f"""(SELECT b.ticker, b.ts, {', '.join(f'coalesce(mctx_{t}_{n}, 0) AS mctx_{t}_{n}' for t in ('click', 'purchase') for n in _BENCH)} FROM bars b LEFT JOIN (SELECT ts, {_WIDE} FROM (
        SELECT ticker, ts, CASE WHEN idx >= 3 THEN sum(log_return) {last(3)} ELSE 0 END AS ret_3, CASE WHEN sum(volume) {_RUN} > 0 THEN close / (sum((high + low + close) / 3 * volume) {_RUN} / sum(volume) {_RUN}) - 1 ELSE 0 END AS vwap_dev,
        CASE WHEN max(high) {_RUN} - min(low) {_RUN} > 1e-12 THEN (close - min(low) {_RUN}) / (max(high) {_RUN} - min(low) {_RUN}) ELSE 0.5 END AS intraday_range_pos,
        CASE WHEN avg(abs(log_return)) {last(12)} > 1e-12 THEN stddev_pop(log_return) {last(6)} / avg(abs(log_return)) {last(12)} ELSE 0 END AS rv_ratio FROM base) GROUP BY ts) w USING (ts))""",
        "ticker t:ts " + doubles(f"mctx_{b}_{n}" for b in ("click", "purchase") for n in _BENCH)),
    "window_tensor": out(f"""(SELECT ticker, ts, 8 AS steps, round(total, 4) AS total, oldest FROM (SELECT ticker, ts, sum({_SINGLE}) {_TENSOR_8} AS total, lag(log_return::FLOAT::DOUBLE, 7) OVER (PARTITION BY ticker, seq_id, split ORDER BY ts) AS oldest,
        row_number() OVER (PARTITION BY ticker, seq_id, split ORDER BY ts) - 1 AS k FROM spl) WHERE k >= 7 AND (k - 7) % 2 = 0)""", "ticker t:ts i:steps d:total d:oldest"),
    "panel_tensor": out(f"""(SELECT ticker, ts, 4 AS steps, round(sum({_SINGLE}) OVER (PARTITION BY ts ORDER BY ticker ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS total,
        coalesce(lag(log_return::FLOAT::DOUBLE, 2) OVER (PARTITION BY ts ORDER BY ticker), 0) AS first_value FROM lab)""", "ticker t:ts i:steps d:total d:first_value"),
    "breadth_ema": recursive(f"""n AS (SELECT ts, ad_share, up_volume_share, row_number() OVER (ORDER BY ts) AS i FROM brd),
        r AS (SELECT ts, i, {', '.join(f'{c} AS {c}_ema_{w}' for c, w in _EMA)} FROM n WHERE i = 1 UNION ALL SELECT n.ts, n.i, {', '.join(ema(c, w) for c, w in _EMA)} FROM r JOIN n ON n.i = r.i + 1)""",
        f"SELECT ts::VARCHAR AS ts, {', '.join(f'round({c}_ema_{w}, 6) + 0.0::DOUBLE AS {c}_ema_{w}' for c, w in _EMA)} FROM r"),
    "backtest_fills": recursive("""n AS (SELECT row_id, ticker, position::DOUBLE AS want, row_number() OVER (PARTITION BY ticker ORDER BY row_id) AS i FROM ex_all),
        r AS (SELECT 0::BIGINT AS row_id, ticker, 0::DOUBLE AS want, 0::BIGINT AS i, 0::DOUBLE AS held FROM n WHERE i = 1 UNION ALL
        SELECT n.row_id, n.ticker, n.want, n.i, CASE WHEN 0.02::DOUBLE * abs(n.want - r.held) <= 1e-12 THEN r.held WHEN 0.02::DOUBLE * abs(n.want - r.held) <= 0.015 THEN n.want
        ELSE r.held + (n.want - r.held) * (0.015::DOUBLE / (0.02::DOUBLE * abs(n.want - r.held))) END FROM r JOIN n ON n.ticker = r.ticker AND n.i = r.i + 1)""",
        "SELECT row_id::BIGINT AS row_id, ticker, want::BIGINT AS position, round(held, 6) + 0.0::DOUBLE AS filled FROM r WHERE i > 0"),
    "backtest_executed_costs": recursive(filled_steps(False), f"SELECT row_id::BIGINT AS row_id, want::BIGINT AS wanted, round(position, 6) + 0.0::DOUBLE AS position, round(turnover, 6) + 0.0::DOUBLE AS turnover, rejected, round(gross, 6) + 0.0::DOUBLE AS gross, round(cost, 6) + 0.0::DOUBLE AS cost, round(net, 6) + 0.0::DOUBLE AS net FROM costed"),
    "backtest_cost_report": recursive(filled_steps(True), f"""SELECT round(sum(net), 6) + 0.0::DOUBLE AS net_pnl, round(sum(gross), 6) + 0.0::DOUBLE AS gross_pnl, round(sum(cost), 6) + 0.0::DOUBLE AS cost_pnl, round(sum(cost), 6) + 0.0::DOUBLE AS slippage_pnl,
        round(avg(net) / stddev_pop(net) * sqrt(19656), 6) AS sharpe, count(*) FILTER (turnover > 0)::BIGINT AS trades, count(*) FILTER (position > 0)::BIGINT AS long_bars, count(*) FILTER (position < 0)::BIGINT AS short_bars, count(*) FILTER (position = 0)::BIGINT AS flat_bars,
        round(coalesce(avg((net > 0)::INT::DOUBLE) FILTER (position <> 0), 0), 6) + 0.0::DOUBLE AS hit_rate, round((SELECT least(min(drawdown), 0) FROM ({EQUITY.format(ex='costed')})), 6) + 0.0::DOUBLE AS max_drawdown,
        round((SELECT arg_max(equity, row_id) FROM ({EQUITY.format(ex='costed')})), 6) + 0.0::DOUBLE AS final_equity, sum(rejected)::BIGINT AS rejected, round(avg(total_bps) FILTER (abs(want - previous) > 0), 6) AS mean_cost_bps, count(*) AS n, true AS ok FROM costed"""),
    "regime_stats": out("""(SELECT *, CASE WHEN k = 1 THEN 'trending' WHEN by_vol = 1 THEN 'volatile' WHEN k = 2 THEN CASE WHEN autocorr < 0 THEN 'mean_reverting' ELSE 'trending' END WHEN by_trend = 1 THEN 'trending' ELSE 'mean_reverting' END AS regime
        FROM (SELECT *, row_number() OVER (PARTITION BY by_vol = 1 ORDER BY trend_score DESC, state) AS by_trend FROM (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY volatility DESC, state) AS by_vol,
        abs(mean_return) / greatest(volatility, 1e-6) + greatest(0, autocorr) AS trend_score, greatest(0, -autocorr) + volatility / greatest(abs(mean_return), 1e-6) * 0.05::DOUBLE AS reversion_score
        FROM (SELECT state, count(*) AS n, avg(ret) AS mean_return, stddev_pop(ret) AS volatility, CASE WHEN count(b) < 2 OR stddev_pop(ret) FILTER (b IS NOT NULL) <= 1e-12 OR stddev_pop(b) <= 1e-12 THEN 0 ELSE corr(b, ret) END AS autocorr
        FROM (SELECT *, lag(ret) OVER (ORDER BY ts) AS b FROM sta) GROUP BY state))))""", "i:state i:n d:mean_return d:volatility d:autocorr d:trend_score d:reversion_score regime"),
    "share_sweep": " UNION ALL ".join("SELECT * FROM (" + out(f"(SELECT *, {q}::DOUBLE AS share FROM {figures(ex)})", "share d:net_pnl i:trades i:long_bars i:short_bars d:hit_rate d:max_drawdown") + ")" for q, ex in ((0.1, "ex_share10"), (0.2, "ex_share20"), (0.4, "ex_top"))),
    "equity_returns": out(f"(SELECT row_id, equity / before - 1 AS ret FROM (SELECT row_id, equity, lag(equity) OVER (ORDER BY row_id) AS before FROM ({EQUITY.format(ex='ex_top')})) WHERE before IS NOT NULL)", "i:row_id d:ret"),
    "market_level": out("(SELECT ts, coalesce(product(1 + g) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS close FROM (SELECT ts, greatest(avg((next_close - close) / close), -0.95::DOUBLE) AS g FROM pred GROUP BY ts))", "t:ts d:close"),
    "aux_targets": out("""(SELECT ticker, ts, CASE WHEN hour(ts) % 2 = 1 THEN r ELSE (next_close - close) / close END AS target_return, label AS target_direction, CASE WHEN hour(ts) % 2 = 1 THEN threshold_label ELSE 1 END AS target_threshold,
        0.5::DOUBLE AS target_rank, CASE WHEN hour(ts) % 2 = 1 THEN event_label ELSE 0 END AS target_event, label AS target_event_direction, 1.0::DOUBLE AS target_event_signed, 0.0::DOUBLE AS target_event_magnitude FROM lab)""",
        "ticker t:ts " + doubles(f"target_{n}" for n in "return direction threshold rank event event_direction event_signed event_magnitude".split())),
    "event_target_summary": out("(SELECT count(event_label) AS sample_count, avg(event_label) AS event_prevalence, avg(least(1, abs(r) / (2 * event_threshold))) AS mean_p_event FROM lab)", "i:sample_count d:event_prevalence d:mean_p_event"),
    "global_spearman": out("(SELECT count(*) AS n, corr(ra, rb) AS ic FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2.0::DOUBLE AS rb FROM pred))", "i:n d:ic"),
    "checkpoint_score": out(f"""(SELECT n, CASE WHEN n >= 200 THEN (ranks - npos * (npos + 1) / 2) / (npos * (n - npos)) ELSE accuracy END AS score FROM (SELECT count(*) AS n, avg({HIT}) AS accuracy, sum(rk) FILTER (label = 1) AS ranks, sum(label)::DOUBLE AS npos
        FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM pred)))""", "i:n d:score"),
    "dataset_assembly": with_steps("SELECT split, count(*) AS n, count(DISTINCT ticker) AS tickers, count(DISTINCT ts) AS stamps, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM spl WHERE hour(ts) <> 7 GROUP BY split"),
    "flagship": out(
        "(" + labelled_of(f"(SELECT *, {rank01('log_return')} AS cs_log_return_rank, {zscore('log_return')} AS cs_log_return_zscore FROM ({base_of('seq_d')}) WHERE idx >= 5)") + ")",
        "ticker t:ts d:log_return d:short_term_momentum d:rolling_volatility d:cs_log_return_rank d:cs_log_return_zscore i:label i:threshold_label i:vol_direction_label",
    ),
    "bars_hourly": out("bars", BAR),
    "bars_five_minutes_by_user": out("bars_u", BAR),
    "bars_region_daily": out("bars_r", BAR),
    "quality_reasons": with_steps("SELECT reason, count(*) AS n FROM told WHERE reason IS NOT NULL GROUP BY reason"),
    "validation_summary": with_steps("""SELECT *, invalid_rows = 0 AND duplicate_timestamps = 0 AND out_of_order_pairs = 0 AS valid FROM (
        SELECT ticker, count(*) AS row_count, count(reason) AS invalid_rows, count(ts) - count(DISTINCT ts) AS duplicate_timestamps, count(*) FILTER (back) AS out_of_order_pairs
        FROM (SELECT *, lag(ts) OVER (PARTITION BY ticker ORDER BY row_no) > ts AS back FROM told) GROUP BY ticker)"""),
    "valid_tickers": with_steps("SELECT ticker, count(*) AS n FROM bars WHERE ticker <> 'error' GROUP BY ticker"),
    "feature_validation": with_steps(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER (isnan({c}) OR isinf({c})) AS invalid FROM faulty" for c in (*FIELDS, "volume"))),
    "session_filter_tz": "SELECT event_id, ts::VARCHAR AS ts FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ts FROM events) WHERE ts::TIME >= TIME '09:30:00' AND ts::TIME < TIME '16:00:00'",
    "contiguous_sequences": out("seq", "ticker t:ts i:seq_id i:idx"),
    "long_sequences": with_steps("SELECT ticker, seq_id, count(*) AS n, min(ts)::VARCHAR AS first_ts FROM seq_day GROUP BY ticker, seq_id HAVING count(*) >= 5"),
    "sequence_breaks": with_steps("""SELECT ticker, prev_ts::VARCHAR AS prev_ts, ts::VARCHAR AS ts, CASE WHEN nd THEN 'new_trading_day' ELSE 'gap' END AS reason,
        CASE WHEN nd THEN 0 ELSE greatest(gap // 3600 - 1, 0) END::BIGINT AS missing_candles FROM (SELECT *, date_diff('second', prev_ts, ts) AS gap, prev_ts::DATE <> ts::DATE AS nd
        FROM (SELECT ticker, ts, lag(ts) OVER (PARTITION BY ticker ORDER BY ts) AS prev_ts FROM bars)) WHERE prev_ts IS NOT NULL AND (gap <> 3600 OR nd)"""),
    "sortedness": with_steps("SELECT ticker, count(*) FILTER (back) = 0 AS ordered FROM (SELECT ticker, lag(ts) OVER (PARTITION BY ticker ORDER BY row_no) > ts AS back FROM faulty) GROUP BY ticker"),
    "split_adjust": out("""(SELECT ticker, ts, open / f AS open, high / f AS high, low / f AS low, close / f AS close, volume * f AS volume FROM (SELECT b.*, coalesce((SELECT exp(sum(ln(factor)))
        FROM (VALUES ('0', TIMESTAMP '1996-01-02', 2.0::DOUBLE), ('0', TIMESTAMP '1997-06-01', 3.0), ('1', TIMESTAMP '1995-03-15', 0.5)) a(tk, moment, factor) WHERE a.tk = b.ticker AND a.moment > b.ts), 1) AS f FROM bars_r b))""", BAR),
    "base_features": out("feat", "ticker t:ts " + doubles(("log_return", "candle_range", "candle_body", "upper_wick", "lower_wick", "short_term_momentum", "rolling_volatility", "relative_volume"))),
    "volume_features": out("feat", "ticker t:ts " + doubles(("volume_change", "volume_zscore", "relative_volume_long"))),
    "market_features": out("feat", "ticker t:ts " + doubles(("gap_return", "intrabar_return", "close_position", "range_expansion"))),
    "time_features": out("feat", "ticker t:ts " + doubles(("session_pos_sin", "session_pos_cos", "day_of_week_sin", "day_of_week_cos"))),
    "realized_volatility": out("feat", "ticker t:ts " + doubles(("rv_close_to_close", "rv_parkinson", "rv_garman_klass"))),
    "warmup_rows": out("(SELECT ticker, count(*) AS n, sum(rv_parkinson) AS rv FROM warm GROUP BY ticker)", "ticker i:n d:rv"),
    "market_factor": out(f"""(SELECT ticker, ts, m AS market_log_return, b AS rolling_beta_market, log_return - (a + b * m) AS residual_return_market FROM (
        SELECT *, CASE WHEN n >= 40 AND sxx > 1e-12 THEN slope ELSE 0 END AS b, CASE WHEN n >= 40 AND sxx > 1e-12 THEN icept ELSE mean END AS a FROM (
        SELECT r.ticker, ts, log_return, m, count(*) {last(78, TICKER)} AS n, var_pop(m) {last(78, TICKER)} * count(*) {last(78, TICKER)} AS sxx, regr_slope(log_return, m) {last(78, TICKER)} AS slope,
        regr_intercept(log_return, m) {last(78, TICKER)} AS icept, avg(log_return) {last(78, TICKER)} AS mean FROM ret_r r JOIN mk USING (ts))))""", "ticker t:ts d:market_log_return d:rolling_beta_market d:residual_return_market"),
    "cointegration": out(f"""(SELECT ticker, ts, resid AS cointegration_residual, CASE WHEN sd > 1e-8 THEN (resid - (avg_y - a - b * avg_x)) / sd ELSE 0 END AS cointegration_zscore,
        round(CASE WHEN {_KNOWN} AND {_PHI} > 0 AND {_PHI} < 0.999 THEN least(200, greatest(1, -{LN2}::DOUBLE / ln({_PHI}))) ELSE 200 END, 3) AS cointegration_half_life FROM {_COINT})""",
        "ticker t:ts d:cointegration_residual d:cointegration_zscore d:cointegration_half_life"),
    "cs_rank_zscore": out(f"(SELECT ticker, ts, {', '.join(f'{rank01(c)} AS cs_{c}_rank, {zscore(c)} AS cs_{c}_zscore' for c in ('log_return', 'candle_range'))} FROM base)",
        "ticker t:ts d:cs_log_return_rank d:cs_log_return_zscore d:cs_candle_range_rank d:cs_candle_range_zscore"),
    "breadth": out("brd", "t:ts d:ad_share d:dec_share d:up_volume_share d:signed_volume d:median_return d:dispersion i:net i:cum_ad"),
    "new_high_low": out("""(SELECT ts, avg(CASE WHEN close >= hi THEN 1.0::DOUBLE ELSE 0 END) AS new_high_share, avg(CASE WHEN close <= lo THEN 1.0::DOUBLE ELSE 0 END) AS new_low_share FROM bars b
        LEFT JOIN (SELECT ticker, day, max(h) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi, min(l) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS lo
        FROM (SELECT ticker, ts::DATE AS day, max(close) AS h, min(close) AS l FROM bars GROUP BY ALL)) d ON d.ticker = b.ticker AND d.day = b.ts::DATE GROUP BY ts)""", "t:ts d:new_high_share d:new_low_share"),
    "gap_regime": out(f"""(SELECT ticker, day, arg_max(z, ts) AS gap_z FROM (SELECT ticker, ts, ts::DATE AS day, CASE WHEN stddev_pop(gap) {last(60, TICKER)} > 1e-12 THEN (gap - avg(gap) {last(60, TICKER)}) / stddev_pop(gap) {last(60, TICKER)} ELSE 0 END AS z
        FROM (SELECT *, ln(o / lag(c) OVER ({TICKER})) AS gap FROM (SELECT ticker, seq_id, min(ts) AS ts, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM seq_day GROUP BY ALL)) WHERE gap IS NOT NULL) GROUP BY ticker, day)""", "ticker t:day d:gap_z"),
    "sector_map": "SELECT n_name AS ticker, r_name AS sector, (dense_rank() OVER (ORDER BY r_name))::DOUBLE AS mctx_sector_id FROM nation JOIN region ON n_regionkey = r_regionkey",
    "event_snap": out("snap", "i:event_id ticker t:event_ts t:bar_ts"),
    "macro_flags": out(f"""(SELECT ticker, ts, (d.k IS NOT NULL)::INT::DOUBLE AS macro_event_today, {', '.join(f"coalesce(list_contains(d.k, '{k}'), false)::INT::DOUBLE AS {k}_day" for k in FLAGS)},
        coalesce(list_contains(x.k, 'fomc_statement'), false)::INT::DOUBLE AS fomc_statement_bar, coalesce(list_contains(x.k, 'fomc_press'), false)::INT::DOUBLE AS fomc_press_bar
        FROM bars LEFT JOIN (SELECT bar_ts::DATE AS day, list(event_type) AS k FROM snap GROUP BY 1) d ON d.day = ts::DATE LEFT JOIN (SELECT bar_ts, list(event_type) AS k FROM snap GROUP BY 1) x ON x.bar_ts = ts)""",
        "ticker t:ts d:macro_event_today d:cpi_day d:nfp_day d:gdp_day d:fomc_statement_bar d:fomc_press_bar"),
    "post_event_flags": out(f"(SELECT ticker, ts, coalesce(since = 0, false)::INT::DOUBLE AS earnings_event_bar, {', '.join(f'coalesce(since <= {n}, false)::INT::DOUBLE AS post_earnings_{n}bars' for n in (1, 3, 6, 12, 78))} FROM ({since(ITEM_202)}))",
        "ticker t:ts d:earnings_event_bar " + doubles(f"post_earnings_{n}bars" for n in (1, 3, 6, 12, 78))),
    "event_decay": out("(SELECT ticker, ts, CASE WHEN a.since <= 78 THEN exp(-a.since / 12.0::DOUBLE) ELSE 0 END AS sec_8k_item202_recent, CASE WHEN b.since <= 78 THEN exp(-b.since / 12.0::DOUBLE) ELSE 0 END AS sec_8k_item801_recent "
        f"FROM ({since(ITEM_202)}) a JOIN ({since(ITEM_801)}) b USING (ticker, ts))", "ticker t:ts d:sec_8k_item202_recent d:sec_8k_item801_recent"),
    "pre_event": out("(SELECT b.ticker, b.ts, (d.day IS NOT NULL)::INT::DOUBLE AS pre_earnings_1d FROM bars b LEFT JOIN (SELECT DISTINCT ticker, (bar_ts::DATE - 1) AS day FROM snap) d ON d.ticker = b.ticker AND d.day = b.ts::DATE)", "ticker t:ts d:pre_earnings_1d"),
    "event_density": out("""(SELECT sector, ticker, ts, coalesce(m.n / count(*) OVER (PARTITION BY ts), 0)::DOUBLE AS earnings_density_same_day_market, coalesce(s.n / count(*) OVER (PARTITION BY ts, sector), 0)::DOUBLE AS earnings_density_same_day_sector
        FROM (SELECT *, CASE WHEN ticker IN ('click', 'error') THEN 'a' ELSE 'b' END AS sector FROM bars) b LEFT JOIN (SELECT bar_ts::DATE AS day, count(*) AS n FROM snap GROUP BY 1) m ON m.day = b.ts::DATE
        LEFT JOIN (SELECT bar_ts::DATE AS day, 'a' AS sec, count(*) AS n FROM snap GROUP BY 1) s ON s.day = b.ts::DATE AND s.sec = b.sector)""", "sector ticker t:ts d:earnings_density_same_day_market d:earnings_density_same_day_sector"),
    "calendar_grid": out(f"""(SELECT b.ticker, b.ts, b.sector AS mctx_sector_id, (d.k IS NOT NULL)::INT::DOUBLE AS macro_event_today, {', '.join(f"coalesce(list_contains(d.k, '{k}'), false)::INT::DOUBLE AS {k}_day" for k in FLAGS)},
        coalesce(list_contains(x.k, 'fomc_statement'), false)::INT::DOUBLE AS fomc_statement_bar, 0.0::DOUBLE AS fomc_press_bar, coalesce(a.since = 0, false)::INT::DOUBLE AS earnings_event_bar,
        {', '.join(f'coalesce(a.since <= {n}, false)::INT::DOUBLE AS post_earnings_{n}bars' for n in (1, 3, 6, 12, 78))}, {', '.join(f'0.0::DOUBLE AS sec_8k_item{n}_recent' for n in (301, 402, 502))},
        CASE WHEN a.since <= 78 THEN exp(-a.since / 12.0::DOUBLE) ELSE 0 END AS sec_8k_item202_recent, CASE WHEN e.since <= 78 THEN exp(-e.since / 12.0::DOUBLE) ELSE 0 END AS sec_8k_item801_recent,
        coalesce(m.n / count(*) OVER (PARTITION BY b.ts), 0)::DOUBLE AS earnings_density_same_day_market, coalesce(s.n / count(*) OVER (PARTITION BY b.ts, b.sector), 0)::DOUBLE AS earnings_density_same_day_sector,
        (p.day IS NOT NULL)::INT::DOUBLE AS pre_earnings_1d
        FROM (SELECT *, CASE WHEN ticker IN ('click', 'error') THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS sector FROM bars) b JOIN ({since(ITEM_202)}) a ON a.ticker = b.ticker AND a.ts = b.ts JOIN ({since(ITEM_801)}) e ON e.ticker = b.ticker AND e.ts = b.ts
        LEFT JOIN (SELECT bar_ts::DATE AS day, list(event_type) AS k FROM snap GROUP BY 1) d ON d.day = b.ts::DATE LEFT JOIN (SELECT bar_ts, list(event_type) AS k FROM snap GROUP BY 1) x ON x.bar_ts = b.ts
        LEFT JOIN (SELECT bar_ts::DATE AS day, count(*) AS n FROM snap WHERE {ITEM_202} GROUP BY 1) m ON m.day = b.ts::DATE LEFT JOIN (SELECT bar_ts::DATE AS day, 1.0::DOUBLE AS sec, count(*) AS n FROM snap WHERE {ITEM_202} GROUP BY 1) s ON s.day = b.ts::DATE AND s.sec = b.sector
        LEFT JOIN (SELECT DISTINCT ticker, (bar_ts::DATE - 1) AS day FROM snap) p ON p.ticker = b.ticker AND p.day = b.ts::DATE)""",
        "t:ts ticker d:mctx_sector_id " + doubles(["macro_event_today", *[f"{k}_day" for k in FLAGS], "fomc_statement_bar", "fomc_press_bar", "earnings_event_bar", *[f"post_earnings_{n}bars" for n in (1, 3, 6, 12, 78)],
            *[f"sec_8k_item{n}_recent" for n in (202, 301, 402, 502, 801)], "earnings_density_same_day_market", "earnings_density_same_day_sector", "pre_earnings_1d"])),
    "labels_fixed": out("(SELECT *, r AS next_log_return, threshold_label = 0 AS threshold_down, threshold_label = 1 AS threshold_no_move, threshold_label = 2 AS threshold_up FROM lab)", "ticker t:ts d:next_log_return i:label i:threshold_label i:threshold_down i:threshold_no_move i:threshold_up"),
    "labels_vol": out("(SELECT *, least(greatest(r / greatest(past_std, 1e-8), -3), 3) AS vol_target_clipped, (r - past_mean) / greatest(past_std, 1e-8) AS z_return, vol_direction_label = 0 AS vol_down, vol_direction_label = 2 AS vol_up FROM lab)", "ticker t:ts d:vol_threshold d:vol_target_clipped d:z_return i:vol_direction_label i:vol_down i:vol_up"),
    "labels_event": out("(SELECT *, label AS event_direction, CASE WHEN event_label = 1 AND r > 0 THEN 2 WHEN event_label = 1 THEN 0 ELSE 1 END AS event_signed, CASE WHEN event_threshold > 1e-8 THEN least(abs(r) / event_threshold, 5) ELSE 0 END AS event_magnitude FROM lab)", "ticker t:ts d:event_threshold i:event_label i:event_direction i:event_signed d:event_magnitude"),
    "labels_rank": out("(SELECT *, CASE WHEN count(*) OVER (PARTITION BY split, ts) = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY split, ts ORDER BY r, ticker) - 1) / nullif(count(*) OVER (PARTITION BY split, ts) - 1, 0) END AS cross_sectional_rank FROM spl)", "ticker t:ts split d:cross_sectional_rank"),
    "label_variants": out("(SELECT *, abs(r) > vol_threshold AS vol_expansion, r - avg(r) OVER (PARTITION BY ts) AS residual_return, r - avg(r) OVER (PARTITION BY ts) > 0 AS residual_direction FROM lab)", "ticker t:ts i:vol_expansion d:residual_return i:residual_direction"),
    "split_global_time": with_steps("SELECT split, count(*) AS n, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM spl GROUP BY split"),
    "split_per_ticker": with_steps("""SELECT ticker, split, sum(k)::BIGINT AS n, count(*) AS sequences FROM (SELECT *, CASE WHEN b < floor(n * 0.7::DOUBLE) THEN 'train' WHEN b < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, coalesce(sum(k) OVER (PARTITION BY ticker ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(k) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker, seq_id, count(*) AS k, min(ts) AS f FROM seq GROUP BY ALL))) GROUP BY ticker, split"""),
    "split_overlap": with_steps("""SELECT count(*) FILTER (a AND b)::BIGINT AS train_val, count(*) FILTER (a AND c)::BIGINT AS train_test, count(*) FILTER (b AND c)::BIGINT AS val_test, max(ts) FILTER (a) < min(ts) FILTER (b) AND max(ts) FILTER (b) < min(ts) FILTER (c) AS ordered
        FROM (SELECT ts, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM spl GROUP BY ts)"""),
    "coverage": with_steps("SELECT count(*) AS rows_total, count(*) FILTER (split = 'train') AS rows_train, count(DISTINCT ticker) AS tickers, count(DISTINCT ts::DATE) AS days, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM spl"),
    "normalize_train": with_steps("SELECT ticker, ts::VARCHAR AS ts, split, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM spl WHERE split = 'train')) / (SELECT greatest(stddev_pop({c}), 1e-8) FROM spl WHERE split = 'train'), 6) + 0.0::DOUBLE AS {c}" for c in ("log_return", "relative_volume", "close_position")) + " FROM spl"),
    "walk_forward_folds": out("fold", "i:fold split t:first_day t:last_day"),
    "embargo_retrain": with_steps("SELECT fold::BIGINT AS fold, split, ticker, count(*) AS n, max(ts)::VARCHAR AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY fold, split, ticker ORDER BY ts DESC) AS rn FROM frow) WHERE split = 'test' OR rn > 3 GROUP BY ALL"),
    "embargo_eval": with_steps("SELECT fold::BIGINT AS fold, count(*) AS n, min(ts)::VARCHAR AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ts, ticker) AS rn FROM frow WHERE split = 'test') WHERE rn > 7 GROUP BY fold"),
    "metrics_confusion": out("""(SELECT *, (recall + specificity) / 2 AS balanced_accuracy, 2 * prec * recall / (prec + recall) AS f1_pos, 2 * npv * specificity / (npv + specificity) AS f1_neg,
        (2 * prec * recall / (prec + recall) + 2 * npv * specificity / (npv + specificity)) / 2 AS macro_f1, (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc
        FROM (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / (tp + fp) AS prec, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, tn / (tn + fn) AS npv FROM (SELECT count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp,
        count(*) FILTER (p < 0.5 AND label = 0) AS tn, count(*) FILTER (p < 0.5 AND label = 1) AS fn, avg(pow(p - label, 2)) AS brier FROM pred)))""", "i:tp i:fp i:tn i:fn " + doubles("brier accuracy prec recall specificity balanced_accuracy f1_pos f1_neg macro_f1 mcc".split())),
    "metrics_auc": out("(SELECT (sum(rk) FILTER (label = 1) - npos * (npos + 1) / 2) / (npos * (n - npos)) AS auc FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk, sum(label) OVER ()::DOUBLE AS npos, count(*) OVER () AS n FROM pred) GROUP BY npos, n)", "d:auc"),
    "metrics_ap": out("(SELECT avg(tp / rn) AS average_precision FROM (SELECT label, row_number() OVER (ORDER BY p DESC, row_id) AS rn, sum(label) OVER (ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING) AS tp FROM pred) WHERE label = 1)", "d:average_precision"),
    "metrics_ece": out("(SELECT sum(n * abs(acc - conf)) / sum(n) AS ece FROM (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(label) AS acc, avg(p) AS conf FROM pred GROUP BY 1))", "d:ece"),
    "metrics_returns": out(f"""(SELECT avg(0.5 * (ln({TWO_PI}::DOUBLE) + 2 * ln(s) + z * z)) AS gaussian_nll, avg(-({math.lgamma(2.0) - math.lgamma(1.5) - 0.5 * math.log(3 * math.pi)!r}::DOUBLE - ln(s) - 2 * ln(1 + z * z / 3))) AS student_t_nll,
        avg(abs(mu - ret)) AS mae, sqrt(avg((mu - ret) * (mu - ret))) AS rmse, avg(mu) AS mean_pred, avg(ret) AS mean_actual FROM (SELECT *, (ret - mu) / s AS z FROM (SELECT *, ln(1 + exp(log_scale)) + 1e-6 AS s FROM pred)))""", doubles("gaussian_nll student_t_nll mae rmse mean_pred mean_actual".split())),
    "pos_weight": out("(SELECT (count(*) - sum(label)) / sum(label) AS pos_weight FROM pred)", "d:pos_weight"),
    "reliability": out(f"(SELECT count(*) AS n, avg({HIT}) AS hit_rate FROM pred WHERE greatest(p, 1 - p) >= 0.7)", "i:n d:hit_rate"),
    "confidence_buckets": with_steps(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, count(*) AS n, round(avg({HIT}), 6) + 0.0::DOUBLE AS hit_rate, round(avg(CASE WHEN p >= 0.5 THEN ret ELSE -ret END), 6) + 0.0::DOUBLE AS signed_return FROM (SELECT *, {in_top(s, 'greatest(p, 1 - p)')} AS chosen FROM pred) WHERE chosen" for s in (0.05, 0.1, 0.2))),
    "uncertainty_buckets": out("""(SELECT bucket, count(*) AS n, avg(abs(mu - ret)) AS mae, median(sigma) AS median_sigma FROM (SELECT *, CASE WHEN sigma <= lo THEN 'low' WHEN sigma <= hi THEN 'medium' ELSE 'high' END AS bucket FROM pred,
        (SELECT max(sigma) FILTER (rn = floor(0.33::DOUBLE * (n - 1))) AS lo, max(sigma) FILTER (rn = floor(0.66::DOUBLE * (n - 1))) AS hi FROM (SELECT sigma, row_number() OVER (ORDER BY sigma) - 1 AS rn, count(*) OVER () AS n FROM pred))) GROUP BY bucket)""", "bucket i:n d:mae d:median_sigma"),
    "loss_focal": out("(SELECT avg(-ln(pt) * pow(1 - pt, 2)) AS focal_loss FROM (SELECT CASE WHEN label = 1 THEN q ELSE 1 - q END AS pt FROM (SELECT label, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM pred)))", "d:focal_loss"),
    "loss_smoothness": out(f"(SELECT coalesce(avg(pow(mu - b, 2)), 0) AS smoothness_loss FROM (SELECT mu, lag(mu) OVER ({TICKER}) AS b, date_diff('second', lag(ts) OVER ({TICKER}), ts) AS gap FROM pred) WHERE gap BETWEEN 0 AND 3600)", "d:smoothness_loss"),
    "loss_pairwise_rank": out("(SELECT avg(ln(1 + exp(-(a.mu - b.mu)))) AS pairwise_rank_loss FROM pred a JOIN pred b USING (ts) WHERE a.ret > b.ret)", "d:pairwise_rank_loss"),
    "loss_vol_consistency": out("(SELECT avg(pow(greatest(abs(mu) - 3 * sigma, 0), 2)) AS vol_consistency_loss FROM pred)", "d:vol_consistency_loss"),
    "precision_at_k": out(f"(SELECT count(*) AS k, avg(label) AS precision_at_k FROM (SELECT *, {in_top(0.1, 'abs(score)')} AS chosen FROM pred) WHERE chosen)", "i:k d:precision_at_k"),
    "temperature_scaling": out(best(), doubles("temperature nll_before nll_after brier_before brier_after".split()) + " i:n"),
    "bucket_temperature": out(f"(SELECT * REPLACE (CASE WHEN n >= 50 THEN temperature ELSE (SELECT temperature FROM {best()}) END AS temperature) FROM {best('bucket')})", "bucket " + doubles("temperature nll_before nll_after brier_before brier_after".split()) + " i:n"),
    "isotonic_bucket": out("""(SELECT bucket, step, upper, max(rate) OVER (PARTITION BY bucket ORDER BY step ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT ticker AS bucket, least((rn - 1) // greatest(1, n // 10), 9) AS step, max(p) AS upper, avg(label) AS rate
        FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY p, row_id) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM pred) GROUP BY ALL))""", "bucket i:step d:upper d:value"),
    "mc_dropout": out("""(SELECT avg(sd) AS mean_std, avg(-(q * ln(q) + (1 - q) * ln(1 - q))) AS mean_entropy, avg((sd >= 0.10)::INT::DOUBLE) AS high_share FROM (SELECT row_id, stddev_pop(v) AS sd, least(greatest(avg(v), 1e-8), 1 - 1e-8) AS q
        FROM (SELECT row_id, least(1.0, greatest(0.0, p + (k - 2) * (row_id % 7) / 60.0::DOUBLE)) AS v FROM pred, range(5) t(k)) GROUP BY row_id))""", "d:mean_std d:mean_entropy d:high_share"),
    "action_scores": out("(SELECT row_id, (raw - avg(raw) OVER ()) / stddev_pop(raw) OVER () AS score FROM (SELECT row_id, sign(p - 0.5) * mu / greatest(sigma, 0.1) AS raw FROM pred))", "i:row_id d:score"),
    "spearman_ic": out("""(SELECT ts, count(*) AS n, CASE WHEN min(ra) = max(ra) OR min(rb) = max(rb) THEN NULL ELSE corr(ra, rb) END AS ic FROM (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY score) + (count(*) OVER (PARTITION BY ts, score) - 1) / 2.0::DOUBLE AS ra,
        rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2.0::DOUBLE AS rb FROM pred) GROUP BY ts HAVING count(*) >= 4)""", "t:ts i:n d:ic"),
    "top_bottom_spread": out("""(SELECT ts, avg(ret) FILTER (d <= k) - avg(ret) FILTER (u <= k) AS spread FROM (SELECT *, greatest(1, floor(n * 0.1)) AS k FROM (SELECT ts, ret, count(*) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY score, ticker) AS u,
        row_number() OVER (PARTITION BY ts ORDER BY score DESC, ticker) AS d FROM pred)) WHERE n >= 4 GROUP BY ts)""", "t:ts d:spread"),
    "backtest_positions": out("ex_agree", "i:row_id i:signal i:position d:turnover d:gross d:net"),
    "backtest_long_short": out("ex_sep", "i:row_id i:signal i:position d:net"),
    "backtest_summary": out(figures("ex_top"), doubles("net_pnl gross_pnl cost_pnl slippage_pnl sharpe".split()) + " i:trades i:long_bars i:short_bars i:flat_bars " + doubles("hit_rate max_drawdown final_equity".split())),
    "equity_curve": out(f"({EQUITY.format(ex='ex_top')})", "i:row_id d:equity d:drawdown"),
    "threshold_sweep": " UNION ALL ".join("SELECT * FROM (" + out(f"(SELECT *, {c}::DOUBLE AS threshold FROM {figures(f'ex_{int(c * 100)}')})", "threshold d:net_pnl i:trades i:long_bars i:short_bars d:hit_rate d:max_drawdown") + ")" for c in (0.55, 0.6, 0.65, 0.7)),
    "execution_costs": out("""(SELECT *, spread_bps + impact_bps AS total_bps FROM (SELECT *, CASE WHEN rq <= 1e-12 THEN 0 WHEN rq <= max_pov THEN 1 ELSE max_pov / rq END AS filled, 6.0 * sqrt(greatest(sigma, 1e-8) / 0.001) * penalty AS spread_bps, (25.0 * rq + 10000.0 * greatest(sigma, 1e-8) * 0.05) * penalty AS impact_bps
        FROM (SELECT *, CASE bar_type WHEN 'open_auction' THEN 0.05 WHEN 'close_auction' THEN 0.05 ELSE 0.03 END::DOUBLE AS max_pov, CASE WHEN bar_type <> 'regular' THEN 1.0 WHEN row_id < 2 THEN 1.5 WHEN row_id >= greatest(0, n - 2) THEN 1.35 ELSE 1.0 END::DOUBLE AS penalty
        FROM (SELECT *, abs(score) * 0.02::DOUBLE AS rq, count(*) OVER () AS n, CASE WHEN ts::TIME <= TIME '09:30:00' THEN 'open_auction' WHEN ts::TIME >= TIME '15:55:00' THEN 'close_auction' ELSE 'regular' END AS bar_type FROM pred))))""", "i:row_id bar_type d:max_pov d:penalty d:filled d:spread_bps d:impact_bps d:total_bps"),
    "regime_features": out("reg", "t:ts d:z_return d:z_vol d:z_lag"),
    "regime_states": out("sta", "t:ts i:state"),
    "transition_matrix": out("""(SELECT a.s AS prev_state, b.s AS state, (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY a.s) AS p FROM range(3) a(s), range(3) b(s)
        LEFT JOIN (SELECT b AS prev, state AS cur, count(*) AS n FROM (SELECT state, lag(state) OVER (ORDER BY ts) AS b FROM sta) GROUP BY ALL) x ON x.prev = a.s AND x.cur = b.s)""", "i:prev_state i:state d:p"),
    "regime_policy": with_steps("SELECT row_id::BIGINT AS row_id, CASE row_id % 3 WHEN 0 THEN pos WHEN 1 THEN -pos ELSE CASE WHEN greatest(p_up, p_down) >= 0.7 THEN pos ELSE 0 END END::BIGINT AS position FROM (SELECT *, CASE WHEN p_up > p_down THEN 1 ELSE -1 END AS pos FROM pred)"),
    "bh_fdr": out("""(SELECT test_id, p_value, rank, rank <= l AS rejected, l / m * 0.9::DOUBLE AS threshold FROM (SELECT *, coalesce(max(rank) FILTER (p_value <= rank / m * 0.9::DOUBLE) OVER (), 0) AS l FROM (SELECT *, row_number() OVER (ORDER BY p_value, test_id) AS rank, count(*) OVER () AS m FROM pv)))""", "test_id d:p_value i:rank rejected d:threshold"),
    "return_moments": out("""(SELECT n, m AS mean, sd AS std, m / sd AS sharpe, m3 / pow(sd, 3) AS skew, m4 / pow(sd, 4) AS kurt FROM (SELECT count(*) AS n, any_value(m) AS m, any_value(sd) AS sd, avg(pow(net - m, 3)) AS m3, avg(pow(net - m, 4)) AS m4 FROM ex_top, (SELECT avg(net) AS m, stddev_pop(net) AS sd FROM ex_top)))""", "i:n " + doubles("mean std sharpe skew kurt".split())),
    "bootstrap_rc": out("(SELECT observed, avg((m >= observed)::INT::DOUBLE) AS p_value FROM (SELECT rep, max(m) AS m FROM (SELECT strategy, rep, s1 / n AS m FROM draws) GROUP BY rep), (SELECT max(m) AS observed FROM (SELECT avg(ret) AS m FROM strat GROUP BY strategy)) GROUP BY observed)", "d:observed d:p_value"),
    "bootstrap_spa": out("(SELECT observed, avg((s >= observed)::INT::DOUBLE) AS p_value FROM (SELECT rep, greatest(0, max(s)) AS s FROM (SELECT strategy, rep, s1 / n / greatest(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)), 1e-8) * sqrt(n) AS s FROM draws) GROUP BY rep), (SELECT greatest(0, max(s)) AS observed FROM (SELECT avg(ret) / greatest(stddev_pop(ret), 1e-8) * sqrt(count(*)) AS s FROM strat GROUP BY strategy)) GROUP BY observed)", "d:observed d:p_value"),
}


def ridge_steps(rows: str, names: list[str], target: str, by: str, sizes: list[int]) -> str:
    """Steps fit(by, size, w, b): ridge fits on the first `size` of the features, by elimination on their standardised co-moments."""
    b = f"{by}, " if by else ""
    m = len(names)
    pairs = ", ".join("[" + ", ".join(f"covar_pop({x}, {y})" for y in (*names, target)) + "]" for x in names)
    return f"""mom AS (SELECT {b}n, mean, cov, list_transform(range(1, {m + 1}), lambda i: greatest(sqrt(cov[i][i]), 1e-8::DOUBLE)) AS sd
            FROM (SELECT {b}count(*) AS n, [{', '.join(f'avg({c})' for c in (*names, target))}] AS mean, [{pairs}] AS cov FROM {rows}{f' GROUP BY {by}' if by else ''})),
        elim AS (SELECT {b}size, 0 AS k, list_transform(range(1, size + 1), lambda i: list_append(list_transform(range(1, size + 1), lambda j: cov[i][j] / (sd[i] * sd[j]) * n + CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END), cov[i][{m + 1}] / sd[i] * n)) AS a
            FROM mom, (SELECT unnest({sizes}) AS size)
            UNION ALL SELECT {b}size, k + 1, list_transform(range(1, size + 1), lambda i: list_transform(range(1, size + 2), lambda j: CASE WHEN i = k + 1 THEN a[i][j] / a[i][i] ELSE a[i][j] - a[i][k + 1] / a[k + 1][k + 1] * a[k + 1][j] END)) FROM elim WHERE k < size),
        fit AS (SELECT {b}size, w, mean[{m + 1}] - list_sum(list_transform(range(1, size + 1), lambda i: w[i] * mean[i])) AS b FROM (
            SELECT {b}size, mean, list_transform(range(1, size + 1), lambda i: a[i][size + 1] / sd[i]) AS w FROM elim JOIN mom {f'USING ({by})' if by else 'ON true'} WHERE k = size))"""


WALK = ["log_return", "close_position", "relative_volume", "rolling_volatility"]
_WALK_STEPS = f"""wrow AS (SELECT fold, split, lab.*, row_number() OVER (PARTITION BY fold, split, ticker ORDER BY ts DESC) AS back FROM lab JOIN fold ON ts::DATE BETWEEN first_day AND last_day),
        wtrain AS (SELECT * FROM wrow WHERE split = 'train' AND back > 2), {ridge_steps('wtrain', WALK, 'label', 'fold', [len(WALK)])},
        scored AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ts, ticker) - 1 AS row_id FROM (SELECT r.fold, ticker, ts, label, close, next_close, round(least(greatest(b + {' + '.join(f'w[{i + 1}] * {c}' for i, c in enumerate(WALK))}, 1e-6), 1 - 1e-6), 9) AS p
            FROM wrow r JOIN fit USING (fold) WHERE split = 'test')),
        traded AS (SELECT *, position * (next_close - close) / close - 1.5 / 1e4 * turnover AS net FROM (SELECT *, abs(position - lag(position, 1, 0) OVER (PARTITION BY fold ORDER BY row_id))::DOUBLE AS turnover
            FROM (SELECT *, lag(sign(2 * p - 1), 1, 0) OVER (PARTITION BY fold ORDER BY row_id) AS position FROM scored))),
        grown AS (SELECT fold, row_id, product(1 + net) OVER (PARTITION BY fold ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS equity FROM traded),
        drawn AS (SELECT fold, least(min((equity - peak) / peak), 0) AS max_drawdown FROM (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY fold ORDER BY row_id ROWS UNBOUNDED PRECEDING)) AS peak FROM grown) GROUP BY fold),
        ranked AS (SELECT fold, (sum(rk) FILTER (label = 1) - npos * (npos + 1) / 2) / (npos * (n - npos)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2 AS rk,
            sum(label) OVER (PARTITION BY fold)::DOUBLE AS npos, count(*) OVER (PARTITION BY fold) AS n FROM scored) GROUP BY fold, npos, n),
        cells AS (SELECT fold, sum(n * abs(acc - conf)) / sum(n) AS ece FROM (SELECT fold, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(label) AS acc, avg(p) AS conf FROM scored GROUP BY ALL) GROUP BY fold),
        reports AS (SELECT fold, test_rows, first_ts, last_ts, accuracy, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy, brier, auc, ece, net_pnl, sharpe, trades, long_bars, short_bars, hit_rate, max_drawdown
            FROM (SELECT fold, count(*) AS test_rows, min(ts) AS first_ts, max(ts) AS last_ts, avg({HIT}) AS accuracy, avg(pow(p - label, 2)) AS brier, count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp,
                count(*) FILTER (p < 0.5 AND label = 0) AS tn, count(*) FILTER (p < 0.5 AND label = 1) AS fn FROM scored GROUP BY fold)
            JOIN (SELECT fold, sum(net) AS net_pnl, avg(net) / stddev_pop(net) * sqrt(19656) AS sharpe, count(*) FILTER (turnover > 0) AS trades, count(*) FILTER (position > 0) AS long_bars, count(*) FILTER (position < 0) AS short_bars,
                coalesce(avg((net > 0)::INT::DOUBLE) FILTER (position <> 0), 0) AS hit_rate FROM traded GROUP BY fold) USING (fold) JOIN drawn USING (fold) JOIN ranked USING (fold) JOIN cells USING (fold))"""


ORACLE_SQL["walk_forward_evaluation"] = recursive(_WALK_STEPS, "SELECT " + picked("i:fold i:test_rows t:first_ts t:last_ts " + doubles("accuracy balanced_accuracy brier auc ece net_pnl sharpe".split()) + " i:trades i:long_bars i:short_bars d:hit_rate d:max_drawdown") + " FROM reports")
ORACLE_SQL["walk_forward_summary"] = recursive(_WALK_STEPS, "SELECT " + picked("i:fold_count i:test_total_rows " + doubles("test_mean_rows auc_mean auc_std accuracy_mean accuracy_std sharpe_mean".split())) + """ FROM (
    SELECT count(*) AS fold_count, sum(test_rows) AS test_total_rows, avg(test_rows) AS test_mean_rows, avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std, avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std, avg(sharpe) AS sharpe_mean FROM reports)""")

_STAGES = (("base_price_only", features.BASE), ("plus_volume", features.VOLUME), ("plus_market", features.MARKET), ("plus_time", features.TIME), ("plus_cross_sectional", ("cs_rank", "cs_z")))
_NAMES = [c for _, family in _STAGES for c in family]
_SIZES = [sum(len(f) for _, f in _STAGES[: k + 1]) for k in range(len(_STAGES))]
ORACLE_SQL["ablation_ridge"] = recursive(
    f"""crow AS (SELECT *, {rank01('log_return')} AS cs_rank, {zscore('log_return')} AS cs_z FROM spl), ctrain AS (SELECT * FROM crow WHERE split = 'train'), {ridge_steps('ctrain', _NAMES, 'r', '', _SIZES)},
        guessed AS (SELECT size, r, b + list_sum(list_transform(range(1, size + 1), lambda i: w[i] * f[i])) AS guess FROM (SELECT r, [{', '.join(_NAMES)}] AS f FROM crow WHERE split = 'test'), fit)""",
    f"""SELECT {picked('stage i:n_features i:n d:mae d:rmse d:corr')} FROM (SELECT CASE size {' '.join(f"WHEN {n} THEN '{s}'" for n, (s, _) in zip(_SIZES, _STAGES, strict=True))} END AS stage,
        size AS n_features, count(*) AS n, avg(abs(guess - r)) AS mae, sqrt(avg(pow(guess - r, 2))) AS rmse, corr(guess, r) AS corr FROM guessed GROUP BY size)""",
)
ORACLE_SQL["calibrated_scores"] = f"""SELECT row_id::BIGINT AS row_id, round(p, 6) + 0.0::DOUBLE AS p, round(1 / (1 + exp(-ln(q / (1 - q)) / temperature)), 6) + 0.0::DOUBLE AS p_temperature,
    round(coalesce(reached, top), 6) + 0.0::DOUBLE AS p_isotonic FROM (SELECT x.*, {P_SAFE} AS q, t.temperature, (SELECT arg_min(value, step) FROM ({ORACLE_SQL['isotonic_bucket'].replace('round(upper, 6) + 0.0::DOUBLE', 'upper').replace('round(value, 6) + 0.0::DOUBLE', 'value')}) s WHERE s.bucket = x.ticker AND s.upper >= x.p) AS reached,
    (SELECT arg_max(value, step) FROM ({ORACLE_SQL['isotonic_bucket'].replace('round(upper, 6) + 0.0::DOUBLE', 'upper').replace('round(value, 6) + 0.0::DOUBLE', 'value')}) s WHERE s.bucket = x.ticker) AS top
    FROM ({with_steps('SELECT * FROM pred')}) x JOIN ({ORACLE_SQL['bucket_temperature'].replace('round(temperature, 6) + 0.0::DOUBLE', 'temperature')}) t ON t.bucket = x.ticker)"""
ORACLE_SQL["metric_bundle"] = "SELECT * FROM " + ", ".join(f"({ORACLE_SQL[f'metrics_{n}']})" for n in ("confusion", "auc", "ap", "ece", "returns"))
ORACLE_SQL["bucket_backtests"] = " UNION ALL ".join(
    "SELECT * FROM (" + with_steps(f"""SELECT {q}::DOUBLE AS share, count(*) AS n, round(sum(net), 6) + 0.0::DOUBLE AS net_pnl, round(avg(net) / stddev_pop(net) * sqrt(19656), 6) + 0.0::DOUBLE AS sharpe, count(*) FILTER (turnover > 0) AS trades,
        count(*) FILTER (position > 0) AS long_bars, count(*) FILTER (position < 0) AS short_bars, round(coalesce(avg((net > 0)::INT::DOUBLE) FILTER (position <> 0), 0), 6) + 0.0::DOUBLE AS hit_rate, round(least(min(dd), 0), 6) + 0.0::DOUBLE AS max_drawdown
        FROM (SELECT *, equity / greatest(1.0, max(equity) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM (SELECT *, product(1 + net) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS equity
        FROM (SELECT *, position * (next_close - close) / close - 1.5 / 1e4 * turnover AS net FROM (SELECT *, abs(position - lag(position, 1, 0) OVER (ORDER BY row_id))::DOUBLE AS turnover FROM (
        SELECT *, lag({by_sign(EDGE)}, 1, 0) OVER (ORDER BY row_id) AS position FROM (SELECT *, {in_top(q, 'greatest(p, 1 - p)')} AS chosen FROM pred) WHERE chosen)))))""") + ")"
    for q in (0.05, 0.1, 0.2)
)
_TAIL_SQL = lambda z: f"(exp(-({z}) * ({z}) / 2) / sqrt({TWO_PI}::DOUBLE) * (" + " + ".join(f"({c})::DOUBLE * pow(1 / (1 + {NEAR}::DOUBLE * abs({z})), {i + 1})" for i, c in enumerate(TAIL)) + "))"
_UPPER = lambda z: f"CASE WHEN ({z}) >= 0 THEN {_TAIL_SQL(z)} ELSE 1 - {_TAIL_SQL(z)} END"
_LUCK = (1 - EULER) * NORMAL.inv_cdf(1 - 1 / 5) + EULER * NORMAL.inv_cdf(1 - 1 / (5 * math.e))
_TRIALS = " UNION ALL ".join(f"SELECT '{n}' AS strategy, row_id, net FROM {ex}" for n, ex in [("primary", "ex_top"), *[(f"{c}", f"ex_{int(c * 100)}") for c in (0.55, 0.6, 0.65, 0.7)]])
_OWN = STEPS["draws"].replace("FROM strat, range(500) r(rep)", "FROM own, range(500) r(rep)")
ORACLE_SQL["selection_bias_controls"] = "WITH " + ",\n".join([*[f"{n} AS ({STEPS[n]})" for n in needed(_TRIALS)], f"trial AS ({_TRIALS})", "own AS (SELECT strategy, row_id AS t, net AS ret FROM trial WHERE row_id > 0)", f"drawn AS ({_OWN})"]) + f"""
SELECT round(sr, 6) + 0.0::DOUBLE AS observed_sharpe, round(benchmark, 6) + 0.0::DOUBLE AS benchmark_sharpe, round(z, 6) + 0.0::DOUBLE AS z, round({_UPPER('z')}, 6) + 0.0::DOUBLE AS p_value, trials, n AS sample_length,
    round(rc, 6) + 0.0::DOUBLE AS reality_check_p, round(spa, 6) + 0.0::DOUBLE AS spa_p, candidates, discoveries
FROM (SELECT *, (sr - benchmark) * sqrt(greatest(2, n) - 1) / sqrt(greatest(1e-8, 1 - skew * sr + (kurt - 1) * sr * sr / 4)) AS z FROM
    (SELECT count(*) AS n, any_value(m) / any_value(sd) AS sr, avg(pow(ret - m, 3)) / pow(any_value(sd), 3) AS skew, avg(pow(ret - m, 4)) / pow(any_value(sd), 4) AS kurt FROM own, (SELECT avg(ret) AS m, stddev_pop(ret) AS sd FROM own WHERE strategy = 'primary') WHERE strategy = 'primary'),
    (SELECT avg(s) + greatest(stddev_pop(s), 1e-8) * {_LUCK!r}::DOUBLE AS benchmark, count(*) AS trials FROM (SELECT avg(net) / stddev_pop(net) * sqrt(19656) AS s FROM trial GROUP BY strategy)),
    (SELECT avg((m >= o)::INT::DOUBLE) AS rc FROM (SELECT rep, max(s1 / n) AS m FROM drawn GROUP BY rep), (SELECT max(m) AS o FROM (SELECT avg(ret) AS m FROM own GROUP BY strategy))),
    (SELECT avg((s >= o)::INT::DOUBLE) AS spa FROM (SELECT rep, greatest(0, max(s1 / n / greatest(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)), 1e-8) * sqrt(n))) AS s FROM drawn GROUP BY rep), (SELECT greatest(0, max(m)) AS o FROM (SELECT avg(ret) / greatest(stddev_pop(ret), 1e-8) * sqrt(count(*)) AS m FROM own GROUP BY strategy))),
    (SELECT count(*) AS candidates, coalesce(max(rank) FILTER (p <= rank / 5.0::DOUBLE * 0.1), 0)::BIGINT AS discoveries FROM (SELECT p, row_number() OVER (ORDER BY p, strategy) AS rank FROM (SELECT strategy, {_UPPER('m')} AS p FROM (SELECT strategy, avg(ret) / sqrt(greatest(1e-12, var_samp(ret)) / count(*)) AS m FROM own GROUP BY strategy)))))"""
ORACLE_SQL["ticker_subset"] = out("(SELECT * FROM (SELECT ticker || '-' || hour(ts) AS ticker, ts, close FROM bars) WHERE ticker IN (SELECT ticker FROM (SELECT DISTINCT ticker || '-' || hour(ts) AS ticker FROM bars) ORDER BY md5('42:' || ticker), ticker LIMIT 7))", "ticker t:ts d:close")
_AWAY = [" + ".join(f"pow({c} - c{k}_{c}, 2)" for c in ("z_return", "z_vol", "z_lag")) for k in range(3)]
_NEAREST = f"CASE WHEN {_AWAY[0]} <= {_AWAY[1]} AND {_AWAY[0]} <= {_AWAY[2]} THEN 0 WHEN {_AWAY[1]} <= {_AWAY[2]} THEN 1 ELSE 2 END"
_CENTRES = [(k, c) for k in range(3) for c in ("z_return", "z_vol", "z_lag")]
ORACLE_SQL["regime_kmeans"] = recursive(
    f"""km AS (SELECT 0 AS it, {', '.join(f'avg({c}) FILTER (state = {k}) AS c{k}_{c}' for k, c in _CENTRES)} FROM sta
        UNION ALL SELECT it + 1, {', '.join(f'coalesce(avg({c}) FILTER (a = {k}), any_value(c{k}_{c}))' for k, c in _CENTRES)} FROM (SELECT *, {_NEAREST} AS a FROM km, reg WHERE it < 20) GROUP BY it)""",
    f"SELECT ts::VARCHAR AS ts, ({_NEAREST})::BIGINT AS state FROM km, reg WHERE it = 20",
)
ORACLE_SQL["event_composition"] = out("""(SELECT row_id, (r > 0)::INT AS label, p_up, p_down, p_neutral, greatest(p_up, p_down) AS confidence, CASE WHEN p_up + p_down > 1e-8 THEN p_up / (p_up + p_down) ELSE 0.5 END AS p
    FROM (SELECT row_id, ret AS r, least(greatest(e * p, 0), 1) AS p_up, least(greatest(e * (1 - p), 0), 1) AS p_down, least(greatest(1 - e, 0), 1) AS p_neutral FROM (SELECT *, least(1.0::DOUBLE, abs(ret) * 20) AS e FROM pred)) WHERE abs(r) >= 0.02)""",
    "i:row_id i:label d:p_up d:p_down d:p_neutral d:confidence d:p")
_CE = lambda p, y: f"CASE WHEN {y} >= 0.5 THEN -ln(least(greatest({p}, 1e-7), 1 - 1e-7)) WHEN {y} < 0.5 THEN -ln(1 - least(greatest({p}, 1e-7), 1 - 1e-7)) END"
_SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
_LOSSES = {
    "direction": (1.0, f"avg({_CE('p', 'y')})"), "event": (0.5, f"avg({_CE('pe', 'e')} * pow(1 - CASE WHEN e >= 0.5 THEN pe ELSE 1 - pe END, 2) * least(greatest(m, 0), 2))"),
    "event_direction": (0.5, f"avg(CASE WHEN e >= 0.5 THEN ({_CE('pd', 'y')}) * least(greatest(m, 0), 2) END)"),
    "regression": (1.0, "avg(CASE WHEN abs(mu - g) < 1 THEN pow(mu - g, 2) / 2 ELSE abs(mu - g) - 0.5 END)"),
    "score_alignment": (0.1, "avg(CASE WHEN g <> 0 THEN ln(1 + exp(-mu / greatest(s, 0.1) * CASE WHEN l < 0 THEN -1 ELSE 1 END * sign(g))) END)"), "volatility": (0.1, "avg(pow(greatest(abs(mu) / s - 2.5, 0), 2))"),
    "cross_section": (0.1, "avg(pow(greatest(abs(mu - mm) - 2.5, 0), 2))"), "calibration": (0.1, f"avg(CASE WHEN y IS NOT NULL THEN pow({_SIG('abs(l)')} - {_SIG('l * sign(mu)')}, 2) END)"),
    "threshold": (0.25, "avg(CASE WHEN tl IS NOT NULL OR g IS NOT NULL THEN -ln(greatest(CASE coalesce(tl, CASE WHEN g < -0.0005 THEN 0 WHEN g > 0.0005 THEN 2 WHEN g IS NOT NULL THEN 1 END) WHEN 0 THEN 0.8::DOUBLE * (1 - p) WHEN 1 THEN 0.2 WHEN 2 THEN 0.8::DOUBLE * p END, 1e-7)) END)"),
}
ORACLE_SQL["loss_multitask"] = with_steps(f"""SELECT {', '.join(f'round({n}, 6) + 0.0::DOUBLE AS {n}_loss' for n in _LOSSES)}, round(rank, 6) + 0.0::DOUBLE AS rank_loss, round(smoothness, 6) + 0.0::DOUBLE AS smoothness_loss,
    round({' + '.join(f'{w}::DOUBLE * {n}' for n, (w, _) in _LOSSES.items())} + 0.1::DOUBLE * rank + 0.1::DOUBLE * smoothness, 6) + 0.0::DOUBLE AS total FROM
    (SELECT {', '.join(f'coalesce({c}, 0) AS {n}' for n, (_, c) in _LOSSES.items())} FROM (SELECT p, mu, ln(1 + exp(log_scale)) + 1e-6 AS s, ln({P_SAFE.replace('1e-6', '1e-7')} / (1 - {P_SAFE.replace('1e-6', '1e-7')})) AS l, avg(mu) OVER () AS mm, CASE WHEN row_id % 5 <> 0 THEN label END AS y,
        CASE WHEN row_id % 7 <> 0 THEN ret END AS g, least(0.9::DOUBLE, abs(mu) * 200 + 0.05::DOUBLE) AS pe, 0.2::DOUBLE + 0.6::DOUBLE * p AS pd, CASE WHEN row_id % 3 <> 0 THEN (abs(ret) > 0.02)::INT END AS e, abs(ret) * 30 AS m, CASE WHEN row_id % 3 = 0 THEN 1 END AS tl FROM pred)),
    (SELECT coalesce(avg(ln(1 + exp(-(a.mu - b.mu)))), 0) AS rank FROM pred a JOIN pred b USING (ts) WHERE a.ret > b.ret AND a.row_id % 7 <> 0 AND b.row_id % 7 <> 0),
    (SELECT coalesce(avg(pow(mu - b, 2)), 0) AS smoothness FROM (SELECT mu, lag(mu) OVER ({TICKER}) AS b, date_diff('second', lag(ts) OVER ({TICKER}), ts) AS gap FROM pred) WHERE gap BETWEEN 0 AND 3600)""")
ORACLE_SQL["split_contamination"] = with_steps("""SELECT split, count(*) AS n, count(*) FILTER (k > 1) AS shared, count(*) FILTER (k > 1) > 0 AS risky FROM (SELECT split, count(DISTINCT split) OVER (PARTITION BY ts) AS k FROM (SELECT s.ts, p.split FROM seq s JOIN
    (SELECT ticker, seq_id, CASE WHEN b < floor(n * 0.7::DOUBLE) THEN 'train' WHEN b < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, coalesce(sum(k) OVER (PARTITION BY ticker ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(k) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker, seq_id, count(*) AS k, min(ts) AS f FROM seq GROUP BY ALL))) p USING (ticker, seq_id))) GROUP BY split""")
