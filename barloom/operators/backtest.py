"""Cost-aware backtests over a prediction set in row_id order.

row_id is dense and total: rows are numbered with per-timestamp offsets, lags are read within blocks of it, and running
products and extremes are two-level scans (within blocks of row_id, then over blocks), so that no task holds the whole order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import finite
from barloom.operators.metrics import BLOCK, meet, top_share
from barloom.operators.regimes import adapted
from barloom.staging import settled

PERIODS = 19_656


def numbered(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """row_id from 0 in (ts, ticker) order, in each group of `by`: offsets by timestamp, then places within it."""
    stamps = df.groupBy(*by, "ts").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    stamps = stamps.select(*by, "ts", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("at"))
    place = F.row_number().over(Window.partitionBy(*by, "ts").orderBy("ticker")) - 1
    return df.withColumn("place", place).join(stamps, [*by, "ts"]).withColumn("row_id", (F.col("at") + F.col("place")).cast("long")).drop("at", "place")


@dataclass(frozen=True)
class Rules:
    signal: str = "classification_prob"
    mu_weight: float = 0.5
    sigma_floor: float = 1e-6
    selection: str = "global_abs"
    top: float | Column | None = None
    long_short: float | None = None
    confidence: float | Column | None = None
    long_threshold: float = 0.55
    short_threshold: float = 0.55
    agree: bool = False
    flip: bool = False
    lag: int = 1
    cost_bps: float = 1.0
    slippage_bps: float = 0.5
    policies: Mapping[str, str] | None = None
    least_confidence: float = 0.7


def with_score(df: DataFrame, rules: Rules) -> DataFrame:
    """score by the signal source; a score that isn't finite is 0 and counted in bad_score."""
    edge = F.col("p_up") - F.col("p_down")
    raw = {
        "mu": F.col("mu"),
        "mu_over_sigma": F.col("mu") / F.greatest("sigma", F.lit(rules.sigma_floor)),
        "confidence_plus_mu": rules.mu_weight * edge + (1 - rules.mu_weight) * F.col("mu"),
    }.get(rules.signal, edge)
    df = df.withColumn("raw", raw)
    return df.withColumns({"bad_score": (~finite(F.col("raw"))).cast("int"), "score": F.when(finite(F.col("raw")), F.col("raw")).otherwise(0.0)}).drop("raw")


def with_signal(df: DataFrame, rules: Rules, by: Sequence[str] = ()) -> DataFrame:
    """signal in {-1, 0, 1} for every row, shares being those of its group; with policies, after that of the row's regime (a column of df, null: trending)."""
    df = with_score(df, rules)
    up, down, score = F.col("p_up"), F.col("p_down"), F.col("score")
    if rules.selection == "separate_long_short" and rules.long_short is not None:
        longs = top_share(df, rules.long_short, score, by).select(*by, "row_id", F.lit(1).alias("is_long"))
        shorts = top_share(df, rules.long_short, -score, by).select(*by, "row_id", F.lit(1).alias("is_short"))
        df = df.join(longs, [*by, "row_id"], "left").join(shorts, [*by, "row_id"], "left")
        both = F.col("is_long").isNotNull() & F.col("is_short").isNotNull()
        signal = F.when(both, F.when(score >= 0, 1).otherwise(-1)).when(F.col("is_long").isNotNull(), 1).when(F.col("is_short").isNotNull(), -1).otherwise(0)
        df = df.withColumn("signal", signal).drop("is_long", "is_short")
    else:
        by_up = lambda t: (up >= t) & (up > down)
        by_down = lambda t: (down >= t) & (down > up)
        if rules.confidence is not None:
            signal = F.when(by_up(rules.confidence), 1).when(by_down(rules.confidence), -1).otherwise(0)
        else:
            signal = F.when(score > 0, 1).when(score < 0, -1).when(by_up(rules.long_threshold), 1).when(by_down(rules.short_threshold), -1).otherwise(0)
        if rules.agree:
            signal = F.when(F.signum(signal.cast("double")) == F.when(up >= down, 1).otherwise(-1), signal).otherwise(0)
        df = df.withColumn("signal", signal)
        if rules.top is not None:
            key = F.abs(score) if rules.selection == "global_abs" else F.greatest(up, down)
            chosen = top_share(df, rules.top, key, by).select(*by, "row_id", F.lit(1).alias("chosen"))
            df = df.join(chosen, [*by, "row_id"], "left").withColumn("signal", F.when(F.col("chosen") == 1, F.col("signal")).otherwise(0)).drop("chosen")
    df = df.withColumn("signal", F.when(finite(up) & finite(down), F.col("signal")).otherwise(0))
    if rules.policies is not None:
        regime = F.coalesce("regime", F.lit("trending"))
        df = df.withColumn("signal", adapted(F.col("signal"), regime, F.greatest(up, down), dict(rules.policies), rules.least_confidence))
    return df.withColumn("signal", -F.col("signal")) if rules.flip else df


def shifted(df: DataFrame, column: str, lag: int, name: str, by: Sequence[str] = ()) -> DataFrame:
    """`column` of the row `lag` places before in its group, 0 at the head: a lag within blocks of row_id.

    The last `lag` rows of a block go to the next block as well, so that its first rows see them; df is read once.
    """
    if not 0 <= lag < BLOCK:
        raise ValueError(f"the lag must be from 0 to {BLOCK - 1}")
    if lag == 0:
        return df.withColumn(name, F.col(column))
    own = F.floor(F.col("row_id") / BLOCK)
    seen = F.when(F.col("row_id") % BLOCK >= BLOCK - lag, F.array(own, own + 1)).otherwise(F.array(own))
    df = df.withColumn("in_block", F.explode(seen))
    before = F.lag(column, lag).over(Window.partitionBy(*by, "in_block").orderBy("row_id"))
    return df.withColumn(name, F.coalesce(before, F.lit(0))).where(F.col("in_block") == own).drop("in_block")


def executed(df: DataFrame, rules: Rules, by: Sequence[str] = ()) -> DataFrame:
    """Positions after the execution lag, turnover, costs and returns of every row; each group of `by` is a backtest of its own."""
    df = shifted(with_signal(df, rules, by), "signal", rules.lag, "position", by)
    df = shifted(df, "position", 1, "previous", by)
    raw = F.when((F.col("close") > 0) & finite(F.col("close")) & finite(F.col("next_close")), (F.col("next_close") - F.col("close")) / F.when(F.col("close") > 0, F.col("close"))).otherwise(0.0)
    df = df.withColumns({"turnover": F.abs(F.col("position") - F.col("previous")).cast("double"), "gross": F.col("position") * raw})
    return df.withColumns(
        {"cost": rules.cost_bps / 1e4 * F.col("turnover"), "slippage": rules.slippage_bps / 1e4 * F.col("turnover")}
    ).withColumn("net", F.col("gross") - (rules.cost_bps + rules.slippage_bps) / 1e4 * F.col("turnover"))


def equity_curve(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, row_id, equity, drawdown): compounded net returns from 1.0; drawdown against the running peak, at least the start."""
    df = rows.select(*by, "row_id", "net", F.floor(F.col("row_id") / BLOCK).alias("block"))
    inner = Window.partitionBy(*by, "block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("grown", F.product(1 + F.col("net")).over(inner))
    blocks = df.groupBy(*by, "block").agg(F.max_by("grown", "row_id").alias("whole"), F.max("grown").alias("top"))
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.product("whole").over(before), F.lit(1.0)))
    blocks = blocks.withColumn("peak", F.greatest(F.lit(1.0), F.max(F.col("start") * F.col("top")).over(before)))
    df = df.join(blocks.select(*by, "block", "start", "peak"), [*by, "block"]).withColumn("equity", F.col("start") * F.col("grown"))
    peak = F.greatest("peak", F.max("equity").over(inner))
    return df.select(*by, "row_id", "equity", ((F.col("equity") - peak) / peak).alias("drawdown"))


def summary(rows: DataFrame, periods: int = PERIODS, *more: Column, by: Sequence[str] = ()) -> DataFrame:
    """One row of backtest figures for each group of `by`; `more` are further aggregates of the rows."""
    std = F.stddev_pop("net")
    active = F.col("position") != 0
    figures = rows.groupBy(*by).agg(
        F.sum("net").alias("net_pnl"), F.sum("gross").alias("gross_pnl"), F.sum("cost").alias("cost_pnl"), F.sum("slippage").alias("slippage_pnl"),
        F.when(std > 0, F.avg("net") / F.when(std > 0, std) * math.sqrt(periods)).otherwise(0.0).alias("sharpe"),
        F.count_if(F.col("turnover") > 0).alias("trades"), F.count_if(F.col("position") > 0).alias("long_bars"),
        F.count_if(F.col("position") < 0).alias("short_bars"), F.count_if(~active).alias("flat_bars"),
        F.coalesce(F.avg(F.when(active, (F.col("net") > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"), *more,
    )
    curve = equity_curve(rows, by).groupBy(*by)
    return meet(figures, curve.agg(F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"), F.max_by("equity", "row_id").alias("final_equity")), by)


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...] = (0.55, 0.60, 0.65, 0.70)) -> DataFrame:
    """One row per confidence threshold: the summary's figures. The threshold is a key: one pass runs all backtests."""
    df = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return summary(settled(executed(df, Rules(confidence=F.col("threshold")), ["threshold"])), by=["threshold"])


def share_sweep(df: DataFrame, shares: tuple[float, ...] = (0.1, 0.2, 0.4)) -> DataFrame:
    """One row per share of the strongest signals: the summary's figures, in one pass."""
    df = df.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return summary(settled(executed(df, Rules(top=F.col("share")), ["share"])), by=["share"])


def bucket_backtests(df: DataFrame, shares: tuple[float, ...] = (0.05, 0.10, 0.20), rules: Rules = Rules()) -> DataFrame:
    """One row per share of the most confident rows: n and the figures of a backtest of those rows alone, numbered anew."""
    df = df.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    chosen = top_share(df, F.col("share"), F.greatest(F.col("p"), 1 - F.col("p")), ["share"]).drop("row_id")
    return summary(settled(executed(numbered(settled(chosen), ["share"]), rules, ["share"])), PERIODS, F.count(F.lit(1)).alias("n"), by=["share"])


def equity_returns(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, row_id, ret) from the second row on: the step of the equity, 0 where the one before isn't positive or finite."""
    before = curve.select(*by, (F.col("row_id") + 1).alias("row_id"), F.col("equity").alias("before"))
    known = (F.col("before") > 0) & finite(F.col("before")) & finite(F.col("equity"))
    return curve.join(before, [*by, "row_id"]).select(*by, "row_id", F.when(known, F.col("equity") / F.when(known, F.col("before")) - 1).otherwise(0.0).alias("ret"))


def market_level(df: DataFrame) -> DataFrame:
    """(ts, close): the market's compounded level before each timestamp's mean return (at least -0.95), from 1.0.

    The series that regimes are found on: one row per timestamp.
    """
    raw = F.when((F.col("close") > 0) & finite(F.col("close")) & finite(F.col("next_close")), (F.col("next_close") - F.col("close")) / F.when(F.col("close") > 0, F.col("close"))).otherwise(0.0)
    stamps = df.groupBy("ts").agg(F.greatest(F.avg(raw), F.lit(-0.95)).alias("r"))
    before = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return stamps.select("ts", F.greatest(F.coalesce(F.product(1 + F.col("r")).over(before), F.lit(1.0)), F.lit(1e-8)).alias("close"))


@dataclass(frozen=True)
class Execution:
    notional: float = 0.02
    regular_max: float = 0.03
    open_max: float = 0.05
    close_max: float = 0.05
    open_bars: int = 2
    close_bars: int = 2
    use_open: bool = True
    use_close: bool = True
    base_spread: float = 6.0
    base_impact: float = 25.0
    sigma: float = 0.001
    reject: bool = False


def execution_costs(df: DataFrame, requested: Column, total: int | Column, model: Execution = Execution()) -> DataFrame:
    """bar_type, max_pov, penalty, filled, spread_bps, impact_bps, total_bps for a requested share of volume per row."""
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    opening, closing = (s <= 9 * 3600 + 1800) & F.lit(model.use_open), (s >= 15 * 3600 + 3300) & (s > 9 * 3600 + 1800) & F.lit(model.use_close)
    auction = opening | closing
    early, late = F.col("row_id") < model.open_bars, F.col("row_id") >= F.greatest(F.lit(0), F.lit(total) - model.close_bars)
    penalty = F.when(auction, 1.0).when(early, 1.5).when(late, 1.35).otherwise(1.0)
    cap = F.when(opening, model.open_max).when(closing, model.close_max).otherwise(model.regular_max)
    sigma = F.greatest(F.coalesce(F.col("sigma"), F.lit(0.001)), F.lit(1e-8))
    df = df.withColumns(
        {"requested": F.greatest(F.lit(0.0), requested), "bar_type": F.when(opening, "open_auction").when(closing, "close_auction").otherwise("regular"), "max_pov": cap, "penalty": penalty}
    )
    short = F.lit(0.0) if model.reject else F.col("max_pov") / F.when(F.col("requested") > 0, F.col("requested"))
    df = df.withColumns(
        {
            "filled": F.when(F.col("requested") <= 1e-12, 0.0).when(F.col("requested") <= F.col("max_pov"), 1.0).otherwise(short),
            "spread_bps": model.base_spread * F.sqrt(sigma / model.sigma) * F.col("penalty"),
            "impact_bps": (model.base_impact * F.col("requested") + 10000.0 * sigma * 0.05) * F.col("penalty"),
        }
    )
    return df.withColumn("total_bps", F.col("spread_bps") + F.col("impact_bps"))


def _fill(want: float, held: float, cap: float, model: Execution) -> float:
    share = max(0.0, model.notional * abs(want - held))
    if share <= 1e-12:
        return held
    return want if share <= cap else held if model.reject else held + (want - held) * (cap / share)


def _composed(xs: list[float], ys: list[float], want: float, move: float) -> tuple[list[float], list[float]]:
    """The map x to y, followed by a fill: y goes towards `want` by `move` at most.

    A fill is flat around `want` and has slope 1 elsewhere; so has what fills are composed to, between nodes.
    """
    for v in (want - move, want + move):
        for i in range(1, len(ys)):
            if ys[i - 1] < v < ys[i]:
                xs, ys = [*xs[:i], xs[i - 1] + (v - ys[i - 1]), *xs[i:]], [*ys[:i], v, *ys[i:]]
                break
    ys = [min(max(want, y - move), y + move) for y in ys]
    kept = [i for i in range(len(ys)) if not 0 < i < len(ys) - 1 or not ys[i - 1] == ys[i] == ys[i + 1]]
    return [xs[i] for i in kept], [ys[i] for i in kept]


def _block_map(wants: list[float], caps: list[float], model: Execution) -> tuple[list[float], list[float]]:
    """What a block's rows make of each position held before it: nodes of a piecewise linear map, or a table of -1, 0 and 1."""
    xs = [-1.0, 0.0, 1.0] if model.reject else [-1.0, 1.0]
    ys = list(xs)
    for want, cap in zip(wants, caps, strict=True):
        if model.reject or ys[0] == ys[-1] or model.notional <= 0:
            ys = [_fill(want, y, cap, model) for y in ys]
        else:
            xs, ys = _composed(xs, ys, want, cap / model.notional)
        if not model.reject and ys[0] == ys[-1]:
            xs, ys = [-1.0, 1.0], [ys[0]] * 2  # whatever was held before doesn't matter any more
    return xs, ys


def carried_fills(df: DataFrame, model: Execution = Execution(), by: Sequence[str] = ()) -> DataFrame:
    """filled: the position held after each row, the rows of a group in row_id order being one instrument; needs position and max_pov.

    A fill depends on the position before it, which is never beyond 1. Each block of row_id is first composed to one
    map from the position before to the position after it; a fold over one small row per block gives the position that
    each block begins with, and then blocks are filled each for itself: no task holds more than a block's rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)
    rows = df.select(*by, "row_id", F.col("position").cast("double").alias("position"), "max_pov", F.floor(F.col("row_id") / BLOCK).alias("block"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        xs, ys = _block_map(pdf["position"].tolist(), pdf["max_pov"].tolist(), model)
        return pd.DataFrame({**{c: pdf[c].iloc[:1].tolist() for c in by}, "block": [int(pdf["block"].iloc[0])], "xs": [xs], "ys": [ys]})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        held, out = 0.0, []
        for xs, ys in zip(pdf["xs"], pdf["ys"], strict=True):
            out.append(held)
            held = float(ys[int(np.abs(np.array(xs) - held).argmin())]) if model.reject else float(np.interp(held, xs, ys))
        return pdf[[*by, "block"]].assign(entry=out)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        held, out = float(pdf["entry"].iloc[0]), []
        for want, cap in zip(pdf["position"].tolist(), pdf["max_pov"].tolist(), strict=True):
            held = _fill(want, held, cap, model)
            out.append(held)
        return pdf[[*by, "row_id"]].assign(filled=out)

    maps = rows.groupBy(*by, "block").applyInPandas(compose, f"{keys}block long, xs array<double>, ys array<double>")
    entries = maps.groupBy(*by).applyInPandas(enter, f"{keys}block long, entry double")
    fills = rows.join(entries, [*by, "block"]).groupBy(*by, "block").applyInPandas(fill, f"{keys}row_id long, filled double")
    return df.join(fills, [*by, "row_id"])


def executed_with_costs(df: DataFrame, rules: Rules, model: Execution = Execution()) -> DataFrame:
    """executed() under an execution model: caps by bar type, partial fills, modelled costs, half of them slippage.

    position is what is held after the fill, wanted what was asked for; rejected marks a wanted move that got nothing.
    """
    df = shifted(with_signal(df, rules), "signal", rules.lag, "position")
    total = df.agg((F.max("row_id") + 1).alias("total"))
    df = df.crossJoin(F.broadcast(total))  # exactly one row
    capped = execution_costs(df, F.lit(0.0), F.col("total"), model).drop("requested", "filled", "spread_bps", "impact_bps", "total_bps", "bar_type", "penalty")
    df = carried_fills(capped, model).withColumnRenamed("position", "wanted").withColumnRenamed("filled", "position").drop("max_pov")
    df = shifted(df, "position", 1, "previous")
    asked = F.abs(F.col("wanted") - F.col("previous"))
    df = execution_costs(df, model.notional * asked, F.col("total"), model).drop("total", "filled")
    raw = F.when((F.col("close") > 0) & finite(F.col("close")) & finite(F.col("next_close")), (F.col("next_close") - F.col("close")) / F.when(F.col("close") > 0, F.col("close"))).otherwise(0.0)
    df = df.withColumns({"turnover": F.abs(F.col("position") - F.col("previous")), "gross": F.col("position") * raw})
    half = F.col("total_bps") / 2e4 * F.col("turnover")
    return df.withColumns({"rejected": ((asked > 0) & (F.col("turnover") <= 1e-12)).cast("int"), "cost": half, "slippage": half, "net": F.col("gross") - 2 * half})


def cost_report(rows: DataFrame, periods: int = PERIODS) -> DataFrame:
    """summary() of executed_with_costs() with n, the rejected moves and the mean modelled cost of the asked ones, in bps."""
    asked = F.abs(F.col("wanted") - F.col("previous")) > 0
    mean = F.coalesce(F.avg(F.when(asked, F.col("total_bps"))), F.lit(0.0))
    return summary(rows, periods, F.count(F.lit(1)).alias("n"), F.sum("rejected").alias("rejected"), mean.alias("mean_cost_bps"))


def audited(report: DataFrame, n: int | Column) -> DataFrame:
    """report with ok: bar counts add up to the rows, no more trades than rows, all figures finite."""
    doubles = [f.name for f in report.schema if f.dataType.simpleString() == "double"]
    counts = (F.col("long_bars") + F.col("short_bars") + F.col("flat_bars") == F.lit(n)) & (F.col("trades") <= F.lit(n))
    return report.withColumn("ok", reduce(lambda a, b: a & b, [finite(F.col(c)) for c in doubles], counts))


def partial_fills(df: DataFrame, by: list[str], cap: float = 0.03, notional: float = 0.02, reject: bool = False) -> DataFrame:
    """filled: the position after partial fills under one cap, each group of `by` being an instrument in row order."""
    return carried_fills(df.withColumn("max_pov", F.lit(cap)), Execution(notional=notional, reject=reject), by).drop("max_pov")
