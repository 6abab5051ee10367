"""Per-sequence features. All share one window (ticker, seq_id by ts): one exchange and one sort for every family."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import EPS, clamp, last_rows, ln, ratio, sequence_window, upto

W = sequence_window
BASE = ("log_return", "candle_range", "candle_body", "upper_wick", "lower_wick", "short_term_momentum", "rolling_volatility", "relative_volume")
VOLUME = ("volume_change", "volume_zscore", "relative_volume_long")
MARKET = ("gap_return", "intrabar_return", "close_position", "range_expansion")
TIME = ("session_pos_sin", "session_pos_cos", "day_of_week_sin", "day_of_week_cos")
VOLATILITY = ("rv_close_to_close", "rv_parkinson", "rv_garman_klass")
GROUPS = {"base": BASE, "volume": VOLUME, "market": MARKET, "time": TIME, "volatility": VOLATILITY}


def with_log_return(df: DataFrame) -> DataFrame:
    return df.withColumn("log_return", F.coalesce(F.ln(F.col("close") / F.lag("close").over(W())), F.lit(0.0)))


def base_features(df: DataFrame, momentum: int = 3, volatility: int = 5, volume: int = 5) -> DataFrame:
    scale = F.when(F.col("open") > 0, F.col("open")).otherwise(1.0)
    df = with_log_return(df)
    return df.withColumns(
        {
            "candle_range": (F.col("high") - F.col("low")) / scale,
            "candle_body": (F.col("close") - F.col("open")) / scale,
            "upper_wick": (F.col("high") - F.greatest("open", "close")) / scale,
            "lower_wick": (F.least("open", "close") - F.col("low")) / scale,
            "short_term_momentum": F.col("close") / F.lag("close", momentum).over(W()) - 1,
            "rolling_volatility": F.stddev_pop("log_return").over(last_rows(W(), volatility)),
            "relative_volume": ratio("volume", F.avg("volume").over(last_rows(W(), volume))),
        }
    )


def volume_features(df: DataFrame, window: int = 10) -> DataFrame:
    frame = last_rows(W(), window)
    mean, std = F.avg("volume").over(frame), F.stddev_pop("volume").over(frame)
    same = F.min("volume").over(frame) == F.max("volume").over(frame)
    before = F.lag("volume").over(W())
    return df.withColumns(
        {
            "volume_change": F.when(before > 0, F.col("volume") / before - 1).otherwise(0.0),
            "volume_zscore": F.when(~same, (F.col("volume") - mean) / F.when(~same, std)).otherwise(0.0),
            "relative_volume_long": ratio("volume", F.avg("volume").over(last_rows(W(), 2 * window))),
        }
    )


def market_features(df: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    return df.withColumns(
        {
            "gap_return": F.col("open") / F.lag("close").over(W()) - 1,
            "intrabar_return": F.col("close") / F.col("open") - 1,
            "close_position": F.when(span > 0, (F.col("close") - F.col("low")) / F.when(span > 0, span)).otherwise(0.5),
            "range_expansion": span / F.greatest(F.lag(span).over(W()), F.lit(1e-12)) - 1,
        }
    )


def time_features(df: DataFrame) -> DataFrame:
    minute = (F.hour("ts") * 60 + F.minute("ts") - 570).cast("double")
    place = clamp(minute, 0.0, 390.0) / 390.0 * (2 * math.pi)
    day = F.weekday("ts") / 5.0 * (2 * math.pi)
    return df.withColumns({"session_pos_sin": F.sin(place), "session_pos_cos": F.cos(place), "day_of_week_sin": F.sin(day), "day_of_week_cos": F.cos(day)})


def volatility_features(df: DataFrame, window: int = 20, floor: float | None = EPS) -> DataFrame:
    """Close-to-close, Parkinson and Garman-Klass volatility; a sequence's first bar counts as 0.

    Prices are raised to `floor` before logarithms; without one, a price of 0 makes its windows infinite or NaN.
    """
    safe = lambda c: ln(c if floor is None else F.greatest(F.col(c), F.lit(floor)))
    first = F.col("idx") == 0
    hl, co = F.when(first, 0.0).otherwise(safe("high") - safe("low")), F.when(first, 0.0).otherwise(safe("close") - safe("open"))
    cc = F.when(first, 0.0).otherwise(safe("close") - F.lag(safe("close")).over(W()))
    df = df.withColumns({"hl2": hl * hl, "co2": co * co, "cc2": cc * cc})
    garman = F.greatest(F.lit(0.0), 0.5 * F.col("hl2") - (2 * math.log(2) - 1) * F.col("co2"))
    mean = lambda c: F.sqrt(F.avg(c).over(last_rows(W(), window)))
    df = df.withColumns({"rv_close_to_close": mean(F.col("cc2")), "rv_parkinson": mean(F.col("hl2") / (4 * math.log(2))), "rv_garman_klass": mean(garman)})
    return df.drop("hl2", "co2", "cc2")


def all_features(df: DataFrame, floor: float | None = EPS) -> DataFrame:
    return volatility_features(time_features(market_features(volume_features(base_features(df)))), floor=floor)


def benchmark_state(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 6), rv: int = 6, base: int = 12) -> DataFrame:
    """Per bar of benchmark tickers: returns over horizons, VWAP deviation, place in the running range, volatility ratio."""
    df = with_log_return(df)
    run = upto(W())
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    pv, v = F.sum(typical * F.col("volume")).over(run), F.sum("volume").over(run)
    low, high = F.min("low").over(run), F.max("high").over(run)
    scale = F.avg(F.abs("log_return")).over(last_rows(W(), base))
    columns: dict[str, Column] = {f"ret_{n}": F.when(F.col("idx") >= n, F.sum("log_return").over(last_rows(W(), n))).otherwise(0.0) for n in horizons}
    columns |= {
        "vwap_dev": F.when(v > 0, F.col("close") / (pv / F.when(v > 0, v)) - 1).otherwise(0.0),
        "intraday_range_pos": F.when(high - low > 1e-12, (F.col("close") - low) / F.when(high - low > 1e-12, high - low)).otherwise(0.5),
        "rv_ratio": F.when(scale > 1e-12, F.stddev_pop("log_return").over(last_rows(W(), rv)) / F.when(scale > 1e-12, scale)).otherwise(0.0),
    }
    return df.withColumns(columns)


def benchmark_columns(state: DataFrame, benchmarks: list[str], names: list[str]) -> DataFrame:
    """One row per ts with mctx_{benchmark}_{name}: a pivot over a fixed list of tickers."""
    wide = state.where(F.col("ticker").isin(benchmarks)).groupBy("ts")
    return wide.agg(*[F.max(F.when(F.col("ticker") == b, F.col(n))).alias(f"mctx_{b.lower()}_{n}") for b in benchmarks for n in names])
