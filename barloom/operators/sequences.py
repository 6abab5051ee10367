"""Contiguous sequences (gaps and islands), breaks, warm-up and corporate-action adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import sequence_window, upto


def _breaks(step: str, break_on_day: bool) -> Column:
    w = Window.partitionBy("ticker").orderBy("ts")
    follows = F.lag("ts").over(w) == F.col("ts") - F.expr(f"INTERVAL {step}")
    if break_on_day:
        follows &= F.to_date(F.lag("ts").over(w)) == F.to_date("ts")
    return F.when(follows, 0).otherwise(1)


def with_sequences(bars: DataFrame, step: str = "'5' MINUTE", break_on_day: bool = True, least: int = 1) -> DataFrame:
    """Adds seq_id (from 1 per ticker) and idx (from 0 per sequence); sequences shorter than `least` go."""
    w = Window.partitionBy("ticker").orderBy("ts")
    df = bars.withColumn("brk", _breaks(step, break_on_day))
    df = df.withColumn("seq_id", F.sum("brk").over(upto(w)).cast("long")).drop("brk")
    df = df.withColumn("idx", (F.row_number().over(sequence_window()) - 1).cast("long"))
    if least > 1:
        whole = Window.partitionBy("ticker", "seq_id")
        df = df.withColumn("n", F.count(F.lit(1)).over(whole)).where(F.col("n") >= least).drop("n")
    return df


def sequence_breaks(bars: DataFrame, step_seconds: int = 300) -> DataFrame:
    """(ticker, prev_ts, ts, reason, missing_candles) where a bar doesn't follow the one before."""
    w = Window.partitionBy("ticker").orderBy("ts")
    gap = F.timestampdiff("SECOND", "prev_ts", "ts") if hasattr(F, "timestampdiff") else F.expr("timestampdiff(SECOND, prev_ts, ts)")
    df = bars.select("ticker", "ts", F.lag("ts").over(w).alias("prev_ts")).where("prev_ts is not null")
    df = df.withColumn("gap", gap).withColumn("new_day", F.to_date("prev_ts") != F.to_date("ts"))
    df = df.where((F.col("gap") != step_seconds) | F.col("new_day"))
    return df.select(
        "ticker",
        "prev_ts",
        "ts",
        F.when(F.col("new_day"), "new_trading_day").otherwise("gap").alias("reason"),
        F.when(F.col("new_day"), F.lit(0)).otherwise(F.greatest(F.floor(F.col("gap") / step_seconds) - 1, F.lit(0))).cast("long").alias("missing_candles"),
    )


def is_sorted(bars: DataFrame, order: str, strict: bool = False) -> DataFrame:
    """Per ticker: whether timestamps rise (strictly) in the given order."""
    w = Window.partitionBy("ticker").orderBy(order)
    back = F.lag("ts").over(w) >= F.col("ts") if strict else F.lag("ts").over(w) > F.col("ts")
    return bars.withColumn("bad", back).groupBy("ticker").agg((F.count_if("bad") == 0).alias("ordered"))


def warm_rows(df: DataFrame, warmup: int = 19) -> DataFrame:
    """Rows whose longest feature window is full."""
    return df.where(F.col("idx") >= warmup)


def first_tickers(files: DataFrame, most: int) -> DataFrame:
    """The first tickers by path."""
    return files.orderBy("path").limit(most)


def split_adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices divided, and volume multiplied, by the product of the split factors after each bar.

    Actions enter the ticker's time line as rows: the factor of a bar is the running product from the end of the line,
    an action at the bar's own time not included. One shuffle by ticker, no range join.
    """
    none = F.lit(None)
    line = bars.select("ticker", "ts", "open", "high", "low", "close", "volume", F.lit(0.0).alias("log_factor"), F.lit(1).alias("kind"))
    acts = actions.groupBy("ticker", F.col("event_ts").alias("ts")).agg(F.sum(F.log("factor")).alias("log_factor"))
    acts = acts.select("ticker", "ts", *[none.cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")], "log_factor", F.lit(0).alias("kind"))
    w = Window.partitionBy("ticker").orderBy(F.col("ts").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = line.unionByName(acts).withColumn("factor", F.exp(F.sum("log_factor").over(w))).where("kind = 1")
    return both.select("ticker", "ts", *[(F.col(c) / F.col("factor")).alias(c) for c in ("open", "high", "low", "close")], (F.col("volume") * F.col("factor")).alias("volume"))


def ticker_subset(df: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """The rows of `most` tickers (all, if there are no more or most is 0 or less), picked by a seeded hash of the ticker.

    The same tickers whatever the order of rows. Each task keeps its `most` smallest hashes; no more leave it.
    """
    if most <= 0:
        return df
    names = df.select("ticker").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "ticker")), "ticker").limit(most)
    return df.join(names, "ticker", "left_semi")
