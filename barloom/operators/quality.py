"""Data quality: row validity, summaries, sessions and time zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import finite

OPEN_SECOND, CLOSE_SECOND = 9 * 3600 + 1800, 16 * 3600
PRICES = ("open", "high", "low", "close")


def bar_fault() -> Column:
    """The first rule that a bar breaks, or null."""
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    rules = [(F.col("ts").isNull(), "missing_timestamp")]
    rules += [(missing(c), f"missing_{c}") for c in (*PRICES, "volume")]
    for c in PRICES:
        rules += [(~finite(F.col(c)), f"invalid_{c}"), (F.col(c) <= 0, f"non_positive_{c}")]
    rules += [(~finite(F.col("volume")), "invalid_volume"), (F.col("volume") < 0, "negative_volume"), (F.col("high") < F.col("low"), "high_below_low")]
    rules += [(F.col("high") < F.col(c), f"high_below_{c}") for c in ("open", "close")]
    rules += [(F.col("low") > F.col(c), f"low_above_{c}") for c in ("open", "close")]
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules])


def with_fault(bars: DataFrame) -> DataFrame:
    return bars.withColumn("reason", bar_fault())


def valid_bars(bars: DataFrame) -> DataFrame:
    return with_fault(bars).where("reason is null").drop("reason")


def quarantine(bars: DataFrame) -> DataFrame:
    return with_fault(bars).where("reason is not null")


def bar_summary(bars: DataFrame, order: str = "row_no") -> DataFrame:
    """Per ticker: rows, faults, repeated timestamps, pairs out of the ingest order; valid if none."""
    w = Window.partitionBy("ticker").orderBy(order)
    rows = with_fault(bars).withColumn("back", F.lag("ts").over(w) > F.col("ts"))
    rows = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid_rows"),
        (F.count("ts") - F.count_distinct("ts")).alias("duplicate_timestamps"),
        F.count_if("back").alias("out_of_order_pairs"),
    )
    return rows.withColumn("valid", (F.col("invalid_rows") == 0) & (F.col("duplicate_timestamps") == 0) & (F.col("out_of_order_pairs") == 0))


def valid_tickers(bars: DataFrame, order: str = "row_no") -> DataFrame:
    """Bars of the tickers whose summary is valid: a bad row drops its whole ticker. Bars without a ticker go."""
    bad = bar_summary(bars, order).where("not valid").select("ticker")
    return bars.where("ticker is not null").join(bad, "ticker", "left_anti")


def feature_faults(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing, invalid): cells that are null, and cells that are no finite number."""
    cells = [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"i_{c}"))]
    row = df.agg(*cells)
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("missing"), F.col(f"i_{c}").alias("invalid")) for c in columns])))


def second_of_day(ts: str = "ts") -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def in_session(ts: str = "ts") -> Column:
    """09:30 up to 16:00, whatever the day."""
    return (second_of_day(ts) >= OPEN_SECOND) & (second_of_day(ts) < CLOSE_SECOND)


def to_market_time(df: DataFrame, source: str, market: str, ts: str = "ts") -> DataFrame:
    """Local times of one zone as local times of another; equal or blank zones change nothing."""
    if not source or not market or source == market:
        return df
    return df.withColumn(ts, F.convert_timezone(F.lit(source), F.lit(market), F.col(ts)))


def coverage(df: DataFrame) -> DataFrame:
    """One row: what the coverage gate looks at."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("split") == "train").alias("rows_train"),
        F.count_distinct("ticker").alias("tickers"),
        F.count_distinct(F.to_date("ts")).alias("days"),
        F.min("ts").cast("string").alias("first_ts"),
        F.max("ts").cast("string").alias("last_ts"),
    )


def require_coverage(df: DataFrame, rows: int = 0, train_rows: int = 0, tickers: int = 0, days: int = 0) -> dict:
    """The coverage row as a dict; raises where a minimum isn't met."""
    found = coverage(df).first().asDict()
    least = {"rows_total": rows, "rows_train": train_rows, "tickers": tickers, "days": days}
    short = {k: (found[k], n) for k, n in least.items() if found[k] < n}
    if short:
        raise ValueError(f"too little data: {short}")
    return found
