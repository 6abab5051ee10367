"""All event columns of a panel in one table on (ticker, ts), zero where nothing happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.calendar import HORIZONS, ITEMS, bar_index, macro_flags, snap_events

#: Kinds and items that count as earnings: fixed values.
EARNINGS_KINDS = ("earnings", "results", "earnings_release")
EARNINGS_ITEMS = ("2.02", "202")


def _of_ticker(events: DataFrame) -> DataFrame:
    events = events.withColumn("ticker", F.upper(F.trim("ticker")))
    return events.where(F.col("ticker") != "")


def bars_since(grid: DataFrame, snapped: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """grid with since_<kind>, the bars since the ticker's latest event of each kind, null before the first.

    All kinds in one pass: a ticker's events of a bar become one row of its line, before the bar itself.
    """
    index = bar_index(grid)
    acts = snapped.join(index.withColumnRenamed("ts", "bar_ts"), "bar_ts")
    acts = acts.groupBy("ticker", F.col("bar_ts").alias("ts"), "bar").agg(*[F.max(F.when(c, F.col("bar"))).alias(f"at_{n}") for n, c in kinds.items()])
    line = grid.join(index, "ts").withColumn("kind", F.lit(1)).unionByName(acts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("bar", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumns({f"since_{n}": F.col("bar") - F.last(f"at_{n}", ignorenulls=True).over(w) for n in kinds})
    return line.where("kind = 1").drop("kind", "bar", *[f"at_{n}" for n in kinds])


def density(grid: DataFrame, earnings: DataFrame) -> DataFrame:
    """Earnings of the day per ticker of the timestamp, in the market and in the sector; unknown tickers have sector 0."""
    sectors = grid.groupBy("ticker").agg(F.max("sector").alias("sector"))
    acts = earnings.select("ticker", F.to_date("bar_ts").alias("day")).join(sectors, "ticker", "left").fillna(0.0, ["sector"])
    per_sector = acts.groupBy("day", "sector").agg(F.count(F.lit(1)).alias("n_sector"))
    per_day = per_sector.groupBy("day").agg(F.sum("n_sector").alias("n_market"))
    df = grid.withColumn("day", F.to_date("ts")).join(per_day, "day", "left").join(per_sector, ["day", "sector"], "left")
    n = F.count(F.lit(1))
    return df.withColumns(
        {
            "earnings_density_same_day_market": F.coalesce(F.col("n_market") / n.over(Window.partitionBy("ts")), F.lit(0.0)),
            "earnings_density_same_day_sector": F.coalesce(F.col("n_sector") / n.over(Window.partitionBy("ts", "sector")), F.lit(0.0)),
        }
    ).drop("day", "n_market", "n_sector")


def event_grid(bars: DataFrame, macro: DataFrame, filings: DataFrame, scheduled: DataFrame | None = None, sector: str | None = None) -> DataFrame:
    """One row per (ticker, ts) of the bars with every event column.

    `macro` has (event_ts, event_type), `filings` (ticker, event_ts, item, event_type) and `scheduled`, the earnings known
    beforehand, (ticker, event_ts); pre_earnings_1d is there only with it. Tickers are compared in upper case, repeated
    bars are one row, filings without a ticker and events after the last bar count for nothing, an empty table gives zeros.
    """
    of = F.coalesce(F.col(sector).cast("double"), F.lit(0.0)) if sector else F.lit(0.0)
    grid = bars.groupBy(F.upper("ticker").alias("ticker"), "ts").agg(F.max(of).alias("sector"))
    snapped = snap_events(_of_ticker(filings), grid).withColumn("item", F.trim("item"))
    is_earnings = F.coalesce(F.col("item").isin(*EARNINGS_ITEMS), F.lit(False)) | F.coalesce(F.col("event_type").isin(*EARNINGS_KINDS), F.lit(False))
    kinds = {"earnings": is_earnings} | {name: F.col("item").isin(item, item.replace(".", "")) for item, name in ITEMS.items()}
    df = bars_since(macro_flags(grid, macro), snapped, kinds)
    since = F.col("since_earnings")
    flags = {"earnings_event_bar": F.coalesce((since == 0).cast("double"), F.lit(0.0))}
    flags |= {f"post_earnings_{n}bars": F.coalesce((since <= n).cast("double"), F.lit(0.0)) for n in HORIZONS}
    flags |= {f"sec_8k_{n}_recent": F.when(F.col(f"since_{n}") <= 78, F.exp(-F.col(f"since_{n}") / 12.0)).otherwise(0.0) for n in ITEMS.values()}
    df = density(df.withColumns(flags).drop(*[f"since_{n}" for n in kinds]), snapped.where(is_earnings))
    if scheduled is not None:
        days = snap_events(_of_ticker(scheduled), grid).select("ticker", F.date_sub(F.to_date("bar_ts"), 1).alias("day")).distinct().withColumn("hit", F.lit(1.0))
        df = df.withColumn("day", F.to_date("ts")).join(days, ["ticker", "day"], "left").withColumn("pre_earnings_1d", F.coalesce("hit", F.lit(0.0))).drop("hit", "day")
    return df.drop("sector")


def with_events(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """bars with the grid's columns, zero where the grid has no row."""
    keyed = bars.withColumn("upper_ticker", F.upper("ticker"))
    names = [c for c in grid.columns if c not in ("ticker", "ts")]
    return keyed.join(grid.withColumnRenamed("ticker", "upper_ticker"), ["upper_ticker", "ts"], "left").drop("upper_ticker").fillna(0.0, names)
