"""Event calendars: snapping events to bars (forward as-of), flags, decays and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.quality import CLOSE_SECOND, OPEN_SECOND, second_of_day

HORIZONS = (1, 3, 6, 12, 78)
#: Filing items and their columns: fixed values.
ITEMS = {"2.02": "item202", "3.01": "item301", "4.02": "item402", "5.02": "item502", "8.01": "item801"}


def bar_index(bars: DataFrame) -> DataFrame:
    """(ts, bar): the place of each timestamp among all tickers' timestamps. One narrow row per timestamp."""
    return bars.select("ts").distinct().withColumn("bar", (F.row_number().over(Window.orderBy("ts")) - 1).cast("long"))


def snap_events(events: DataFrame, bars: DataFrame, session: bool = True) -> DataFrame:
    """Each event with bar_ts, the first bar at or after it; events after the last bar go.

    With sessions, an event before the open waits for 09:30 of its day or the next day that has bars, and one from the
    close on for the next such day. Events join their day's bar times by equality: no range join, and no event is sorted.
    """
    stamps = bars.select(F.col("ts").alias("bar_ts")).distinct()
    anchor = F.col("event_ts")
    if session:
        day = F.date_trunc("day", "event_ts").cast("timestamp_ntz")
        opening = F.expr(f"INTERVAL {OPEN_SECOND} SECOND")
        s = second_of_day("event_ts")
        anchor = F.when(s < OPEN_SECOND, day + opening).when(s >= CLOSE_SECOND, day + F.expr("INTERVAL 1 DAY") + opening).otherwise(F.col("event_ts"))
        stamps = stamps.where(second_of_day("bar_ts") >= OPEN_SECOND)
    # a day's bar times are an array (a few hundred at most), so that an event finds its own without being sorted
    days = stamps.groupBy(F.to_date("bar_ts").alias("day")).agg(F.sort_array(F.collect_list("bar_ts")).alias("times"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    later = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    first_time = F.element_at("times", 1)
    days = span.join(days, "day", "left").withColumn("next_open", F.first(first_time, ignorenulls=True).over(later))  # one row per day
    start = stamps.agg(F.min("bar_ts").alias("first_ts"))
    names = events.columns
    found = events.withColumn("at", anchor).withColumn("day", F.to_date("at")).join(days, "day", "left").crossJoin(F.broadcast(start))  # one row
    same_day = F.get(F.filter("times", lambda t: t >= F.col("at")), F.lit(0))
    before_all = F.when(F.col("at") < F.col("first_ts"), F.col("first_ts"))
    found = found.withColumn("bar_ts", F.coalesce(same_day, "next_open", before_all))
    return found.where("bar_ts is not null").select(*names, "bar_ts")


def macro_flags(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars with day flags of macro events and bar flags of central-bank statements and press conferences."""
    snapped = snap_events(events, bars)
    by_day = snapped.groupBy(F.to_date("bar_ts").alias("day")).agg(F.collect_set("event_type").alias("day_types"))
    by_bar = snapped.groupBy(F.col("bar_ts").alias("ts")).agg(F.collect_set("event_type").alias("bar_types"))
    df = bars.withColumn("day", F.to_date("ts")).join(by_day, "day", "left").join(by_bar, "ts", "left")
    has = lambda c, *kinds: F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, kinds))), F.lit(False)).cast("double")
    return df.withColumns(
        {
            "macro_event_today": F.col("day_types").isNotNull().cast("double"),
            "cpi_day": has("day_types", "cpi"),
            "nfp_day": has("day_types", "nfp", "employment_situation"),
            "gdp_day": has("day_types", "gdp"),
            "fomc_statement_bar": has("bar_types", "fomc", "fomc_statement"),
            "fomc_press_bar": has("bar_types", "fomc_press", "fomc_press_conference"),
        }
    ).drop("day", "day_types", "bar_types")


def since_event(bars: DataFrame, snapped: DataFrame, by: list[str] = ["ticker"]) -> DataFrame:
    """Bars with `since`: bars of the global index since the ticker's latest snapped event, null before the first.

    Events join the ticker's line as rows, before the bar of the same time; the latest one is read off the line.
    """
    index = bar_index(bars)
    line = bars.join(index, "ts").withColumn("kind", F.lit(1)).withColumn("event_bar", F.lit(None).cast("long"))
    acts = snapped.join(index, snapped["bar_ts"] == index["ts"]).select(*by, "ts", "bar", F.lit(0).alias("kind"), F.col("bar").alias("event_bar")).distinct()
    line = line.unionByName(acts, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("bar", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("since", F.col("bar") - F.last("event_bar", ignorenulls=True).over(w))
    return line.where("kind = 1").drop("kind", "event_bar", "bar")


def post_event_flags(bars: DataFrame, snapped: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """earnings_event_bar, and post_earnings_{n}bars: an event at most n bars ago."""
    df = since_event(bars, snapped)
    flags: dict[str, Column] = {"earnings_event_bar": F.coalesce((F.col("since") == 0).cast("double"), F.lit(0.0))}
    flags |= {f"post_earnings_{n}bars": F.coalesce((F.col("since") <= n).cast("double"), F.lit(0.0)) for n in horizons}
    return df.withColumns(flags).drop("since")


def all_item_decays(bars: DataFrame, snapped: DataFrame, reach: int = 78, scale: float = 12.0) -> DataFrame:
    """sec_8k_{name}_recent for each item: exp(-bars since / scale) up to `reach` bars after the ticker's latest filing of it.

    Filings of all items join the ticker's line as rows, before the bar of the same time: one pass for all of them.
    """
    index = bar_index(bars)
    line = bars.join(index, "ts").withColumn("kind", F.lit(1))
    acts = snapped.where(F.col("item").isin(*ITEMS)).join(index, snapped["bar_ts"] == index["ts"]).select("ticker", "ts", "bar", "item").distinct().withColumn("kind", F.lit(0))
    line = line.withColumn("item", F.lit(None).cast("string")).unionByName(acts, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("bar", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decays = {}
    for item, name in ITEMS.items():
        since = F.col("bar") - F.last(F.when(F.col("item") == item, F.col("bar")), ignorenulls=True).over(w)
        decays[f"sec_8k_{name}_recent"] = F.when(since <= reach, F.exp(-since / scale)).otherwise(0.0)
    return line.withColumns(decays).where("kind = 1").drop("kind", "item", "bar")


def pre_event_day(bars: DataFrame, snapped: DataFrame) -> DataFrame:
    """pre_earnings_1d: the ticker has an event on the next calendar day."""
    days = snapped.select("ticker", F.date_sub(F.to_date("bar_ts"), 1).alias("day")).distinct().withColumn("hit", F.lit(1.0))
    df = bars.withColumn("day", F.to_date("ts")).join(days, ["ticker", "day"], "left")
    return df.withColumn("pre_earnings_1d", F.coalesce("hit", F.lit(0.0))).drop("hit", "day")


def event_density(bars: DataFrame, snapped: DataFrame) -> DataFrame:
    """Events of the day per ticker of the timestamp, in the market and in the row's sector (a column of bars)."""
    sectors = bars.select("ticker", "sector").distinct()
    per_day = snapped.groupBy(F.to_date("bar_ts").alias("day")).agg(F.count(F.lit(1)).alias("n_market"))
    per_sector = snapped.select("ticker", "bar_ts").join(sectors, "ticker").groupBy(F.to_date("bar_ts").alias("day"), "sector").agg(F.count(F.lit(1)).alias("n_sector"))
    df = bars.withColumn("day", F.to_date("ts")).join(per_day, "day", "left").join(per_sector, ["day", "sector"], "left")
    at, in_sector = Window.partitionBy("ts"), Window.partitionBy("ts", "sector")
    return df.withColumns(
        {
            "earnings_density_same_day_market": F.coalesce(F.col("n_market") / F.count(F.lit(1)).over(at), F.lit(0.0)),
            "earnings_density_same_day_sector": F.coalesce(F.col("n_sector") / F.count(F.lit(1)).over(in_sector), F.lit(0.0)),
        }
    ).drop("day", "n_market", "n_sector")
