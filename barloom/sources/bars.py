"""Bars: resampling of event and trade tables, and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import quality

PRICES = ("open", "high", "low", "close")
#: The header of a ticker's file: fixed names.
CSV_SCHEMA = "`<DATE>` string, `<TIME>` string, `<OPEN>` double, `<HIGH>` double, `<LOW>` double, `<CLOSE>` double, `<VOL>` double"


def resample(rows: DataFrame, ticker: Column, ts: str, price: Column, volume: Column, order: list[str], interval: str) -> DataFrame:
    """OHLCV bars: open and close by the total order of `order`; one partial aggregate before the only shuffle."""
    key = F.struct(*order)
    rows = rows.select(ticker.alias("ticker"), F.window(ts, interval)["start"].alias("bar"), price.alias("p"), volume.alias("v"), key.alias("k"))
    return rows.groupBy("ticker", F.col("bar").alias("ts")).agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.sum("v").cast("double").alias("volume"),
    )


def event_bars(events: DataFrame, interval: str = "1 hour", ticker: str = "event_type") -> DataFrame:
    """Bars of the events table: price is the value, volume the count."""
    return resample(events, F.col(ticker).cast("string"), "ts", F.col("value"), F.lit(1), ["ts", "event_id"], interval)


def region_bars(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, interval: str = "1 day") -> DataFrame:
    """Daily bars by region: price per unit, volume in units. The dimension sides are joined by key; Spark picks how."""
    rows = lineitem.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return resample(
        rows, F.col("n_regionkey").cast("string"), "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), order, interval
    )


def parsed_time(date: Column, time: Column) -> Column:
    """yyyyMMdd and a time of up to six digits, zero-filled on the left; longer times give null."""
    time = F.trim(time)
    text = F.concat(F.trim(date), F.lpad(time, 6, "0"))
    return F.when(F.length(time) <= 6, F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def group_of(path: Column) -> Column:
    """The deepest folder that names an asset type, else the last folder, else unknown."""
    folders = F.slice(F.reverse(F.split(path, "/")), 2, F.size(F.split(path, "/")))
    hits = F.filter(folders, lambda x: F.lower(x).rlike("[_ ](stocks|etfs)"))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.try_element_at(F.filter(folders, lambda x: x != ""), F.lit(1)), F.lit("unknown"))


def discover(spark: SparkSession, root: str, exchange: str | None = None, asset_type: str | None = None) -> DataFrame:
    """(ticker, path, exchange_group, exchange, asset_type) of the files under a root, by path; dot-files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(F.upper(F.split(name, r"\.")[0]).alias("ticker"), "path", group_of(F.col("path")).alias("exchange_group"))
    parts = F.filter(F.split(F.lower("exchange_group"), r"[_\s-]+"), lambda x: x != "")
    typed = (F.size(parts) >= 2) & F.try_element_at(parts, F.lit(-1)).isin("stocks", "etfs")
    files = files.where("ticker <> ''").withColumns(
        {
            "exchange": F.when(typed, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")).otherwise(F.array_join(parts, "_")),
            "asset_type": F.when(typed, F.try_element_at(parts, F.lit(-1))).otherwise(F.lit("unknown")),
        }
    )
    if exchange:
        files = files.where(F.col("exchange") == exchange.lower())
    if asset_type:
        files = files.where(F.col("asset_type") == asset_type.lower())
    return files


def read_csv_bars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bars of ticker files: the ticker is the file's name up to the first dot."""
    raw = spark.read.schema(CSV_SCHEMA).option("header", "true").option("recursiveFileLookup", "true").option("mode", "FAILFAST").csv(paths)
    ticker = F.upper(F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.")[0])
    return raw.select(
        ticker.alias("ticker"),
        parsed_time(F.col("`<DATE>`"), F.col("`<TIME>`")).alias("ts"),
        *[F.col(f"`<{n.upper()}>`").alias(n) for n in PRICES],
        F.col("`<VOL>`").alias("volume"),
    )


def benchmark_path(spark: SparkSession, root: str, ticker: str) -> str | None:
    """The path of a benchmark's file under a root: the file's name is the ticker up to its first dot, in any case.

    Of several the least path is taken, so that the choice doesn't hang on the listing's order; None without any.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(F.split(name, r"\.")[0]) == ticker.strip().lower()).agg(F.min("path")).first()[0]


def benchmark_bars(spark: SparkSession, root: str, ticker: str, source_zone: str = "UTC", market_zone: str = "America/New_York") -> DataFrame:
    """Clean bars of one benchmark in market time, within sessions: only its own file is read. Without a file: no rows.

    Rows with a fault go.
    """
    path = benchmark_path(spark, root, ticker)
    if path is None:
        return spark.createDataFrame([], "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    clean = quality.valid_bars(read_csv_bars(spark, path))
    return quality.to_market_time(clean, source_zone, market_zone).where(quality.in_session())
