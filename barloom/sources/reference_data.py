"""Corporate actions, universe membership, sectors and calendar events, with tolerant column names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd")
EVENT_TIMES = ("timestamp", "datetime", "release_time", "accepted_at", "acceptance_time", "filing_time", "date")
EVENT_KINDS = ("event_type", "type", "event", "macro_event", "form")


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """CSV, Parquet, JSON or JSON lines, by the path's ending; all CSV and JSON columns as they are inferred."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return spark.read.option("header", "true").csv(path)
    if fmt in ("json", "jsonl", "ndjson"):
        return spark.read.option("multiLine", str(fmt == "json").lower()).json(path)
    raise ValueError(f"no reader for {path}")


def first_of(df: DataFrame, names: tuple[str, ...], each=lambda c: c) -> Column:
    """The first non-null of the named columns that the table has, each through a function."""
    there = [each(F.col(f"`{c}`").cast("string")) for n in names for c in df.columns if c.lower() == n]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def parsed(text: Column) -> Column:
    """A market-local time in any of the known formats, or ISO; a zone suffix is dropped."""
    bare = F.regexp_replace(F.trim(text), r"(Z|[+-]\d\d:?\d\d)$", "")
    bare = F.when(F.trim(text).rlike(r"\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)$"), bare).otherwise(F.trim(text))
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in TIME_FORMATS]
    return F.coalesce(*tries, F.try_to_timestamp(bare)).cast("timestamp_ntz")


def event_time(df: DataFrame, names: tuple[str, ...] = EVENT_TIMES) -> Column:
    """The first of the named columns that gives a time: times as they are, dates at 09:30, numbers as epoch seconds, text parsed."""
    tries = []
    for f in (f for n in names for f in df.schema.fields if f.name.lower() == n):
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind == "date":
            tries.append(c.cast("timestamp_ntz") + F.expr("INTERVAL '09:30' HOUR TO MINUTE"))
        elif kind in ("timestamp", "timestamp_ntz"):
            tries.append(c.cast("timestamp_ntz"))
        elif kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
            tries.append(F.timestamp_seconds(c).cast("timestamp_ntz"))
        else:
            tries.append(parsed(F.nullif(F.trim(c.cast("string")), F.lit(""))))
    return F.coalesce(*tries) if tries else F.lit(None).cast("timestamp_ntz")


def corporate_actions(raw: DataFrame) -> DataFrame:
    """(ticker, event_ts, factor): splits with a positive factor other than 1."""
    time = first_of(raw, ("timestamp", "effective_date", "date"))
    factor = first_of(raw, ("split_factor", "split", "ratio")).try_cast("double")
    rows = raw.select(F.upper(F.trim(first_of(raw, ("ticker", "symbol")))).alias("ticker"), parsed(time).alias("event_ts"), factor.alias("factor"))
    return rows.where("ticker is not null and event_ts is not null and factor > 0 and abs(factor - 1) > 1e-12")


def membership(raw: DataFrame) -> DataFrame:
    """(ticker) of the active members."""
    active = F.lower(F.trim(first_of(raw, ("active",))))
    rows = raw.select(F.upper(F.trim(first_of(raw, ("ticker", "symbol")))).alias("ticker"), active.alias("active"))
    return rows.where("ticker <> '' and coalesce(active, '1') not in ('0', 'false', 'no')").select("ticker").distinct()


def row_place(raw: DataFrame) -> Column:
    """A row's place in the order of its files: path, where its split of the file begins, and its place in the split.

    Splits of a file may be read in any order and packed with those of other files, so their numbers say nothing. A
    table that isn't read from files has the order of its partitions.
    """
    within = F.monotonically_increasing_id()
    try:
        raw.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return F.struct(within)
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), within)


def sector_map(raw: DataFrame) -> DataFrame:
    """(ticker, sector); of several rows for a ticker the one later in the file wins, of several files the later by path."""
    rows = raw.select(
        F.upper(F.trim(first_of(raw, ("ticker", "symbol")))).alias("ticker"),
        F.trim(first_of(raw, ("sector", "gics_sector"))).alias("sector"),
        row_place(raw).alias("at"),
    )
    return rows.where("ticker <> '' and sector <> ''").groupBy("ticker").agg(F.max_by("sector", "at").alias("sector"))


def calendar_events(raw: DataFrame) -> DataFrame:
    """(ticker, event_ts, event_type, item) of macro calendars, filings and earnings."""
    kind = F.replace(F.lower(F.trim(first_of(raw, EVENT_KINDS, lambda c: F.nullif(F.trim(c), F.lit(""))))), F.lit(" "), F.lit("_"))
    return raw.select(
        F.upper(F.trim(first_of(raw, ("ticker", "symbol")))).alias("ticker"),
        event_time(raw).alias("event_ts"),
        kind.alias("event_type"),
        F.trim(first_of(raw, ("item", "item_code", "sec_item"))).alias("item"),
    ).where("event_ts is not null")
