"""Sinks: feature and dataset stores, ticker lists and one-row reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from barloom.operators import splits


def write_store(df: DataFrame, path: str, by_day: bool = True) -> None:
    """A Parquet store, partitioned by the day of ts: later reads prune by date. Rows of a day go to few files."""
    if by_day:
        df.withColumn("day", F.to_date("ts")).repartition("day").sortWithinPartitions("ticker", "ts").write.mode("overwrite").partitionBy("day").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """A labelled dataset, partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_assembled(df: DataFrame, path: str, features: Sequence[str], target: str = "label") -> dict:
    """Assemble a dataset of split rows, write it by split under path/rows and its info row as JSON under path/info.

    Counts and times are observed while the rows are written, so the source is read once; tickers, timestamps and their
    overlap between splits are counted on two columns of what was written. The info has a part for each split (n,
    tickers, stamps, first_ts, last_ts), the features, the target, rows that were left out, and the overlap.
    """
    seen, kept = Observation(), Observation()
    of = lambda s: F.when(F.col("split") == s, F.col("ts"))
    counts = [m for s in splits.ORDER for m in (F.count(of(s)).alias(f"n_{s}"), F.min(of(s)).cast("string").alias(f"first_{s}"), F.max(of(s)).cast("string").alias(f"last_{s}"))]
    rows = splits.assembled(df.observe(seen, F.count(F.lit(1)).alias("rows")), list(features), target).observe(kept, *counts)
    write_dataset(rows, f"{path}/rows")
    told = kept.get
    written = df.sparkSession.read.parquet(f"{path}/rows").select("split", "ticker", "ts")
    distinct = {r["split"]: r for r in written.groupBy("split").agg(F.count_distinct("ticker").alias("tickers"), F.count_distinct("ts").alias("stamps")).collect()}  # three rows
    overlap = splits.split_overlap(written).first().asDict()
    parts = {
        s: {"n": told[f"n_{s}"], "tickers": distinct[s]["tickers"] if s in distinct else 0, "stamps": distinct[s]["stamps"] if s in distinct else 0, "first_ts": told[f"first_{s}"], "last_ts": told[f"last_{s}"]}
        for s in splits.ORDER
    }
    info = {"splits": parts, "features": list(features), "target": target, "left_out": seen.get["rows"] - sum(p["n"] for p in parts.values()), "overlap": overlap}
    write_report(df.sparkSession.createDataFrame([(json.dumps(info),)], "info string"), f"{path}/info")
    return info


def write_tickers(df: DataFrame, path: str) -> None:
    df.select("ticker").distinct().coalesce(1).sortWithinPartitions("ticker").write.mode("overwrite").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)
