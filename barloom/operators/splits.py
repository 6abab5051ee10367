"""Time splits, leakage checks, train-only normalisation, window and panel tensors, walk-forward folds."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from barloom.functions.columns import sequence_window, truncated

ORDER = ("train", "val", "test")


def _split(place, n, train: float, val: float):
    return F.when(place < truncated(n * train), "train").when(place < truncated(n * (train + val)), "val").otherwise("test")


def split_global_time(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Split by the place of a row's timestamp among all distinct timestamps (one narrow row each)."""
    if train <= 0 or val < 0 or train + val >= 1 + 1e-8:
        raise ValueError("the ratios don't leave a test split")
    stamps = df.select("ts").distinct()
    stamps = stamps.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return df.join(stamps.select("ts", _split(F.col("i"), F.col("n"), train, val).alias("split")), "ts")


def split_per_ticker(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Whole sequences, by the ticker's rows before them."""
    seq = df.groupBy("ticker", "seq_id").agg(F.count(F.lit(1)).alias("k"), F.min("ts").alias("first"))
    w = Window.partitionBy("ticker").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("k").over(Window.partitionBy("ticker"))
    seq = seq.select("ticker", "seq_id", _split(F.coalesce(F.sum("k").over(w), F.lit(0)), n, train, val).alias("split"))
    return df.join(seq, ["ticker", "seq_id"])


def split_overlap(df: DataFrame) -> DataFrame:
    """One row: timestamps that two splits share, and whether the splits follow each other in time."""
    by_ts = df.groupBy("ts").agg(F.collect_set("split").alias("s"))
    both = lambda a, b: F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}")
    overlap = by_ts.agg(both("train", "val"), both("train", "test"), both("val", "test"))
    at = lambda f, s: f(F.when(F.col("split") == s, F.col("ts")))
    ordered = df.agg(((at(F.max, "train") < at(F.min, "val")) & (at(F.max, "val") < at(F.min, "test"))).alias("ordered"))
    return overlap.crossJoin(ordered)  # one row each


def contamination(df: DataFrame) -> DataFrame:
    """Per split: n, and shared, its rows at timestamps that another split has too; risky where there are any.

    Cross-sectional features of such a timestamp are taken over rows of several splits.
    """
    stamps = df.groupBy("ts").agg((F.count_distinct("split") > 1).alias("mixed"))
    rows = df.join(stamps, "ts").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("mixed").alias("shared"))
    return rows.withColumn("risky", F.col("shared") > 0)


def feature_columns(df: DataFrame, reserved: tuple[str, ...] = ("ticker", "ts", "close", "next_close", "label", "split")) -> list[str]:
    """The numeric columns in order of their names, without the reserved ones: what datasets take where none are named."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in reserved)


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the train split's mean and population std (at least 1e-8); statistics are one broadcast row."""
    train = df.where(F.col("split") == "train")
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(1e-8)).alias(f"s_{c}") for c in columns])
    df = df.crossJoin(F.broadcast(stats))  # exactly one row
    return df.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in columns}).drop(*stats.columns)


def window_tensors(df: DataFrame, columns: list[str], size: int = 8, stride: int = 1) -> DataFrame:
    """x: the last `size` rows' features, for every `stride`-th full window of a sequence within its split."""
    w = sequence_window("split") if "split" in df.columns else sequence_window()
    df = df.withColumn("at", F.row_number().over(w) - 1)
    row = F.array(*[F.col(c).cast("float") for c in columns])
    df = df.withColumn("x", F.collect_list(row).over(w.rowsBetween(-(size - 1), Window.currentRow)))
    return df.where((F.col("at") >= size - 1) & ((F.col("at") - (size - 1)) % stride == 0)).drop("at")


def panel_tensors(df: DataFrame, columns: list[str], context: int = 8) -> DataFrame:
    """x: the features of the row's neighbours by ticker at the timestamp, zero-padded to `context` rows."""
    left = context // 2
    right = context - left - 1
    x = Window.partitionBy("ts").orderBy("ticker")
    n = F.count(F.lit(1)).over(Window.partitionBy("ts"))
    row = F.array(*[F.col(c).cast("float") for c in columns])
    df = df.withColumns({"near": F.collect_list(row).over(x.rowsBetween(-left, right)), "place": F.row_number().over(x), "n": n})
    zero = F.array(*[F.lit(0.0).cast("float")] * len(columns))
    before = F.array_repeat(zero, F.greatest(F.lit(0), left - (F.col("place") - 1)))
    after = F.array_repeat(zero, F.greatest(F.lit(0), right - (F.col("n") - F.col("place"))).cast("int"))
    return df.withColumn("x", F.concat(before, "near", after)).drop("near", "place", "n")


def walk_forward_folds(df: DataFrame, train: int, val: int, test: int, step: int, most: int = 0) -> DataFrame:
    """(fold, split, first_day, last_day) over the distinct days."""
    days = df.select(F.to_date("ts").alias("day")).distinct()
    days = days.select("day", (F.row_number().over(Window.orderBy("day")) - 1).alias("i"))
    need = train + val + test
    starts = days.agg(F.max("i").alias("top")).where(F.col("top") + 1 >= need)
    starts = starts.select(F.posexplode(F.sequence(F.lit(0), F.col("top") + 1 - need, F.lit(step))).alias("fold", "s"))
    if most:
        starts = starts.where(F.col("fold") < most)
    parts = F.array(
        F.struct(F.lit("train").alias("split"), F.col("s").alias("a"), (F.col("s") + train - 1).alias("b")),
        F.struct(F.lit("val").alias("split"), (F.col("s") + train).alias("a"), (F.col("s") + train + val - 1).alias("b")),
        F.struct(F.lit("test").alias("split"), (F.col("s") + train + val).alias("a"), (F.col("s") + need - 1).alias("b")),
    )
    folds = starts.select("fold", F.inline(parts))
    first, last = days.select(F.col("day").alias("first_day"), F.col("i").alias("a")), days.select(F.col("day").alias("last_day"), F.col("i").alias("b"))
    return folds.join(first, "a").join(last, "b").select("fold", "split", "first_day", "last_day")


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold and split. Folds become (fold, split, day) rows first: an equi-join on the day, no range join."""
    days = folds.select("fold", "split", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return df.withColumn("day", F.to_date("ts")).join(days, "day").drop("day")


def embargo_last(rows: DataFrame, bars: int) -> DataFrame:
    """Drops the last `bars` rows of each ticker in the train and val splits of a fold."""
    w = Window.partitionBy("fold", "split", "ticker").orderBy(F.col("ts").desc())
    return rows.withColumn("rn", F.row_number().over(w)).where((F.col("split") == "test") | (F.col("rn") > bars)).drop("rn")


def embargo_first(rows: DataFrame, bars: int) -> DataFrame:
    """Drops the first `bars` rows of each fold's test slice, all tickers pooled, by (ts, ticker).

    A row's place is the number of rows at earlier timestamps (one narrow row each) and its place within its own.
    """
    rows = rows.where(F.col("split") == "test")
    stamps = rows.groupBy("fold", "ts").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("fold").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    stamps = stamps.select("fold", "ts", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("fold", "ts").orderBy("ticker"))
    return rows.withColumn("place", place).join(stamps, ["fold", "ts"]).where(F.col("ahead") + F.col("place") > bars).drop("ahead", "place")


def assembled(df: DataFrame, features: list[str], target: str = "label") -> DataFrame:
    """Rows with all features, the target, both closes and a timestamp: what datasets are made of."""
    wanted = [*features, target, "close", "next_close", "ts"]
    return df.dropna(subset=wanted).where(~reduce(or_, [F.isnan(c) for c in features]))


def dataset_info(rows: DataFrame) -> DataFrame:
    """Per split: rows, tickers, timestamps, first and last time."""
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("ts").alias("stamps"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
