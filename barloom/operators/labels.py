"""Forward-looking labels per sequence, and the cross-sectional rank target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import EPS, clamp, last_rows, sequence_window

W = sequence_window


def three_way(r: Column, threshold: Column) -> Column:
    return F.when(r > threshold, 2).when(r < -threshold, 0).otherwise(1)


def labelled(
    df: DataFrame, horizon: int = 1, threshold: float = 0.0005, k: float = 0.5, window: int = 20, event_k: float = 1.0, event_window: int = 78
) -> DataFrame:
    """Adds next_close, next_log_return and all targets; rows without a bar `horizon` ahead in their sequence go."""
    frame = last_rows(W(), window)
    df = df.withColumns(
        {
            "next_close": F.lead("close", horizon).over(W()),
            "past_std": F.stddev_pop("log_return").over(frame),
            "past_mean": F.avg("log_return").over(frame),
            "event_std": F.stddev_pop("log_return").over(last_rows(W(), event_window)),
        }
    ).where("next_close is not null")
    r = F.col("next_log_return")
    df = df.withColumn("next_log_return", F.ln(F.col("next_close") / F.col("close")))
    std = F.greatest("past_std", F.lit(EPS))
    df = df.withColumns(
        {
            "vol_threshold": k * std,
            "event_threshold": event_k * F.greatest("event_std", F.lit(EPS)) * math.sqrt(horizon),
            "vol_target": r / std,
            "z_return": (r - F.col("past_mean")) / std,
        }
    )
    fixed, vol = three_way(r, F.lit(threshold)), three_way(r, F.col("vol_threshold"))
    event = F.abs(r) > F.col("event_threshold")
    return df.withColumns(
        {
            "vol_target_clipped": clamp("vol_target", -3.0, 3.0),
            "label": F.when(r > 0, 1).otherwise(0),
            "threshold_label": fixed,
            **{f"threshold_{n}": (fixed == v).cast("int") for n, v in (("down", 0), ("no_move", 1), ("up", 2))},
            "vol_direction_label": vol,
            **{f"vol_{n}": (vol == v).cast("int") for n, v in (("down", 0), ("no_move", 1), ("up", 2))},
            "event_label": event.cast("int"),
            "event_direction": F.when(r > 0, 1).otherwise(0),
            "event_signed": F.when(event & (r > 0), 2).when(event, 0).otherwise(1),
            "event_magnitude": F.when(F.col("event_threshold") > EPS, F.least(F.abs(r) / F.greatest("event_threshold", F.lit(EPS)), F.lit(5.0))).otherwise(0.0),
        }
    ).drop("past_std", "past_mean", "event_std")


def rank_target(df: DataFrame, by: list[str] = ["split", "ts"]) -> DataFrame:
    """cross_sectional_rank: ordinal rank of the next return among a split's tickers at a timestamp; alone 0.5."""
    x = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(x)
    rank = (F.row_number().over(x.orderBy("next_log_return", "ticker")) - 1) / F.when(n > 1, n - 1)
    return df.withColumn("cross_sectional_rank", F.when(n == 1, 0.5).otherwise(rank))


def label_variants(df: DataFrame) -> DataFrame:
    """vol_expansion and residual_direction: the validation ladder's label variants."""
    x = Window.partitionBy("ts")
    residual = F.col("next_log_return") - F.avg("next_log_return").over(x)
    return df.withColumns(
        {
            "vol_expansion": (F.abs("next_log_return") > F.col("vol_threshold")).cast("int"),
            "residual_return": residual,
            "residual_direction": (residual > 0).cast("int"),
        }
    )


def auxiliary_targets(df: DataFrame) -> DataFrame:
    """The targets beside the primary one; where a column is missing or null: the simple return, no move, the middle rank,
    no event, the label's direction."""
    close = F.greatest("close", F.lit(EPS))
    own = lambda c, other: F.coalesce(F.col(c).cast("double"), other) if c in df.columns else other
    label = own("label", F.lit(0.0))
    return df.withColumns(
        {
            "target_return": own("next_log_return", (F.col("next_close") - F.col("close")) / close),
            "target_direction": label,
            "target_threshold": own("threshold_label", F.lit(1.0)),
            "target_rank": own("cross_sectional_rank", F.lit(0.5)),
            "target_event": own("event_label", F.lit(0.0)),
            "target_event_direction": own("event_direction", label),
            "target_event_signed": own("event_signed", F.lit(1.0)),
            "target_event_magnitude": own("event_magnitude", F.lit(0.0)),
        }
    )
