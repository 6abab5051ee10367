"""Loss components as aggregates over a prediction set."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import sigmoid, softplus
from barloom.operators.metrics import meet


def focal_loss(df: DataFrame, gamma: float = 2.0, pos_weight: float = 1.0, cap: float = 10.0) -> DataFrame:
    """One row: mean focal binary cross-entropy; positive weights are capped."""
    p = F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))
    yes = F.col("label") == 1
    pt = F.when(yes, p).otherwise(1 - p)
    weight = F.when(yes, F.least(F.lit(pos_weight), F.lit(cap))).otherwise(1.0)
    return df.agg(F.avg(-F.ln(pt) * F.pow(1 - pt, gamma) * weight).alias("focal_loss"))


def smoothness_loss(df: DataFrame, most_seconds: int = 3600) -> DataFrame:
    """One row: mean squared step of mu between a ticker's rows at most an hour apart."""
    w = Window.partitionBy("ticker").orderBy("ts")
    rows = df.select("mu", F.lag("mu").over(w).alias("before"), F.expr("timestampdiff(SECOND, lag(ts) over (partition by ticker order by ts), ts)").alias("gap"))
    rows = rows.where(F.col("gap").between(0, most_seconds))
    return rows.agg(F.coalesce(F.avg(F.pow(F.col("mu") - F.col("before"), 2)), F.lit(0.0)).alias("smoothness_loss"))


def pairwise_rank_loss(df: DataFrame) -> DataFrame:
    """One row: mean softplus(-(a.mu - b.mu)) over pairs of a timestamp with a.ret > b.ret: an equi-join on ts."""
    a = df.select("ts", F.col("ret").alias("ra"), F.col("mu").alias("ma"))
    b = df.select("ts", F.col("ret").alias("rb"), F.col("mu").alias("mb"))
    return a.join(b, "ts").where("ra > rb").agg(F.avg(softplus(-(F.col("ma") - F.col("mb")))).alias("pairwise_rank_loss"))


def volatility_consistency_loss(df: DataFrame, ratio: float = 3.0) -> DataFrame:
    """One row: mean squared excess of |mu| over `ratio` sigmas."""
    return df.agg(F.avg(F.pow(F.greatest(F.abs("mu") - ratio * F.col("sigma"), F.lit(0.0)), 2)).alias("vol_consistency_loss"))


@dataclass(frozen=True)
class Weights:
    """Weights of the multi-task loss's components, and their settings."""

    direction: float = 1.0
    event: float = 0.5
    event_direction: float = 0.5
    regression: float = 1.0
    rank: float = 0.10
    score_alignment: float = 0.10
    volatility: float = 0.10
    smoothness: float = 0.10
    cross_section: float = 0.10
    calibration: float = 0.10
    threshold: float = 0.25
    gamma: float = 2.0
    weight_cap: float = 2.0
    delta: float = 1.0
    limit: float = 2.5
    sigma_floor: float = 0.10
    band: float = 0.0005
    most_seconds: int = 3600
    distribution: str = "huber"


def banded(ret: Column, band: float = 0.0005) -> Column:
    """0 below the neutral band, 1 within it, 2 above it; null without a return."""
    return F.when(ret < -band, 0).when(ret > band, 2).when(ret.isNotNull(), 1)


def _cross_entropy(p: Column, label: Column) -> Column:
    """Of a probability, kept within 1e-7 of 0 and 1; null without a label."""
    p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.when(label >= 0.5, -F.ln(p)).when(label < 0.5, -F.ln(1 - p))


def multitask_loss(df: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """One row: the components of the multi-task loss over a prediction set, and total, their weighted sum.

    df: ts, ticker, p (of going up), mu, log_scale, p_event, p_direction (of up, given an event), p3 (an array: down,
    neutral, up), and the targets label, ret, event_label, event_magnitude and threshold_label. A null target masks its
    row in the components that need it; a component without rows is 0. Without a threshold_label the return is cut by
    the neutral band. Direction given an event counts the rows of events only; event terms weigh a row by its magnitude,
    capped. Ranks are compared within a timestamp.
    """
    w = weights
    scale = softplus(F.col("log_scale")) + 1e-6
    mean = df.agg(F.avg("mu").alias("mean_mu"))
    rows = meet(df, mean)
    p = F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))
    logit = F.ln(p / (1 - p))
    strength = F.least(F.greatest(F.coalesce("event_magnitude", F.lit(1.0)), F.lit(0.0)), F.lit(w.weight_cap))
    error = F.col("mu") - F.col("ret")
    z = (F.col("ret") - F.col("mu")) / scale
    regression = {
        "huber": F.when(F.abs(error) < w.delta, error * error / (2 * w.delta)).otherwise(F.abs(error) - w.delta / 2),
        "mse": error * error,
        "gaussian": z * z / 2 + F.ln(scale) + 0.5 * math.log(2 * math.pi),
    }[w.distribution]
    event_hit = F.when(F.col("event_label") >= 0.5, F.col("p_event")).otherwise(1 - F.col("p_event"))
    sign = F.when(logit < 0, -1.0).otherwise(1.0)
    target = F.coalesce("threshold_label", banded(F.col("ret"), w.band))
    parts = {
        "direction": _cross_entropy(F.col("p"), F.col("label")),
        "event": _cross_entropy(F.col("p_event"), F.col("event_label")) * F.pow(F.greatest(1 - event_hit, F.lit(0.0)), F.lit(w.gamma)) * strength,
        "event_direction": F.when(F.col("event_label") >= 0.5, _cross_entropy(F.col("p_direction"), F.col("label")) * strength),
        "regression": regression,
        "score_alignment": F.when(F.col("ret") != 0, softplus(-F.col("mu") / F.greatest(scale, F.lit(w.sigma_floor)) * sign * F.signum("ret"))),
        "volatility": F.pow(F.greatest(F.abs("mu") / scale - w.limit, F.lit(0.0)), F.lit(2)),
        "cross_section": F.pow(F.greatest(F.abs(F.col("mu") - F.col("mean_mu")) - w.limit, F.lit(0.0)), F.lit(2)),
        "calibration": F.when(F.col("label").isNotNull(), F.pow(sigmoid(F.abs(logit)) - sigmoid(logit * F.signum("mu")), F.lit(2))),
        "threshold": F.when(target.isNotNull(), -F.ln(F.greatest(F.get("p3", target), F.lit(1e-7)))),
    }
    row = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{name}_loss") for name, c in parts.items()])
    ranks = pairwise_rank_loss(df.where("ret is not null")).select(F.coalesce("pairwise_rank_loss", F.lit(0.0)).alias("rank_loss"))
    row = meet(meet(row, ranks), smoothness_loss(df, w.most_seconds))
    total = sum((getattr(w, name) * F.col(f"{name}_loss") for name in (*parts, "rank", "smoothness")), F.lit(0.0))
    return row.withColumn("total", total)
