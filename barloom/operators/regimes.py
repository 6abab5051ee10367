"""Market regimes from a timestamp-level series: features, states, transitions, decoding, policies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barloom.functions.columns import last_rows
from barloom.staging import settled


def TS() -> WindowSpec:
    return Window.orderBy("ts")  # one row per timestamp


def ALL() -> WindowSpec:
    return Window.partitionBy()

FEATURES = ("z_return", "z_vol", "z_lag")


def regime_features(series: DataFrame, window: int = 12) -> DataFrame:
    """From (ts, close): simple return, rolling spread and mean lag product, each standardised over the whole series."""
    window = max(4, window)
    before = F.lag("close").over(TS())
    df = series.select("ts", "close", F.when(before > 0, (F.col("close") - before) / F.when(before > 0, before)).otherwise(0.0).alias("ret"))
    df = df.withColumn("lagged", F.coalesce(F.col("ret") * F.lag("ret").over(TS()), F.lit(0.0)))
    df = df.withColumns({"vol": F.stddev_pop("ret").over(last_rows(TS(), window)), "lag_mean": F.avg("lagged").over(last_rows(TS(), window))})
    for name, c in zip(FEATURES, ("ret", "vol", "lag_mean"), strict=True):
        std = F.stddev_pop(c).over(ALL())
        df = df.withColumn(name, F.when(std > 1e-12, (F.col(c) - F.avg(c).over(ALL())) / F.when(std > 1e-12, std)).otherwise(0.0))
    return df.drop("lagged")


def volatility_states(features: DataFrame, states: int = 3) -> DataFrame:
    """state: the rank of the rolling spread in `states` equal parts."""
    n = F.count(F.lit(1)).over(ALL())
    rank = F.row_number().over(Window.orderBy("vol", "ts")) - 1
    return features.withColumn("state", F.least(F.floor(rank * states / n), F.lit(states - 1)).cast("int"))


def kmeans_states(features: DataFrame, states: int = 3, rounds: int = 20, names: Sequence[str] = FEATURES) -> DataFrame:
    """state: the nearest of `states` centres (the first of equal ones) after `rounds` of k-means over the features.

    Centres start as the means of the parts that volatility_states cuts, so that nothing is drawn by chance; a centre
    without rows stays where it is. A round is one aggregate of a narrow row per timestamp; the driver holds the centres
    alone and stops when they don't move.
    """
    names = list(names)
    rows = settled(volatility_states(features, states))
    means = [F.avg(c).alias(c) for c in names]

    def nearest(at: list[list[float]]) -> Column:
        away = [sum((F.pow(F.col(c) - x, F.lit(2)) for c, x in zip(names, centre, strict=True)), F.lit(0.0)) for centre in at]
        return F.array_min(F.array(*[F.struct(a.alias("away"), F.lit(k).alias("state")) for k, a in enumerate(away)])).state

    found = {r["state"]: [r[c] for c in names] for r in rows.groupBy("state").agg(*means).collect()}
    centres = [found.get(k, [0.0] * len(names)) for k in range(states)]
    for _ in range(rounds):
        found = {r["nearest"]: [r[c] for c in names] for r in rows.groupBy(nearest(centres).alias("nearest")).agg(*means).collect()}
        moved = [found.get(k, centre) for k, centre in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return features.withColumn("state", nearest(centres).cast("int"))


def transition_matrix(df: DataFrame, states: int = 3, smoothing: float = 1.0) -> DataFrame:
    """(prev_state, state, p): Laplace-smoothed shares of the next state."""
    pairs = df.select(F.lag("state").over(TS()).alias("prev_state"), "state").where("prev_state is not null").groupBy("prev_state", "state").count()
    spark = df.sparkSession
    grid = spark.range(states * states).select(F.floor(F.col("id") / states).cast("int").alias("prev_state"), (F.col("id") % states).cast("int").alias("state"))
    grid = grid.join(pairs, ["prev_state", "state"], "left").withColumn("c", F.coalesce("count", F.lit(0)) + smoothing)
    return grid.select("prev_state", "state", (F.col("c") / F.sum("c").over(Window.partitionBy("prev_state"))).alias("p"))


def state_stats(df: DataFrame) -> DataFrame:
    """Per state: count, mean, spread, lag-1 correlation, trend and reversion scores, and its regime."""
    rows = df.withColumn("before", F.lag("ret").over(TS()))
    known = F.count("before")
    flat = (F.stddev_pop(F.when(F.col("before").isNotNull(), F.col("ret"))) <= 1e-12) | (F.stddev_pop("before") <= 1e-12)
    s = rows.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility"),
        F.when((known < 2) | flat, 0.0).otherwise(F.corr("before", "ret")).alias("autocorr"),
    )
    s = s.withColumns(
        {
            "trend_score": F.abs("mean_return") / F.greatest("volatility", F.lit(1e-6)) + F.greatest(F.lit(0.0), F.col("autocorr")),
            "reversion_score": F.greatest(F.lit(0.0), -F.col("autocorr")) + F.col("volatility") / F.greatest(F.abs("mean_return"), F.lit(1e-6)) * 0.05,
        }
    )
    s = s.withColumns({"k": F.count(F.lit(1)).over(ALL()), "by_vol": F.row_number().over(Window.orderBy(F.col("volatility").desc(), "state"))})
    s = s.withColumn("by_trend", F.row_number().over(Window.partitionBy(F.col("by_vol") == 1).orderBy(F.col("trend_score").desc(), "state")))
    regime = (
        F.when(F.col("k") == 1, "trending").when(F.col("by_vol") == 1, "volatile")
        .when(F.col("k") == 2, F.when(F.col("autocorr") < 0, "mean_reverting").otherwise("trending"))
        .when(F.col("by_trend") == 1, "trending").otherwise("mean_reverting")
    )
    return s.withColumn("regime", regime).drop("k", "by_vol", "by_trend")


def fitted(df: DataFrame, states: int = 3, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row: log prior, log transitions, means and variances of the states' diagonal Gaussians, as arrays by state."""
    n = len(features)
    ids = df.sparkSession.range(states).select(F.col("id").cast("int").alias("state"))
    stats = df.groupBy("state").agg(
        F.count(F.lit(1)).alias("k"), F.array(*[F.avg(c) for c in features]).alias("mean"), F.array(*[F.greatest(F.var_pop(c), F.lit(1e-4)) for c in features]).alias("var")
    )
    total = F.sum(F.coalesce("k", F.lit(0))).over(ALL())
    stats = ids.join(stats, "state", "left").select(
        "state", F.greatest(F.lit(1e-6), F.coalesce("k", F.lit(0)) / F.greatest(F.lit(1), total)).alias("prior"),
        F.coalesce("mean", F.array_repeat(F.lit(0.0), n)).alias("mean"), F.coalesce("var", F.array_repeat(F.lit(1.0), n)).alias("var"),
    )
    stats = stats.withColumn("prior", F.ln(F.col("prior") / F.sum("prior").over(ALL())))
    in_order = lambda c, key: F.transform(F.array_sort(F.collect_list(F.struct(*key, c))), lambda x: x[c])
    by_state = stats.agg(in_order("prior", ["state"]).alias("prior"), F.flatten(in_order("mean", ["state"])).alias("mean"), F.flatten(in_order("var", ["state"])).alias("var"))
    moves = transition_matrix(df, states).withColumn("p", F.ln("p")).agg(in_order("p", ["prev_state", "state"]).alias("moves"))
    return by_state.crossJoin(moves)  # one row each


def _emissions(pdf: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(emissions by row and state, log transitions, log prior) of rows that carry a fitted model."""
    first = pdf.iloc[0]
    prior = np.array(first["prior"], float)
    k = len(prior)
    mean, var, moves = (np.array(first[c], float).reshape(k, -1) for c in ("mean", "var", "moves"))
    x = pdf[names].to_numpy(float)[:, None, :]
    return -0.5 * (np.log(2 * np.pi * var)[None] + (x - mean[None]) ** 2 / var[None]).sum(axis=2), moves, prior


def viterbi(df: DataFrame, states: int = 3, features: Sequence[str] = FEATURES, fit: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """decoded: the likeliest state path under diagonal Gaussian emissions fitted to the states of `fit`, df itself if none.

    A max-plus recursion in three steps over one row per timestamp: each block of timestamps gives its best scores from
    entry to exit state, a fold over one row per block picks the states at the blocks' ends, and each block is decoded
    between them.
    """
    names = list(features)
    model = fitted(df if fit is None else fit, states, features)
    rows = df.withColumn("block", F.floor((F.row_number().over(TS()) - 1) / block))
    series = rows.select("block", "ts", *names).crossJoin(F.broadcast(model))  # exactly one row

    def scores(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        emit, moves, prior = _emissions(pdf, names)
        best = np.full((len(prior), len(prior)), -np.inf)
        np.fill_diagonal(best, emit[0])
        for e in emit[1:]:
            best = (best[:, :, None] + moves[None]).max(axis=1) + e
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "best": [best.ravel()], "prior": [prior], "moves": [moves.ravel()]})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        prior = np.array(pdf["prior"].iloc[0], float)
        k = len(prior)
        moves = np.array(pdf["moves"].iloc[0], float).reshape(k, k)
        tables = [np.array(b, float).reshape(k, k) for b in pdf["best"]]
        enter, score, back = prior, None, []
        for i, best in enumerate(tables):
            if i:
                step = score[:, None] + moves
                back.append(step.argmax(axis=0))  # the exit before, by entry
                enter = step.max(axis=0)
            tables[i] = enter[:, None] + best
            score = tables[i].max(axis=0)
        out, leave = [], int(score.argmax())
        for i in range(len(tables) - 1, -1, -1):
            entry = int(tables[i][:, leave].argmax())
            out.append((pdf["block"].iloc[i], entry, leave))
            leave = int(back[i - 1][entry]) if i else -1
        return pd.DataFrame(out, columns=["block", "entry", "leave"])

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        emit, moves, prior = _emissions(pdf, names)
        best, back = np.full(len(prior), -np.inf), np.zeros((len(emit), len(prior)), int)
        best[pdf["entry"].iloc[0]] = emit[0][pdf["entry"].iloc[0]]
        for t in range(1, len(emit)):
            step = best[:, None] + moves
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + emit[t]
        found = np.empty(len(emit), int)
        found[-1] = pdf["leave"].iloc[0]
        for t in range(len(emit) - 1, 0, -1):
            found[t - 1] = back[t, found[t]]
        return pd.DataFrame({"ts": pdf["ts"], "decoded": found.astype("int32")})

    tables = series.groupBy("block").applyInPandas(scores, "block long, best array<double>, prior array<double>, moves array<double>")
    at_ends = tables.groupBy().applyInPandas(ends, "block long, entry int, leave int")
    kind = df.schema["ts"].dataType.simpleString()
    found = series.join(at_ends, "block").groupBy("block").applyInPandas(path, f"ts {kind}, decoded int")
    return df.join(found, "ts")


def market_regimes(level: DataFrame, fit: DataFrame, states: int = 3, window: int = 32) -> DataFrame:
    """(ts, regime) of the series `level` (ts, close), by a model of the series `fit` alone, so that nothing is learnt from the traded rows.

    States come from the fit's rolling spread, their regimes from the fit's decoded path. Both series, a narrow row per
    timestamp, are settled, as several steps read them.
    """
    learnt = settled(volatility_states(regime_features(fit, window), states))
    named = state_stats(viterbi(learnt, states).withColumn("state", F.col("decoded"))).select(F.col("state").alias("decoded"), "regime")
    found = viterbi(settled(regime_features(level, window)), states, fit=learnt)
    return found.join(F.broadcast(named), "decoded", "left").select("ts", F.coalesce("regime", F.lit("trending")).alias("regime"))  # one row per state


POLICIES = {"trending": "follow", "mean_reverting": "flip", "volatile": "flat"}


def adapted(position: Column, regime: Column, confidence: Column, policies: dict[str, str] = POLICIES, least: float = 0.7) -> Column:
    """The position after the regime's policy: follow, flip, flat or high_confidence."""

    def by(policy: str) -> Column:
        return {"flip": -position, "flat": F.lit(0), "high_confidence": F.when(confidence >= least, position).otherwise(0)}.get(policy, position)

    out = F.when(F.lit(False), position)
    for name, policy in policies.items():
        out = out.when(regime == name, by(policy))
    return out.otherwise(position)
