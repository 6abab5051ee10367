"""Ridge models by sufficient statistics: many fits in one pass, walk-forward evaluation, ablation of feature families.

A ridge fit needs no rows, only their count, means and co-moments. These are taken for all groups at once (map-side
partial sums, one narrow row a group), so that a model for each fold, or for each subset of the features, costs no
further scan: every fit solves a small system in the task that holds its group's row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import backtest, metrics, splits
from barloom.staging import settled

#: Penalty of the squared standardised weights, against the sum of squared errors.
PENALTY = 1.0
LEAST_STD = 1e-8


def vectors(rows: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, x): the features and the target as one array of doubles; rows with a null or NaN among them go.

    One array, one test: a test for each of many columns makes the optimiser derive conditions by the thousand.
    """
    x = F.array(*[F.col(c).cast("double") for c in (*features, target)])
    return rows.select(*keep, x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def moments(rows: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """One row a group: n, mean and the upper triangle of the covariances of the `size` entries of x, row by row."""
    m, x = range(size), F.col("x")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(x[i]) for i in m]).alias("mean"), F.array(*[F.covar_pop(x[i], x[j]) for i in m for j in m if j >= i]).alias("cov")
    )


def _solved(mean: np.ndarray, cov: np.ndarray, n: int, picked: Sequence[int], penalty: float) -> tuple[float, list[float]]:
    """(intercept, weights of all features) of the ridge fit on the picked features, which are standardised for it."""
    m = len(mean) - 1
    full = np.zeros((m + 1, m + 1))
    full[np.triu_indices(m + 1)] = cov
    full = full + np.triu(full, 1).T
    at = np.array(picked, int)
    std = np.maximum(np.sqrt(np.maximum(np.diag(full)[at], 0)), LEAST_STD)
    scaled = full[np.ix_(at, at)] / np.outer(std, std) * n + penalty * np.eye(len(at))
    weights = np.zeros(m)
    weights[at] = np.linalg.solve(scaled, full[at, m] / std * n) / std
    return float(mean[m] - weights @ mean[:m]), weights.tolist()


def ridge(stats: DataFrame, subsets: Mapping[str, Sequence[int]], by: Sequence[str] = (), penalty: float = PENALTY) -> DataFrame:
    """(by, subset, intercept, weights): a fit for each group and each named subset of the features' places.

    Features outside a subset have weight 0. Groups without rows have no fit.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stats.schema}
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                for name, picked in subsets.items():
                    intercept, weights = _solved(np.array(row.mean, float), np.array(row.cov, float), row.n, picked, penalty)
                    out.append((*[getattr(row, c) for c in by], name, intercept, weights))
            yield pd.DataFrame(out, columns=[*by, "subset", "intercept", "weights"])

    return stats.where("n > 0").mapInPandas(run, f"{keys}subset string, intercept double, weights array<double>")


def predicted(rows: DataFrame, models: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """rows (with x) with `name`, the prediction of their group's model (models: by, intercept, weights), and the other columns of models.

    Without groups each row meets all models, which are few.
    """
    products = F.zip_with(F.slice("x", 1, F.size("weights")), "weights", lambda v, w: v * w)
    rows = metrics.meet(rows, models, by)
    return rows.withColumn(name, F.aggregate(products, F.col("intercept"), lambda a, v: a + v)).drop("intercept", "weights")


def fold_scores(rows: DataFrame, folds: DataFrame, features: Sequence[str], label: str = "label", embargo: int = 0, penalty: float = PENALTY) -> DataFrame:
    """(fold, ticker, ts, close, next_close, label, p): each fold's test rows with the probability that the fold's own ridge fit gives them.

    The fit is of the label on the fold's training rows, without the last `embargo` bars of each ticker, so that no
    label reaches into the days after; rows with a null or NaN feature or label go. p is kept within 1e-6 of 0 and 1.
    Folds are a key throughout: their number adds rows, not jobs.
    """
    clean = vectors(rows, features, label, ["ticker", "ts", "close", "next_close"])
    slices = splits.embargo_last(splits.fold_rows(clean, folds), embargo)
    models = ridge(moments(slices.where("split = 'train'"), len(features) + 1, ["fold"]), {"all": range(len(features))}, ["fold"], penalty).drop("subset")
    scored = predicted(slices.where("split = 'test'"), models, "p", ["fold"])
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    return scored.select("fold", "ticker", "ts", "close", "next_close", F.element_at("x", -1).cast("int").alias("label"), p.alias("p"))


def fold_reports(scores: DataFrame, rules: backtest.Rules = backtest.Rules()) -> DataFrame:
    """One row a fold: test_rows, the classification figures with auc and ece, and the backtest's figures of its test rows.

    Each fold is a backtest of its own: rows are numbered, lagged and compounded within it. Scores need close and
    next_close.
    """
    by, scores = ["fold"], settled(scores)
    figures = metrics.confusion(scores, by=by).drop("tp", "fp", "tn", "fn")
    counts = scores.groupBy("fold").agg(F.count(F.lit(1)).alias("test_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    rows = scores.withColumns({"p_up": F.col("p"), "p_down": 1 - F.col("p"), "mu": F.col("p") - 0.5, "sigma": F.lit(1.0)})
    traded = backtest.summary(settled(backtest.executed(backtest.numbered(rows, by), rules, by)), by=by)
    out = counts.join(figures, "fold")
    for part in (metrics.auc(scores, by), metrics.expected_calibration_error(scores, by=by), traded):
        out = out.join(part, "fold")
    return out


def evaluation_summary(reports: DataFrame) -> DataFrame:
    """One row over the folds' reports: counts, and means and population spreads of auc (where defined), accuracy and Sharpe."""
    spread = lambda c: [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return reports.agg(
        F.count(F.lit(1)).alias("fold_count"), F.coalesce(F.sum("test_rows"), F.lit(0)).alias("test_total_rows"), F.avg("test_rows").alias("test_mean_rows"),
        *spread("auc"), *spread("accuracy"), F.avg("sharpe").alias("sharpe_mean"),
    )


def ablation_stages(families: Sequence[tuple[str, Sequence[str]]]) -> tuple[list[str], dict[str, list[int]]]:
    """(all features in order, places of the features that each stage has): a stage has its family and all before it."""
    names: list[str] = []
    stages = {}
    for stage, family in families:
        names += [c for c in family if c not in names]
        stages[stage] = list(range(len(names)))
    return names, stages


def ablation(train: DataFrame, test: DataFrame, families: Sequence[tuple[str, Sequence[str]]], target: str, penalty: float = PENALTY) -> DataFrame:
    """One row a stage of growing features: n_features, n, mae, rmse and corr of its ridge fit's predictions on test.

    The training rows are read once, for the moments of all features; each stage solves a block of them. The test rows
    are read once too: every row meets all stages' weights, of which there are as many as families. Rows with a null or
    NaN among all features aren't used, so that stages are compared on the same rows. corr is 0 where a side is constant.
    """
    names, stages = ablation_stages(families)
    fits = ridge(moments(vectors(train, names, target), len(names) + 1), stages, penalty=penalty)
    size = F.element_at(F.create_map(*[F.lit(v) for stage, at in stages.items() for v in (stage, len(at))]), F.col("subset"))
    fits = fits.select(F.col("subset").alias("stage"), size.alias("n_features"), "intercept", "weights")
    scored = predicted(vectors(test, names, target), fits, "guess").withColumn("wanted", F.element_at("x", -1))
    error = F.col("guess") - F.col("wanted")
    flat = (F.stddev_pop("guess") <= 1e-12) | (F.stddev_pop("wanted") <= 1e-12)
    return scored.groupBy("stage", "n_features").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.when(flat, 0.0).otherwise(F.corr("guess", "wanted")).alias("corr")
    )
