"""Multiple-testing controls: false discovery rate, deflated Sharpe ratio, bootstrap tests."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.metrics import meet, with_before
from barloom.staging import settled

NORMAL = NormalDist()
EULER = 0.5772156649015329
#: Bootstrap counts come from (i * A + rep * B + C) mod a prime, squared twice. Any engine can repeat them.
PRIME, A, B, C = 2_147_483_647, 48_271, 69_621, 16_807
#: The Poisson(1) distribution function from 0 on; a row that is drawn more than a dozen times is beyond a double's hash.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))
#: Coefficients of the normal distribution's tail (Abramowitz and Stegun 26.2.17, fixed values).
NEAR = 0.2316419
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def benjamini_hochberg(df: DataFrame, alpha: float = 0.10, p: str = "p_value", key: str = "test_id") -> DataFrame:
    """Adds rank, rejected and threshold: all tests up to the last with p <= rank / m * alpha. One row per test.

    A test's rank is the number of smaller p-values, by ranges of them, and its place among its equals.
    """
    df = df.withColumn("clipped", F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)))
    counts = with_before(df.groupBy("clipped").agg(F.count(F.lit(1)).alias("k")), "clipped", "k").select("clipped", "before")
    among = F.row_number().over(Window.partitionBy("clipped").orderBy(key))
    df = df.withColumn("among", among).join(counts, "clipped").withColumn("rank", (F.col("before") + F.col("among")).cast("long")).drop("before", "among")
    df = meet(df, df.agg(F.count(F.lit(1)).alias("m")))
    last = df.agg(F.coalesce(F.max(F.when(F.col("clipped") <= F.col("rank") / F.col("m") * alpha, F.col("rank"))), F.lit(0)).alias("last"))
    df = meet(df, last)
    return df.withColumns({"rejected": F.col("rank") <= F.col("last"), "threshold": F.col("last") / F.col("m") * alpha}).drop("clipped", "m", "last")


def return_moments(df: DataFrame, column: str = "net") -> DataFrame:
    """One row: n, mean, population std, Sharpe, skewness and non-excess kurtosis."""
    std = F.stddev_pop(column)
    flat = std <= 1e-12
    return df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), std.alias("std"), F.when(flat, 0.0).otherwise(F.avg(column) / F.when(~flat, std)).alias("sharpe"),
        F.when(flat, 0.0).otherwise(F.skewness(column)).alias("skew"), F.when(flat, 3.0).otherwise(F.kurtosis(column) + 3).alias("kurt"),
    )


def deflated_sharpe(moments: DataFrame, trial_sharpes: list[float]) -> dict[str, float]:
    """Deflated Sharpe ratio of a moments row against the Sharpe ratios of the trials."""
    row = moments.first()
    k = len(trial_sharpes)
    mean = sum(trial_sharpes) / k
    std = max(1e-8, math.sqrt(sum((x - mean) ** 2 for x in trial_sharpes) / k))
    if k < 2:
        raise ValueError("a deflated Sharpe ratio needs two trials or more")
    top = mean + std * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / k) + EULER * NORMAL.inv_cdf(1 - 1 / (k * math.e)))
    s = row["sharpe"]
    spread = max(1e-8, 1 - row["skew"] * s + (row["kurt"] - 1) * s * s / 4)
    z = (s - top) * math.sqrt(max(2, row["n"]) - 1) / math.sqrt(spread)
    return {"observed": s, "benchmark": top, "z": z, "p_value": 1 - NORMAL.cdf(z)}


def mean_p_value(mean: float, std_sample: float, n: int) -> float:
    """One-sided normal p-value of a positive mean."""
    return 1 - NORMAL.cdf(mean / math.sqrt(max(1e-12, std_sample**2) / n)) if n > 1 else 1.0


def _drawn(rows: DataFrame) -> DataFrame:
    """rows (t, rep) with c: how often a repetition draws a row, the Poisson(1) quantile of a hash of both.

    Whole numbers that any engine can repeat; each step is a column of its own, as its square would else compute it twice.
    """
    rows = rows.withColumn("z", F.pmod(F.col("t") * A + F.col("rep") * B + C, F.lit(PRIME)))
    for more in (F.col("rep") * B, F.lit(A)):
        rows = rows.withColumn("z", F.pmod(F.col("z") * F.col("z") + more, F.lit(PRIME)))
    rows = rows.withColumn("u", F.col("z") / float(PRIME))
    return rows.withColumn("c", sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0))).drop("z", "u")


def resampled(series: DataFrame, reps: int) -> DataFrame:
    """(strategy, rep, n, s1, s2): count, sum and sum of squares of the resampled centred values, from (strategy, t, ret).

    Each row counts itself in every repetition by a hash of its place, so nothing is looked up: a task's partial sums,
    strategies x reps rows of them, are all that is shuffled.
    """
    means = series.groupBy("strategy").agg(F.avg("ret").alias("mean"))
    rows = series.join(means, "strategy").select("strategy", "t", (F.col("ret") - F.col("mean")).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return _drawn(rows).groupBy("strategy", "rep").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("s1"), F.sum(F.col("c") * F.col("x") * F.col("x")).alias("s2"))


def reality_check(series: DataFrame, reps: int = 100) -> DataFrame:
    """From (strategy, t, ret), t numbered from 0: White's Reality Check p-value and the best observed mean."""
    best = series.groupBy("strategy").agg(F.avg("ret").alias("m")).agg(F.max("m").alias("observed"))
    boot = resampled(series, reps).groupBy("rep").agg(F.max(F.col("s1") / F.col("n")).alias("m"))
    return boot.crossJoin(best).groupBy("observed").agg(F.avg((F.col("m") >= F.col("observed")).cast("double")).alias("p_value"))


def spa_test(series: DataFrame, reps: int = 100) -> DataFrame:
    """Hansen's SPA test against a zero benchmark: studentised means, floored at 0."""
    stat = F.avg("ret") / F.greatest(F.stddev_pop("ret"), F.lit(1e-8)) * F.sqrt(F.count(F.lit(1)))
    top = series.groupBy("strategy").agg(stat.alias("s")).agg(F.greatest(F.lit(0.0), F.max("s")).alias("observed"))
    mean = F.col("s1") / F.col("n")
    spread = F.greatest(F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(1e-8))
    boot = resampled(series, reps).groupBy("rep").agg(F.greatest(F.lit(0.0), F.max(mean / spread * F.sqrt("n"))).alias("s"))
    return boot.crossJoin(top).groupBy("observed").agg(F.avg((F.col("s") >= F.col("observed")).cast("double")).alias("p_value"))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, within 1e-7."""
    k = 1 / (1 + NEAR * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * sum((c * F.pow(k, F.lit(i + 1)) for i, c in enumerate(TAIL)), F.lit(0.0))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def selection_bias(returns: DataFrame, sharpes: DataFrame, primary: str, reps: int = 500, alpha: float = 0.10) -> DataFrame:
    """One row: the deflated Sharpe ratio of `primary` among the trials, both bootstrap tests, and the false discovery rate.

    returns: (strategy, t, ret); sharpes: one row per trial. The trials' count decides the expected best Sharpe ratio of
    luck alone, so it is taken first (a count of trials, not of rows). candidates and discoveries count the strategies
    and those whose one-sided p-value of a positive mean passes.
    """
    returns, sharpes = settled(returns), settled(sharpes)
    k = sharpes.count()
    luck = (1 - EULER) * NORMAL.inv_cdf(1 - 1 / k) + EULER * NORMAL.inv_cdf(1 - 1 / (k * math.e)) if k > 1 else 0.0
    trials = sharpes.agg((F.avg("sharpe") + F.greatest(F.stddev_pop("sharpe"), F.lit(1e-8)) * luck).alias("benchmark"), F.count(F.lit(1)).alias("trials"))
    own = return_moments(returns.where(F.col("strategy") == primary), "ret").select("n", "sharpe", "skew", "kurt")
    s = F.col("sharpe")
    spread = F.greatest(F.lit(1e-8), 1 - F.col("skew") * s + (F.col("kurt") - 1) * s * s / 4)
    row = meet(own, trials).withColumn("z", (s - F.col("benchmark")) * F.sqrt(F.greatest(F.lit(2), F.col("n")) - 1) / F.sqrt(spread))
    row = row.select(s.alias("observed_sharpe"), F.col("benchmark").alias("benchmark_sharpe"), "z", (1 - normal_cdf(F.col("z"))).alias("p_value"), "trials", F.col("n").alias("sample_length"))
    one_sided = 1 - normal_cdf(F.avg("ret") / F.sqrt(F.greatest(F.lit(1e-12), F.coalesce(F.var_samp("ret"), F.lit(0.0))) / F.count(F.lit(1))))
    tests = returns.groupBy("strategy").agg(F.when(F.count(F.lit(1)) > 1, one_sided).otherwise(1.0).alias("p_value"))
    found = benjamini_hochberg(tests, alpha, key="strategy").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("rejected").alias("discoveries"))
    for part in (reality_check(returns, reps).select(F.col("p_value").alias("reality_check_p")), spa_test(returns, reps).select(F.col("p_value").alias("spa_p")), found):
        row = meet(row, part)  # one row each
    return row
