"""Market proxy, factor and cointegration figures, cross-sections, breadth, correlation, gaps, sectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barloom.functions.columns import last_rows, upto


def T() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("ts")

#: Frames over timestamps: only for tables with one row per timestamp.


def TS() -> WindowSpec:
    return Window.orderBy("ts")


def X() -> WindowSpec:
    return Window.partitionBy("ts")


def market_proxy(bars: DataFrame) -> DataFrame:
    """One row per ts: mean positive close, its log return and log price."""
    df = bars.groupBy("ts").agg(F.coalesce(F.avg(F.when(F.col("close") > 0, F.col("close"))), F.lit(1.0)).alias("market_close"))
    df = df.withColumn("market_close", F.greatest("market_close", F.lit(1e-8)))
    df = df.withColumn("market_log_return", F.coalesce(F.ln(F.col("market_close") / F.lag("market_close").over(TS())), F.lit(0.0)))
    first = F.first("market_close").over(TS().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("market_log_price", F.ln("market_close") - F.ln(first))


def factor_features(df: DataFrame, market: DataFrame, window: int = 78, least: int = 40, own: str = "log_return") -> DataFrame:
    """Rolling beta against the market return over the ticker's history, and the residual return."""
    df = df.join(market.select("ts", "market_log_return"), "ts", "left")
    frame = last_rows(T(), window)
    n = F.count(own).over(frame)
    sxx = F.var_pop("market_log_return").over(frame) * n
    fits = (n >= least) & (sxx > 1e-12)
    beta = F.when(fits, F.regr_slope(own, "market_log_return").over(frame)).otherwise(0.0)
    alpha = F.when(fits, F.regr_intercept(own, "market_log_return").over(frame)).otherwise(F.avg(own).over(frame))
    df = df.withColumns({"rolling_beta_market": beta, "rolling_alpha_market": alpha})
    return df.withColumn("residual_return_market", F.col(own) - (F.col("rolling_alpha_market") + F.col("rolling_beta_market") * F.col("market_log_return")))


def cointegration_features(df: DataFrame, market: DataFrame, window: int = 78, least: int = 40) -> DataFrame:
    """Residual of log price on market log price, its z-score and AR(1) half-life, by closed forms over window moments."""
    df = df.join(market.select("ts", F.col("market_log_price").alias("x")), "ts", "left")
    df = df.withColumn("y", F.ln(F.greatest("close", F.lit(1e-8))))
    df = df.withColumns({"xl": F.lag("x").over(T()), "yl": F.lag("y").over(T())})
    frame, pairs = last_rows(T(), window), T().rowsBetween(-(window - 2), Window.currentRow)
    n = F.count("y").over(frame)
    fits = (n >= least) & (F.var_pop("x").over(frame) * n > 1e-12)
    slope = F.when(n < least, F.lit(1.0)).when(fits, F.regr_slope("y", "x").over(frame)).otherwise(0.0)
    level = F.when(n < least, F.lit(0.0)).when(fits, F.regr_intercept("y", "x").over(frame)).otherwise(F.avg("y").over(frame))
    df = df.withColumns({"b": slope, "a": level, "n": n})
    mom = lambda f, w: F.expr(f).over(w)
    df = df.withColumns(
        {
            "mean_r": F.avg("y").over(frame) - F.col("a") - F.col("b") * F.avg("x").over(frame),
            "var_r": mom("var_pop(y)", frame) - 2 * F.col("b") * mom("covar_pop(x, y)", frame) + F.col("b") * F.col("b") * mom("var_pop(x)", frame),
            "np": F.count("yl").over(pairs),
            "lag_cov": mom("covar_pop(yl, y)", pairs) - F.col("b") * (mom("covar_pop(yl, x)", pairs) + mom("covar_pop(xl, y)", pairs)) + F.col("b") * F.col("b") * mom("covar_pop(xl, x)", pairs),
            "lag_var": mom("var_pop(yl)", pairs) - 2 * F.col("b") * mom("covar_pop(xl, yl)", pairs) + F.col("b") * F.col("b") * mom("var_pop(xl)", pairs),
        }
    )
    resid = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    std = F.sqrt(F.greatest("var_r", F.lit(0.0)))
    known = (F.least("n", F.lit(window)) >= 4) & (F.col("np") * F.col("lag_var") > 1e-12)
    phi = F.when(known, F.col("lag_cov") / F.when(known, F.col("lag_var")))
    life = F.when((phi > 0) & (phi < 0.999), F.least(F.lit(200.0), F.greatest(F.lit(1.0), -math.log(2) / F.ln(phi)))).otherwise(200.0)
    return df.withColumns(
        {
            "cointegration_residual": resid,
            "cointegration_zscore": F.when(std > 1e-8, (resid - F.col("mean_r")) / F.when(std > 1e-8, std)).otherwise(0.0),
            "cointegration_half_life": life,
        }
    ).drop("x", "y", "xl", "yl", "a", "b", "n", "np", "mean_r", "var_r", "lag_cov", "lag_var")


def cross_section(df: DataFrame, columns: list[str]) -> DataFrame:
    """cs_{c}_rank (ordinal, ties by ticker) and cs_{c}_zscore among the tickers of a timestamp."""
    n = F.count(F.lit(1)).over(X())
    out: dict[str, Column] = {}
    for c in columns:
        low, high = F.min(c).over(X()), F.max(c).over(X())
        rank = (F.row_number().over(X().orderBy(c, "ticker")) - 1) / F.when(n > 1, n - 1)
        out[f"cs_{c}_rank"] = F.when((n == 1) | (low == high), 0.5).otherwise(rank)
        out[f"cs_{c}_zscore"] = F.when(low == high, 0.0).otherwise((F.col(c) - F.avg(c).over(X())) / F.when(low != high, F.stddev_pop(c).over(X())))
    return df.withColumns(out)


def breadth(df: DataFrame) -> DataFrame:
    """One row per ts: advancing and declining shares, up-volume share, signed volume, spread, running A/D of the day."""
    r, v = F.col("log_return"), F.when(F.col("relative_volume") >= 0, F.col("relative_volume")).otherwise(0.0)
    total = F.sum(v)
    df = df.groupBy("ts").agg(
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("ad_share"),
        F.avg(F.when(r < 0, 1.0).otherwise(0.0)).alias("dec_share"),
        F.when(total > 0, F.sum(F.when(r > 0, v).otherwise(0.0)) / F.when(total > 0, total)).otherwise(0.0).alias("up_volume_share"),
        F.sum(F.signum(r) * v).alias("signed_volume"),
        F.median(r).alias("median_return"),
        F.stddev_pop(r).alias("dispersion"),
        (F.count_if(r > 0) - F.count_if(r < 0)).alias("net"),
    )
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts")
    return df.withColumn("cum_ad", F.sum("net").over(upto(day)))


def ema_columns(df: DataFrame, columns: list[str], spans: list[int], block: int = 4096) -> DataFrame:
    """Exponential means of timestamp-level columns, alpha = 2 / (span + 1), seeded with the first value, across days.

    The recursion is linear: blocks of timestamps are folded from 0 in parallel, and what a block carries into the next
    is a second fold over one row per block.
    """
    keep = {f"{c}_ema_{w}": (c, 2.0 / (w + 1)) for c in columns for w in spans}
    rows = df.select("ts", *columns, (F.row_number().over(TS()) - 1).alias("i")).withColumn("block", F.floor(F.col("i") / block))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        out = pdf[["ts", "block"]].assign(k=range(len(pdf)))
        for name, (c, alpha) in keep.items():
            now, values = 0.0, []
            for x in pdf[c]:
                now = alpha * x + (1 - alpha) * now
                values.append(now)
            out[name] = values
        return out

    kind = df.schema["ts"].dataType.simpleString()
    doubles = ", ".join(f"{n} double" for n in keep)
    local = rows.groupBy("block").applyInPandas(fold, f"ts {kind}, block long, k long, {doubles}")
    ends = local.groupBy("block").agg((F.max("k") + 1).alias("m"), *[F.max_by(n, "k").alias(n) for n in keep])
    firsts = rows.where("i = 0").select(*[F.col(c).alias(f"first_{c}") for c in columns])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        out = pdf[["block"]].copy()
        for name, (c, alpha) in keep.items():
            now, values = pdf[f"first_{c}"].iloc[0], []
            for end, m in zip(pdf[name], pdf["m"], strict=True):
                values.append(now)
                now = end + (1 - alpha) ** m * now
            out[f"in_{name}"] = values
        return out

    into = ends.crossJoin(firsts).groupBy().applyInPandas(carry, "block long, " + ", ".join(f"in_{n} double" for n in keep))
    done = local.join(into, "block")
    return done.select("ts", *[(F.col(n) + F.pow(F.lit(1 - a), F.col("k") + 1) * F.col(f"in_{n}")).alias(n) for n, (_, a) in keep.items()])


def new_extremes(bars: DataFrame, days: int = 20) -> DataFrame:
    """One row per ts: shares of tickers at or above (below) the highest (lowest) daily close of the days before."""
    daily = bars.groupBy("ticker", F.to_date("ts").alias("day")).agg(F.max("close").alias("hi"), F.min("close").alias("lo"))
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(-days, -1)
    daily = daily.select("ticker", "day", F.max("hi").over(w).alias("hi"), F.min("lo").over(w).alias("lo"))
    df = bars.withColumn("day", F.to_date("ts")).join(daily, ["ticker", "day"], "left")
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return df.groupBy("ts").agg(share(F.col("close") >= F.col("hi")).alias("new_high_share"), share(F.col("close") <= F.col("lo")).alias("new_low_share"))


def liquid_tickers(df: DataFrame, most: int) -> DataFrame:
    return df.groupBy("ticker").count().orderBy(F.col("count").desc(), "ticker").limit(max(2, most)).select("ticker")


CORRELATION = ("avg_corr", "corr_dispersion", "market_mode_share", "resid_avg_corr", "common_factor_share")


def _correlations(block: np.ndarray) -> tuple[float, ...]:
    """Of a window (rows: timestamps, columns: tickers): mean and spread of correlations, market mode, residual mean, common share."""

    def pack(x: np.ndarray) -> tuple[float, float, float]:
        std = x.std(axis=0)
        z = (x[:, std > 1e-12] - x[:, std > 1e-12].mean(axis=0)) / std[std > 1e-12]
        n = z.shape[1]
        if n < 2:
            return 0.0, 0.0, 0.0
        c = (z.T @ z / len(z))[np.triu_indices(n, 1)]
        return c.mean(), c.std(), z.mean(axis=1).var() / n

    block = block[:, block.std(axis=0) > 1e-12]  # tickers without movement count nowhere
    if block.shape[1] < 2:
        return (0.0,) * 5
    mean, spread, mode = pack(block)
    resid = block - block.mean(axis=1, keepdims=True)
    whole = block.var(axis=0).sum()
    share = min(1.0, max(0.0, 1 - resid.var(axis=0).sum() / whole)) if whole > 1e-12 else 0.0
    return mean, spread, mode, pack(resid)[0], share


def realized_correlation(df: DataFrame, window: int, most: int = 300, chunk: int = 512) -> DataFrame:
    """One row per ts: the correlation pack over the last `window` timestamps of the most liquid tickers.

    A missing return counts as 0. Timestamps are cut into chunks that carry the window - 1 rows before them, so that
    chunks run in parallel and each holds (chunk + window) * most numbers.
    """
    top = liquid_tickers(df, most)
    stamps = df.select("ts").distinct().withColumn("i", F.row_number().over(TS()) - 1)
    rows = df.join(top, "ticker", "left_semi").join(stamps, "ts").select("i", "ts", "ticker", "log_return")
    rows = rows.unionByName(stamps.select("i", "ts", F.lit(None).cast("string").alias("ticker"), F.lit(0.0).alias("log_return")))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("i") / chunk), F.floor((F.col("i") + window - 1) / chunk))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stamps = pdf.drop_duplicates("i").set_index("i")["ts"].sort_index()
        grid = pdf.dropna(subset=["ticker"]).pivot_table(index="i", columns="ticker", values="log_return", aggfunc="last")
        grid = grid.reindex(stamps.index).fillna(0.0).to_numpy()
        out = []
        for k, i in enumerate(stamps.index):
            if i // chunk != key[0]:
                continue
            full = i + 1 >= max(3, window)
            out.append((stamps[i], *(_correlations(grid[k - window + 1 : k + 1]) if full and grid.shape[1] > 1 else (0.0,) * 5)))
        return pd.DataFrame(out, columns=["ts", *CORRELATION])

    kind = df.schema["ts"].dataType.simpleString()
    return rows.groupBy("chunk").applyInPandas(run, f"ts {kind}, " + ", ".join(f"{c} double" for c in CORRELATION))


def gap_regime(df: DataFrame, window: int = 60) -> DataFrame:
    """(ticker, day, gap_z): each sequence's opening gap against the sequence before, standardised; the day's last wins."""
    seq = df.groupBy("ticker", "seq_id").agg(
        F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close")
    )
    w = Window.partitionBy("ticker").orderBy("ts")
    seq = seq.withColumn("gap", F.ln(F.col("open") / F.lag("close").over(w))).where("gap is not null")
    frame = last_rows(w, window)
    std = F.stddev_pop("gap").over(frame)
    z = F.when(std > 1e-12, (F.col("gap") - F.avg("gap").over(frame)) / F.when(std > 1e-12, std)).otherwise(0.0)
    return seq.withColumn("z", z).groupBy("ticker", F.to_date("ts").alias("day")).agg(F.max_by("z", "ts").alias("gap_z"))


def sector_columns(sectors: DataFrame) -> DataFrame:
    """(ticker, sector, mctx_sector_id, mctx_sector_hash): place among the sorted sectors, and a stable hash of the name."""
    names = sectors.select("sector").distinct().withColumn("mctx_sector_id", F.row_number().over(Window.orderBy("sector")).cast("double"))
    names = names.withColumn("mctx_sector_hash", F.pandas_udf(lambda s: s.map(sector_hash), "double")("sector"))
    return sectors.join(names, "sector")


def unknown_sectors(bars: DataFrame) -> DataFrame:
    """(ticker, sector) where no sector map exists: every ticker in one bucket."""
    return bars.select("ticker").where("ticker <> ''").distinct().withColumn("sector", F.lit("UNKNOWN"))


def sector_hash(sector: str) -> float:
    return int.from_bytes(hashlib.blake2b(sector.encode(), digest_size=4).digest(), "big") % 1000 / 1000.0


def attach_context(df: DataFrame, by_ts: list[DataFrame], by_day: DataFrame | None = None) -> DataFrame:
    """Left joins of timestamp- and day-level tables; missing figures become 0. Spark broadcasts those that are small."""
    added: list[str] = []
    for table in by_ts:
        added += [c for c in table.columns if c != "ts"]
        df = df.join(table, "ts", "left")
    if by_day is not None:
        added += [c for c in by_day.columns if c != "day"]
        df = df.withColumn("day", F.to_date("ts")).join(by_day, "day", "left").drop("day")
    return df.fillna(0.0, subset=added)
