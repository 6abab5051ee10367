"""Hand-made cases of the panel operators, most of all those that SQL doesn't cover."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, baselines, calendar, event_grid, market, metrics, quality, regimes, sequences, splits, stats
from barloom.sources import bars as source
from barloom.sources import reference_data

OPEN = datetime(2024, 1, 3, 9, 30)


def bars_at(spark, times, ticker="ABC"):
    return spark.createDataFrame([(ticker, t) for t in times], "ticker string, ts timestamp_ntz")


def test_events_snap_to_the_open(spark):
    bars = bars_at(spark, [OPEN, OPEN + timedelta(minutes=5)])
    macro = spark.createDataFrame([("ABC", datetime(2024, 1, 3, 8, 30), "cpi")], "ticker string, event_ts timestamp_ntz, event_type string")
    row = calendar.macro_flags(bars, macro).where("ts = timestamp_ntz'2024-01-03 09:30:00'").first()
    assert (row.macro_event_today, row.cpi_day, row.nfp_day) == (1.0, 1.0, 0.0)
    filing = spark.createDataFrame([("ABC", datetime(2024, 1, 3, 7, 40), "2.02")], "ticker string, event_ts timestamp_ntz, item string")
    rows = calendar.post_event_flags(bars, calendar.snap_events(filing, bars)).orderBy("ts").collect()
    assert [(r.earnings_event_bar, r.post_earnings_1bars) for r in rows] == [(1.0, 1.0), (0.0, 1.0)]


def test_breadth_sees_no_later_bar(spark):
    rows = [(OPEN + timedelta(minutes=5 * i), t, r, 1.0) for i in range(3) for t, r in (("AAA", 0.01), ("BBB", -0.02))]
    schema = "ts timestamp_ntz, ticker string, log_return double, relative_volume double"
    first = lambda x: market.breadth(spark.createDataFrame(x, schema)).orderBy("ts").first()
    a, b = first(rows), first(rows[:-1] + [(*rows[-1][:2], 1.0, 1.0)])
    assert (a.ad_share, a.up_volume_share) == (b.ad_share, b.up_volume_share) == (0.5, 0.5)


def test_average_precision_tells_order_from_chance(spark):
    labels = [1] * 20 + [0] * 80
    probs = [0.9 if y else 0.1 for y in labels]
    mixed = probs[:]
    random.Random(7).shuffle(mixed)
    ap = lambda p: metrics.average_precision(spark.createDataFrame(list(zip(range(100), labels, p)), "row_id long, label int, p double")).first()[0]
    assert ap(probs) > 0.99 > ap(mixed)


def test_participation_cap(spark):
    rows = spark.createDataFrame([(0, "A", 1), (1, "A", 1), (2, "A", -1)], "row_id long, ticker string, position int")
    fills = lambda **k: [r.filled for r in backtest.partial_fills(rows, ["ticker"], cap=0.03, notional=0.10, **k).orderBy("row_id").collect()]
    assert fills()[0] == pytest.approx(0.3)
    assert fills(reject=True) == [0.0, 0.0, 0.0]


def test_exponential_means_across_blocks(spark):
    values = np.random.default_rng(1).random(50)
    df = spark.createDataFrame([(OPEN + timedelta(minutes=5 * i), float(v)) for i, v in enumerate(values)], "ts timestamp_ntz, v double")
    got = [r.v_ema_6 for r in market.ema_columns(df, ["v"], [6], block=7).orderBy("ts").collect()]
    assert got == pytest.approx(pd.Series(values).ewm(alpha=2 / 7, adjust=False).mean().tolist())


def test_correlation_chunks(spark):
    r = np.random.default_rng(3).standard_normal((30, 4))
    rows = [(OPEN + timedelta(days=i), f"T{j}", float(r[i, j])) for i in range(30) for j in range(4)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, ticker string, log_return double")
    got = market.realized_correlation(df, 10, chunk=7).orderBy("ts").collect()
    c = np.corrcoef(r[20:30].T)[np.triu_indices(4, 1)]
    assert len(got) == 30 and got[0].avg_corr == 0
    assert (got[29].avg_corr, got[29].corr_dispersion) == pytest.approx((c.mean(), c.std()))


def test_splits_adjust_strictly_earlier_bars(spark):
    bars = spark.createDataFrame([("A", OPEN + timedelta(days=i), 12.0, 12.0, 12.0, 12.0, 6.0) for i in range(3)], "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    raw = spark.createDataFrame([("a", "2024-01-04 09:30:00", "2"), ("A", "2024-01-05", "3"), ("A", "2024-01-05", "1.0"), ("A", "2024-01-05", "0")], "symbol string, date string, ratio string")
    got = sequences.split_adjusted(bars, reference_data.corporate_actions(raw)).orderBy("ts").collect()
    assert [(r.close, r.volume) for r in got] == [(pytest.approx(2.0), pytest.approx(36.0)), (pytest.approx(4.0), pytest.approx(18.0)), (12.0, 6.0)]


def test_sessions_and_sequences(spark):
    times = [OPEN - timedelta(seconds=1), OPEN, OPEN + timedelta(minutes=5), OPEN + timedelta(minutes=20), datetime(2024, 1, 3, 15, 59, 59), datetime(2024, 1, 3, 16)]
    inside = bars_at(spark, times).where(quality.in_session())
    assert inside.count() == 4
    assert [r.seq_id for r in sequences.with_sequences(inside).orderBy("ts").collect()] == [1, 1, 2, 3]


def test_csv_bars(spark, tmp_path):
    (tmp_path / "us_stocks").mkdir()
    (tmp_path / "us_stocks" / "abc.us.txt").write_text("<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\n20240103,93000,1,2,0.5,1.5,10\n20240103,093500,1.5,2,1,2,5\n")
    rows = source.read_csv_bars(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.ticker, r.ts, r.close) for r in rows] == [("ABC", OPEN, 1.5), ("ABC", OPEN + timedelta(minutes=5), 2.0)]
    found = source.discover(spark, str(tmp_path)).first()
    assert (found.ticker, found.exchange, found.asset_type) == ("ABC", "us", "stocks")


def test_panel_tensor_is_padded(spark):
    df = spark.createDataFrame([(OPEN, t, v) for t, v in (("A", 1.0), ("B", 2.0))], "ts timestamp_ntz, ticker string, v double")
    got = {r.ticker: [x[0] for x in r.x] for r in splits.panel_tensors(df, ["v"], 4).collect()}
    assert got == {"A": [0.0, 0.0, 1.0, 2.0], "B": [0.0, 1.0, 2.0, 0.0]}


def test_deflated_sharpe_needs_trials(spark):
    moments = stats.return_moments(spark.createDataFrame([(x,) for x in (0.01, 0.02, -0.01, 0.03)], "net double"))
    assert 0 <= stats.deflated_sharpe(moments, [0.1, 0.2, 0.3])["p_value"] <= 1
    with pytest.raises(ValueError):
        stats.deflated_sharpe(moments, [0.1])


def test_event_times_by_type(spark):
    rows = [(date(2024, 1, 3), None, None, None), (None, datetime(2024, 1, 3, 7, 40), None, None), (None, None, 1704267600.5, None), (None, None, None, "2024-01-03T08:30:00Z"), (None, None, None, "2024-01-03"), (None, None, None, "soon")]
    df = spark.createDataFrame(rows, "date date, accepted_at timestamp_ntz, timestamp double, release_time string")
    got = [r.t for r in df.select(reference_data.event_time(df).alias("t")).collect()]
    assert got == [datetime(2024, 1, 3, 9, 30), datetime(2024, 1, 3, 7, 40), datetime(2024, 1, 3, 7, 40, 0, 500000), datetime(2024, 1, 3, 8, 30), datetime(2024, 1, 3), None]


def test_ranks_over_ranges(spark):
    values = [(float(v),) for v in (-1e9, -2.5, -2.5, 0.0, 1e-9, 3.0, 3.0, 3.0, 1e12)]
    got = {r.v: r.rank for r in metrics.average_ranks(spark.createDataFrame(values, "v double"), "v", "rank").collect()}
    assert got == {-1e9: 1.0, -2.5: 2.5, 0.0: 4.0, 1e-9: 5.0, 3.0: 7.0, 1e12: 9.0}


def test_deep_folders_and_sector_hashes(spark):
    path = "/".join(["", *(f"d{k}" for k in range(90)), "x", "a.us.txt"]).replace("/d3/", "/nasdaq stocks/")
    assert spark.createDataFrame([(path,)], "p string").select(source.group_of(F.col("p")).alias("g")).first().g == "nasdaq stocks"
    df = market.sector_columns(spark.createDataFrame([("A", "Energy"), ("B", "Tech"), ("C", "Energy")], "ticker string, sector string"))
    assert {(r.ticker, r.mctx_sector_id, r.mctx_sector_hash) for r in df.collect()} == {(t, i, market.sector_hash(s)) for t, i, s in (("A", 1.0, "Energy"), ("B", 2.0, "Tech"), ("C", 1.0, "Energy"))}


def test_fills_in_stretches_equal_one_fold(spark, monkeypatch):
    monkeypatch.setattr(backtest, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, float(rng.choice((-1, 0, 1))), rng.choice((0.005, 0.015, 0.03, 0.05))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, position double, max_pov double").repartition(5)
    for reject in (False, True):
        model = backtest.Execution(reject=reject)
        held, wanted = 0.0, []
        for _, want, cap in rows:
            share = 0.02 * abs(want - held)
            if share > cap:
                want = held if reject else held + (want - held) * cap / share
            held = want
            wanted.append(held)
        got = [r.filled for r in backtest.carried_fills(df, model).orderBy("row_id").collect()]
        assert np.allclose(got, wanted)


def test_lags_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(backtest, "BLOCK", 8)
    df = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") * 3 + 1).alias("x")).repartition(4)
    for lag in (0, 1, 3, 7):
        got = backtest.shifted(df, "x", lag, "y").orderBy("row_id").collect()
        assert [r.y for r in got] == [3 * (i - lag) + 1 if i >= lag else 0 for i in range(50)]
    with pytest.raises(ValueError):
        backtest.shifted(df, "x", 8, "y")


def test_viterbi_in_blocks_equals_one_recursion(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1.0, (40, 2)) for m in (0, 3, -2, 3)])
    guess = np.repeat([0, 1, 2, 1], 40)
    guess[::11] = 0
    times = [OPEN + timedelta(minutes=5 * i) for i in range(len(x))]
    df = spark.createDataFrame([(t, int(s), float(a), float(b)) for t, s, (a, b) in zip(times, guess, x, strict=True)], "ts timestamp_ntz, state int, a double, b double")
    prior = np.log(np.bincount(guess, minlength=3) / len(guess))
    moves = np.ones((3, 3))
    np.add.at(moves, (guess[:-1], guess[1:]), 1.0)
    moves = np.log(moves / moves.sum(axis=1, keepdims=True))
    mean = np.array([x[guess == k].mean(axis=0) for k in range(3)])
    var = np.array([np.maximum(x[guess == k].var(axis=0), 1e-4) for k in range(3)])
    emit = -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean) ** 2 / var).sum(axis=2)
    best, back = prior + emit[0], []
    for e in emit[1:]:
        step = best[:, None] + moves
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    for block in (7, 4096):
        got = [r.decoded for r in regimes.viterbi(df, 3, ("a", "b"), block=block).orderBy("ts").collect()]
        assert got == path[::-1]


def test_regimes_are_learnt_from_the_fit_alone(spark):
    rng = np.random.default_rng(8)
    def level(seed_rows, swing):
        steps = np.concatenate([rng.normal(0, swing * k, seed_rows) for k in (1, 3, 9)])
        return spark.createDataFrame([(OPEN + timedelta(minutes=5 * i), float(c)) for i, c in enumerate(np.cumprod(1 + steps))], "ts timestamp_ntz, close double")
    fit, traded = level(80, 1e-3), level(50, 1e-3)
    got = regimes.market_regimes(traded, fit, window=8)
    rows = got.orderBy("ts").collect()
    assert len(rows) == 150 and {r.regime for r in rows} <= set(regimes.POLICIES)
    assert rows[-1].regime == "volatile" and rows[20].regime != "volatile"


def test_policies_change_signals(spark):
    rows = [(i, r, 0.8 if i % 2 else 0.6) for i, r in enumerate(("trending", "mean_reverting", "volatile", "volatile", None))]
    df = spark.createDataFrame(rows, "row_id long, regime string, p_up double").withColumns({"p_down": 1 - F.col("p_up"), "mu": F.lit(0.0), "sigma": F.lit(0.001)})
    rules = backtest.Rules(policies=regimes.POLICIES | {"volatile": "high_confidence"})
    assert [r.signal for r in backtest.with_signal(df, rules).orderBy("row_id").collect()] == [1, -1, 0, 1, 1]


def test_event_grid_of_a_small_panel(spark):
    later = OPEN + timedelta(minutes=5)
    bars = bars_at(spark, [OPEN, later, OPEN + timedelta(days=1)]).unionAll(bars_at(spark, [later], "xyz")).withColumn("sector", F.when(F.col("ticker") == "xyz", 2.0))
    macro = spark.createDataFrame([(OPEN, "employment_situation"), (later, "fomc"), (later, "fomc_press_conference")], "event_ts timestamp_ntz, event_type string")
    filings = spark.createDataFrame(
        [("abc", OPEN, "202", None), ("xyz", OPEN, "5.02", None), ("XYZ", later, None, "results"), ("", later, "2.02", None), (None, later, "2.02", None), ("NEW", later, "2.02", None)],
        "ticker string, event_ts timestamp_ntz, item string, event_type string",
    )
    scheduled = spark.createDataFrame([("abc", OPEN + timedelta(days=1))], "ticker string, event_ts timestamp_ntz")
    rows = {(r.ticker, r.ts): r for r in event_grid.event_grid(bars, macro, filings, scheduled, "sector").collect()}
    assert len(rows) == 4
    first, second, day2, other = rows["ABC", OPEN], rows["ABC", later], rows["ABC", OPEN + timedelta(days=1)], rows["XYZ", later]
    assert (first.nfp_day, first.fomc_statement_bar, second.fomc_statement_bar, second.fomc_press_bar, day2.nfp_day) == (1, 0, 1, 1, 0)
    assert (first.earnings_event_bar, second.earnings_event_bar, second.post_earnings_1bars, other.earnings_event_bar) == (1, 0, 1, 1)
    assert (day2.post_earnings_1bars, day2.post_earnings_3bars) == (0, 1)
    assert second.sec_8k_item202_recent == pytest.approx(np.exp(-1 / 12)) and other.sec_8k_item502_recent == pytest.approx(np.exp(-1 / 12))
    assert (first.earnings_density_same_day_market, second.earnings_density_same_day_market) == (3.0, 1.5)
    assert (second.earnings_density_same_day_sector, other.earnings_density_same_day_sector) == (2.0, 1.0)  # the unknown ticker counts in sector 0
    assert (first.pre_earnings_1d, second.pre_earnings_1d, day2.pre_earnings_1d, other.pre_earnings_1d) == (1, 1, 0, 0)
    none = event_grid.event_grid(bars, macro.limit(0), filings.limit(0))
    assert "pre_earnings_1d" not in none.columns
    assert all(sum(v for k, v in r.asDict().items() if k not in ("ticker", "ts")) == 0 for r in none.collect())


def test_baselines_learn_what_there_is_to_learn(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0.8).astype(int)
    rows = [(i, float(a), float(b), int(t), float(2 * a - b)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (600, None, 0.0, 1, 0.0), (601, float("nan"), 0.0, 0, 0.0)], "i long, a double, b double, label int, ret double")
    train, test = df.where("i % 3 <> 0"), df.where("i % 3 = 0")
    got = baselines.classified(train, test, ("a", "b"), trees=3, hidden=4).toPandas()
    assert len(got) == 200 and set(got["i"]) == set(range(0, 600, 3))
    seen = [t for i, t in enumerate(y) if i % 3]
    assert np.allclose(got["p_prior"], np.mean(seen))
    for name in ("logistic", "trees", "perceptron"):
        p = got[f"p_{name}"]
        assert p.between(0, 1).all() and p[got["label"] == 1].mean() > p[got["label"] == 0].mean() + 0.2
    fits = baselines.regressed(train, test, ("a", "b"), "ret", trees=3).toPandas()
    assert len(fits) == 200 and np.allclose(fits["mu_ridge"], fits["ret"], atol=0.05) and fits["mu_mean"].nunique() == 1
    assert np.corrcoef(fits["mu_trees"], fits["ret"])[0, 1] > 0.6
