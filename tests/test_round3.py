"""Selection, fills, calibration, fits by moments and sources, against plain computations on small made tables."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import staging
from barloom.operators import backtest, calendar, metrics, regimes, sequences, splits, stats, walk_forward
from barloom.sources import bars as source
from barloom.sources import reference_data, sinks

OPEN = datetime(2024, 1, 3, 9, 30)


def plain_top(rows: list[tuple], share: float) -> set[int]:
    """row ids of the best share of (row_id, score): NaN first, nulls last, ties in row order."""
    key = lambda s: -np.inf if s is None else np.inf if s != s else s
    k = max(1, int(len(rows) * share))
    return {i for i, _ in sorted(rows, key=lambda r: (-key(r[1]), r[0]))[:k]}


@pytest.mark.parametrize("kind", ["many", "ties", "flat", "far", "odd"])
def test_top_share_is_the_sorted_share(spark, kind, monkeypatch):
    monkeypatch.setattr(metrics, "CELLS", 4)  # several values in the last cell
    monkeypatch.setattr(metrics, "BLOCK", 16)  # ties over several blocks of row numbers
    r = random.Random(kind)
    value = {
        "many": lambda: r.random(), "ties": lambda: float(r.randrange(4)), "flat": lambda: 2.5, "far": lambda: r.choice([-1e300, 1e300, 1e-300, r.gauss(0, 1), 0.0]),
        "odd": lambda: r.choice([None, float("nan"), float("inf"), -float("inf"), 0.5, r.random()]),
    }[kind]
    rows = [(g, i, value()) for g in ("a", "b") for i in r.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "g string, row_id long, score double")
    for share in (0.001, 0.3, 1.0):
        got = {(x.g, x.row_id) for x in metrics.top_share(df, share, F.col("score"), ["g"]).collect()}
        assert got == {(g, i) for g in ("a", "b") for i in plain_top([(i, s) for h, i, s in rows if h == g], share)}
    alone = {x.row_id for x in metrics.top_share(df.where("g = 'a'"), 0.25, F.col("score")).collect()}
    assert alone == plain_top([(i, s) for h, i, s in rows if h == "a"], 0.25)


def test_share_may_be_a_key(spark):
    rows = [(i, float(i % 37)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, score double").withColumn("share", F.explode(F.array(F.lit(0.1), F.lit(0.5))))
    got = metrics.top_share(df, F.col("share"), F.col("score"), ["share"]).collect()
    for share in (0.1, 0.5):
        assert {r.row_id for r in got if r.share == share} == plain_top(rows, share)


@pytest.mark.parametrize("reject", [False, True])
@pytest.mark.parametrize("cap", [0.0001, 0.004, 0.011, 0.03, 0.05])
def test_fills_over_blocks_are_one_fold(spark, monkeypatch, reject, cap):
    """Caps that never free a row of what was held before, so that every block hangs on all before it."""
    monkeypatch.setattr(backtest, "BLOCK", 8)
    r = random.Random(4)
    rows = [(t, i, r.choice([-1, 0, 1]), cap * r.choice([0.5, 1.0])) for t in ("A", "B") for i in range(90)]
    df = spark.createDataFrame(rows, "ticker string, row_id long, position int, max_pov double")
    model = backtest.Execution(reject=reject)
    got = {(x.ticker, x.row_id): x.filled for x in backtest.carried_fills(df, model, ["ticker"]).collect()}
    for ticker in ("A", "B"):
        held = 0.0
        for t, i, want, most in rows:
            if t == ticker:
                held = backtest._fill(float(want), held, most, model)
                assert got[t, i] == pytest.approx(held, abs=1e-9)


def test_composed_fills_are_maps_of_all_positions():
    r = random.Random(8)
    model = backtest.Execution()
    for _ in range(60):
        wants, caps = [r.choice([-1.0, 0.0, 1.0, 0.3]) for _ in range(12)], [r.choice([0.0005, 0.002, 0.006]) for _ in range(12)]
        xs, ys = backtest._block_map(wants, caps, model)
        for start in np.linspace(-1, 1, 41):
            held = float(start)
            for want, cap in zip(wants, caps, strict=True):
                held = backtest._fill(want, held, cap, model)
            assert np.interp(start, xs, ys) == pytest.approx(held, abs=1e-9)


def test_calibration_looks_steps_up(spark):
    steps = spark.createDataFrame([("a", 0, 0.3, 0.1), ("a", 1, 0.6, 0.4), ("a", 2, 0.9, 0.8)], "bucket string, step int, upper double, value double")
    heat = spark.createDataFrame([("a", 2.0)], "bucket string, temperature double")
    rows = spark.createDataFrame([("a", 0.0), ("a", 0.3), ("a", 0.31), ("a", 0.9), ("a", 0.95), ("none", 0.7)], "bucket string, p double")
    got = {r.p: (r.p_isotonic, r.p_temperature) for r in metrics.calibrated_scores(rows, steps, heat).collect()}
    assert [got[p][0] for p in (0.0, 0.3, 0.31, 0.9, 0.95, 0.7)] == [0.1, 0.1, 0.4, 0.8, 0.8, 0.7]
    assert got[0.9][1] == pytest.approx(0.75) and got[0.7][1] == 0.7


def made_panel(n: int = 400, seed: int = 2):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 5)) * [1, 10, 0.01, 3, 1] + [0, 100, 0, -5, 2]
    x[:, 4] = x[:, 0] * 2 + x[:, 3]  # collinear
    y = x @ [0.3, 0.01, 5, -0.1, 0.2] + g.normal(size=n)
    return x, y


def plain_ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, np.ndarray]:
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean())) / std
    return y.mean() - w @ mean, w


def test_ridge_from_moments_is_the_fit_on_rows(spark):
    x, y = made_panel()
    names = [f"f{i}" for i in range(5)]
    rows = [(int(k % 3), *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    rows += [(0, None, *[1.0] * 5), (1, float("nan"), *[1.0] * 5)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in names) + ", y double")
    stats_ = walk_forward.moments(walk_forward.vectors(df, names, "y", ["g"]), 6, ["g"])
    got = {(r.g, r.subset): r for r in walk_forward.ridge(stats_, {"all": range(5), "two": [1, 3]}, ["g"]).collect()}
    for g in range(3):
        mine = np.arange(len(x)) % 3 == g
        for name, picked in (("all", list(range(5))), ("two", [1, 3])):
            b, w = plain_ridge(x[mine][:, picked], y[mine])
            whole = np.zeros(5)
            whole[picked] = w
            assert got[g, name].intercept == pytest.approx(b, rel=1e-6) and got[g, name].weights == pytest.approx(whole.tolist(), rel=1e-6, abs=1e-9)


def test_ablation_is_separate_fits(spark):
    x, y = made_panel(300)
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(*map(float, r), float(t), k) for k, (r, t) in enumerate(zip(x, y, strict=True))], ", ".join(f"{c} double" for c in names) + ", y double, k int")
    families = [("one", names[:2]), ("two", [names[0], names[2]]), ("three", names[3:])]
    got = {r.stage: r for r in walk_forward.ablation(df.where("k < 200"), df.where("k >= 200"), families, "y").collect()}
    for stage, size in (("one", 2), ("two", 3), ("three", 5)):
        b, w = plain_ridge(x[:200, :size], y[:200])
        guess = b + x[200:, :size] @ w
        assert (got[stage].n_features, got[stage].n) == (size, 100)
        assert got[stage].rmse == pytest.approx(np.sqrt(np.mean((guess - y[200:]) ** 2))) and got[stage]["corr"] == pytest.approx(np.corrcoef(guess, y[200:])[0, 1])


def test_folds_learn_from_their_own_past(spark):
    """A later day's rows change neither a fold's scores nor its report."""
    g = np.random.default_rng(5)
    rows = []
    for day in range(9):
        for bar in range(6):
            for t in ("A", "B", "C"):
                v = float(g.normal())
                rows.append((t, datetime(2024, 1, 1, 10) + timedelta(days=day, hours=bar), 10.0, 10.0 + v / 10, v + float(g.normal()), float(g.normal()), int(v > 0)))
    schema = "ticker string, ts timestamp_ntz, close double, next_close double, f0 double, f1 double, label int"
    df = spark.createDataFrame(rows, schema)
    folds = splits.walk_forward_folds(df, 3, 1, 1, 2)
    reports = walk_forward.fold_reports(walk_forward.fold_scores(df, folds, ["f0", "f1"], embargo=1)).orderBy("fold").collect()
    assert [r.fold for r in reports] == [0, 1, 2] and all(r.test_rows == 18 and r.auc > 0.6 for r in reports)
    last_day = datetime(2024, 1, 6)
    changed = spark.createDataFrame([(*r[:4], r[4] if r[1] < last_day else 9.0, r[5], r[6]) for r in rows], schema)
    again = walk_forward.fold_reports(walk_forward.fold_scores(changed, folds, ["f0", "f1"], embargo=1)).where("fold = 0").first()
    assert again == reports[0]
    whole = walk_forward.evaluation_summary(spark.createDataFrame(reports)).first()
    assert whole.fold_count == 3 and whole.auc_mean == pytest.approx(np.mean([r.auc for r in reports])) and whole.sharpe_mean == pytest.approx(np.mean([r.sharpe for r in reports]))


def test_kmeans_is_lloyds(spark):
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(loc=c, size=(40, 3)) for c in (-2, 0, 3)])
    rows = [(OPEN + timedelta(minutes=i), *map(float, v), float(v[1])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, z_return double, z_vol double, z_lag double, vol double")
    order = np.argsort(x[:, 1], kind="stable")
    state = np.empty(120, int)
    state[order] = np.minimum(np.arange(120) * 3 // 120, 2)
    for _ in range(21):
        centres = np.array([x[state == k].mean(axis=0) for k in range(3)])
        state = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    got = [r.state for r in regimes.kmeans_states(df).orderBy("ts").collect()]
    assert got == state.tolist()


def test_bootstrap_counts_are_poisson(spark):
    drawn = stats._drawn(spark.range(4000).select(F.col("id").alias("t"), (F.col("id") % 50).alias("rep")))
    found = {r.c: r["count"] / 4000 for r in drawn.groupBy("c").count().collect()}
    assert all(abs(found.get(k, 0) - p) < 0.03 for k, p in enumerate((0.368, 0.368, 0.184, 0.061)))
    series = spark.createDataFrame([("s", t, 0.001 + 0.01 * float(v)) for t, v in enumerate(np.random.default_rng(1).normal(size=500))], "strategy string, t long, ret double")
    sums = stats.resampled(series, 300).collect()
    spread = np.std([r.s1 / r.n for r in sums])
    assert len(sums) == 300 and spread == pytest.approx(0.01 / np.sqrt(500), rel=0.25)


def test_normal_distribution_function(spark):
    from statistics import NormalDist

    points = [-4.0, -1.5, -0.1, 0.0, 0.1, 1.0, 3.0]
    got = [r.v for r in spark.createDataFrame([(x,) for x in points], "x double").select(stats.normal_cdf(F.col("x")).alias("v")).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in points], abs=1e-7)


def test_ticker_subset_hangs_on_names_alone(spark):
    rows = [(f"T{i % 20}", i) for i in range(200)]
    picked = [sorted({r.ticker for r in sequences.ticker_subset(spark.createDataFrame(some, "ticker string, k int").repartition(n), 5, 42).collect()}) for some, n in ((rows, 2), (rows[::-1], 7))]
    assert picked[0] == picked[1] and len(picked[0]) == 5
    assert sequences.ticker_subset(spark.createDataFrame(rows, "ticker string, k int"), 0).count() == 200
    assert picked[0] != sorted({r.ticker for r in sequences.ticker_subset(spark.createDataFrame(rows, "ticker string, k int"), 5, 43).collect()})


def test_events_of_a_hot_day_find_their_bars(spark):
    """Thousands of events on one day, events before the first bar, on days without bars, and after the last one."""
    days = [datetime(2024, 1, d, 10) for d in (2, 3, 8)]
    stamps = [d + timedelta(minutes=30 * k) for d in days for k in range(5)]
    bars = spark.createDataFrame([("A", t) for t in stamps], "ticker string, ts timestamp_ntz")
    r = random.Random(2)
    times = [datetime(2024, 1, 3) + timedelta(seconds=r.randrange(86400)) for _ in range(3000)]
    times += [datetime(2023, 12, 20, 12), datetime(2024, 1, 5, 11), datetime(2024, 1, 8, 12, 1), datetime(2024, 1, 9, 1), datetime(2024, 1, 1, 17)]
    events = spark.createDataFrame([(i, "A", t) for i, t in enumerate(times)], "event_id long, ticker string, event_ts timestamp_ntz")
    got = {e.event_id: e.bar_ts for e in calendar.snap_events(events, bars).collect()}
    for i, t in enumerate(times):
        second = t.hour * 3600 + t.minute * 60 + t.second
        day = datetime(t.year, t.month, t.day)
        at = day + timedelta(hours=9, minutes=30) if second < 34200 else day + timedelta(days=1, hours=9, minutes=30) if second >= 57600 else t
        assert got.get(i) == min((s for s in stamps if s >= at), default=None)
    free = {e.event_id: e.bar_ts for e in calendar.snap_events(events, bars, session=False).collect()}
    assert all(free.get(i) == min((s for s in stamps if s >= t), default=None) for i, t in enumerate(times))


def test_later_rows_of_a_file_win_in_any_split(spark, tmp_path):
    (tmp_path / "map.csv").write_text("ticker,sector\n" + "".join(f"T{i % 50},S{i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("700", "5000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = {r.ticker: r.sector for r in reference_data.sector_map(reference_data.read_table(spark, f"file://{tmp_path}/map.csv")).collect()}
            assert got == {f"T{i}": f"S{3950 + i}" for i in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = reference_data.sector_map(spark.createDataFrame([("A", "x"), ("A", "y")], "ticker string, sector string").coalesce(1)).first()
    assert plain.sector == "y"


def test_benchmark_file_is_found_by_name(spark, tmp_path):
    head = "<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\n"
    for folder, name, price in (("nyse etfs", "spy.us.txt", 5), ("a stocks", "SPY.txt", 7), ("nyse etfs", "spyx.us.txt", 9)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(head + f"20240103,150000,{price},{price},{price},{price},10\n20240103,030000,{price},{price},{price},{price},10\n20240103,151000,{price},1,{price},{price},10\n")
    root = f"file://{tmp_path}"
    assert source.benchmark_path(spark, root, "Spy").endswith("a%20stocks/SPY.txt") or source.benchmark_path(spark, root, "Spy").endswith("a stocks/SPY.txt")
    rows = source.benchmark_bars(spark, root, "spyx").collect()
    assert [(r.ticker, r.ts, r.close) for r in rows] == [("SPYX", datetime(2024, 1, 3, 10), 9.0)]
    assert source.benchmark_path(spark, root, "QQQ") is None and source.benchmark_bars(spark, root, "QQQ").collect() == []


def test_dataset_info_is_observed(spark, tmp_path):
    rows = [(t, OPEN + timedelta(minutes=5 * k), float(k) if k % 7 else None, 1.0, 2.0, 1) for t in ("A", "B") for k in range(40)]
    df = splits.split_global_time(spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, f double, close double, next_close double, label int"))
    info = sinks.write_assembled(df, f"file://{tmp_path}/set", ["f"])
    want = {r.split: r.asDict() for r in splits.dataset_info(splits.assembled(df, ["f"])).collect()}
    assert {s: p["n"] for s, p in info["splits"].items()} == {s: w["n"] for s, w in want.items()}
    for s, part in info["splits"].items():
        assert (part["tickers"], part["stamps"]) == (want[s]["tickers"], want[s]["stamps"]) and part["first_ts"] == str(want[s]["first_ts"])
    assert info["left_out"] == 80 - sum(w["n"] for w in want.values()) and info["features"] == ["f"]
    assert info["overlap"] == {"train_val": 0, "train_test": 0, "val_test": 0, "ordered": True}
    assert json.loads(spark.read.json(f"file://{tmp_path}/set/info").first().info) == info
    assert spark.read.parquet(f"file://{tmp_path}/set/rows").count() == sum(w["n"] for w in want.values())


def test_settled_tables_are_cut_and_cleaned_up(spark):
    df = staging.settled(spark.range(5).withColumn("k", F.col("id") * 2))
    assert sorted(r.k for r in df.collect()) == [0, 2, 4, 6, 8] and "Range" not in df._jdf.queryExecution().toString()
    staging.clean_up(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        df.collect()


def test_losses_mask_null_targets(spark):
    from barloom.operators import losses

    schema = "ts timestamp_ntz, ticker string, p double, mu double, log_scale double, p_event double, p_direction double, p3 array<double>, label int, ret double, event_label int, event_magnitude double, threshold_label int"
    t = [OPEN + timedelta(minutes=5 * k) for k in range(3)]
    full = [(t[0], "A", 0.8, 0.2, 0.0, 0.7, 0.6, [0.1, 0.2, 0.7], 1, 0.5, 1, 5.0, 2), (t[1], "A", 0.4, -1.5, 0.0, 0.2, 0.5, [0.5, 0.3, 0.2], 0, -2.0, 0, None, None)]
    masked = (t[2], "B", 0.9, 9.0, 0.0, 0.9, 0.9, [0.3, 0.3, 0.4], None, None, None, None, None)
    row = losses.multitask_loss(spark.createDataFrame(full, schema)).first()
    ln = np.log
    assert row.direction_loss == pytest.approx((-ln(0.8) - ln(0.6)) / 2)
    assert row.event_loss == pytest.approx((-ln(0.7) * 0.3**2 * 2 - ln(0.8) * 0.2**2) / 2)
    assert row.event_direction_loss == pytest.approx(-ln(0.6) * 2)
    assert row.regression_loss == pytest.approx((0.3**2 / 2 + 0.5**2 / 2) / 2)
    assert row.threshold_loss == pytest.approx((-ln(0.7) - ln(0.5)) / 2)  # the second return lies below the neutral band
    more = losses.multitask_loss(spark.createDataFrame([*full, masked], schema)).first()
    for name in ("direction", "event", "event_direction", "regression", "score_alignment", "threshold", "calibration", "rank", "smoothness"):
        assert more[f"{name}_loss"] == pytest.approx(row[f"{name}_loss"]), name
    assert more.volatility_loss > row.volatility_loss
    none = losses.multitask_loss(spark.createDataFrame([], schema)).first()
    assert none.total == 0.0


def test_contaminated_splits_and_feature_columns(spark):
    rows = [("A", OPEN, "train", 1.0), ("B", OPEN, "test", 2.0), ("A", OPEN + timedelta(minutes=5), "train", 3.0), ("B", OPEN + timedelta(minutes=10), "val", 4.0)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, split string, z_feature double").withColumn("a_feature", F.lit(1)).withColumn("close", F.lit(2.0)).withColumn("note", F.lit("x"))
    assert {r.split: (r.n, r.shared, r.risky) for r in splits.contamination(df).collect()} == {"train": (2, 1, True), "test": (1, 1, True), "val": (1, 0, False)}
    assert splits.feature_columns(df) == ["a_feature", "z_feature"]
