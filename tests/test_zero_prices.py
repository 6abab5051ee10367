"""Queries over events whose values are 0 or less, as sf0.1 has and sf0.01 doesn't, against their SQL."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import ln
from barloom.operators import features, quality
from barloom.plans import catalogue, oracles


def exact(names: list[str], rows: list[tuple]) -> list[dict]:
    """Cells as text, so that infinities, NaN and nulls are told apart; doubles to 9 digits."""
    told = [{n: f"{v:.9g}" if isinstance(v, float) else str(v) for n, v in zip(names, row, strict=True)} for row in rows]
    return sorted(told, key=lambda x: sorted(x.items()))


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """60 hours of four tickers: a low of 0, a bar of 0 alone, an open of 0 or a value below 0 in three of them; `error` has none."""
    r = random.Random(3)
    rows = [[t, h, m, round(r.uniform(1, 90), 2)] for t in ("click", "view", "signup", "error") for h in range(60) for m in (5, 25, 45)]
    for row in rows:
        match row[:3]:
            case ["click", 30, 25] | ["view", 33, _] | ["signup", 28, 5]:
                row[3] = 0.0
            case ["signup", 57, 25]:
                row[3] = -2.0
    start = datetime(2024, 1, 1)
    pdf = pd.DataFrame([(i, start + timedelta(hours=h, minutes=m), t, v) for i, (t, h, m, v) in enumerate(rows)], columns=["event_id", "ts", "event_type", "value"])
    folder = tmp_path_factory.mktemp("made")
    pdf.astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
    return str(folder)


def both(spark, folder: str, name: str) -> tuple[list[dict], list[dict]]:
    """The query's rows and those of its SQL."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    got, wanted = catalogue.QUERIES[name](spark, folder), con.execute(oracles.ORACLE_SQL[name])
    return exact(got.columns, got.collect()), exact([c[0] for c in wanted.description], wanted.fetchall())


def test_realized_volatility_of_zero_prices(spark, made):
    got, wanted = both(spark, made, "realized_volatility")
    assert len(got) == 240 and {"inf", "nan"} <= {r["rv_parkinson"] for r in got} & {r["rv_garman_klass"] for r in got}
    assert got == wanted


def test_volatility_with_a_floor_stays_finite(spark, made):
    df = features.volatility_features(catalogue.sequences_h(spark, made)).where("ticker <> 'error'")
    assert df.where(" or ".join(f"{c} is null or isnan({c}) or {c} = double('inf')" for c in features.VOLATILITY)).count() == 0


def test_logarithms_of_no_positive_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, -0.0, -3.0, math.nan, math.inf, None, 1.0)], "v double")
    assert [str(r[0]) for r in df.select(F.round(ln("v"), 6)).collect()] == ["-inf", "-inf", "nan", "nan", "inf", "None", "0.0"]


def test_valid_tickers_beside_zero_prices(spark, made):
    got, wanted = both(spark, made, "valid_tickers")
    assert got == wanted == [{"ticker": t, "n": "60"} for t in ("click", "signup", "view")]


def test_valid_tickers_of_odd_events(spark, tmp_path):
    """Two bars of `error`, bars without a ticker or a value, an infinite one."""
    rows = [("error", 1, 5.0), ("error", 2, 6.0), (None, 1, 5.0), (None, 2, 0.0), ("view", 1, None), ("view", 2, 4.0), ("click", 1, math.inf), ("signup", 7, -0.5)]
    pdf = pd.DataFrame([(i, datetime(2024, 1, 1, h), t, v) for i, (t, h, v) in enumerate(rows)], columns=["event_id", "ts", "event_type", "value"])
    pdf.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got, wanted = both(spark, str(tmp_path), "valid_tickers")
    assert got == wanted == [{"ticker": t, "n": n} for t, n in (("click", "1"), ("signup", "1"), ("view", "2"))]


def test_a_price_of_zero_drops_its_ticker(spark, made):
    """The operator mends nothing."""
    bars = catalogue.bars_h(spark, made).withColumn("row_no", F.unix_timestamp(F.col("ts").cast("timestamp")))
    assert {r.ticker for r in quality.valid_tickers(bars).select("ticker").distinct().collect()} == {"error"}


def test_warm_rows_sum_zero_prices(spark, made):
    got, wanted = both(spark, made, "warmup_rows")
    assert {r["ticker"]: r["rv"] for r in got if r["ticker"] != "error"} == {"click": "inf", "view": "nan", "signup": "nan"}
    assert got == wanted
