import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from barloom.config import IntradayWeights, LongWeights, ShortWeights, max_possible, weights_from
from barloom.functions.numbers import clean_flag, clean_number, clean_symbol, half_even, similarity
from barloom.operators import quality as q
from barloom.operators.scores import add_intraday_score, add_long_score, add_short_score

GOOD = dict(open=10.0, high=11.0, low=9.0, close=10.5, volume=5.0)


@pytest.mark.parametrize("change,codes", [
    ({}, ""), ({"close": None}, "missing_or_non_numeric_close"), ({"open": float("nan")}, "missing_or_non_numeric_open"), ({"high": float("inf")}, "non_finite_high"),
    ({"low": 0.0}, "nonpositive_low"), ({"volume": -1.0}, "negative_volume"), ({"high": 8.0}, "high_below_low,high_below_open,high_below_close"),
    ({"low": 10.2}, "low_above_open"), ({"close": 8.5}, "low_above_close"), ({"close": 12.0}, "high_below_close"), ({"volume": 0.0}, ""),
])
def test_reason_codes(spark, change, codes):
    df = spark.createDataFrame([Row(**{**GOOD, **change})], "open double, high double, low double, close double, volume double")
    assert df.select(F.array_join(q.reason_codes(), ",")).first()[0] == codes


def scored(spark, add, **values):
    return add(spark.createDataFrame([Row(**values)])).first()


BASE = dict(close=101.0, ema_20=100.0, ema_50=99.0, volume_ratio=1.3, rsi=50.0, macd=1.0, macd_diff=0.1, macd_signal=0.9)


def test_short_score_boundaries(spark):
    s = scored(spark, add_short_score, **BASE)
    assert s.score == 100 and s.raw_score == 100 and len(s.reasons) == 5
    assert scored(spark, add_short_score, **{**BASE, "rsi": 70.1}).score == 80
    assert scored(spark, add_short_score, **{**BASE, "volume_ratio": 1.29}).score == 80
    assert scored(spark, add_short_score, **{**BASE, "close": 101.5}).score == 85


def test_missing_values_score_nothing(spark):
    df = spark.createDataFrame([(101.0, None, None, None, None, None, None, None)], "close double, ema_20 double, ema_50 double, volume_ratio double, rsi double, macd double, macd_diff double, macd_signal double")
    assert add_short_score(df).first().score == 0


def test_intraday_and_long_tiers(spark):
    i = dict(volume_ratio=1.5, bb_width_rank=0.81, rsi=30.0, macd_diff=0.1, previous_diff=0.0)
    assert scored(spark, add_intraday_score, **i).score == 15 + 20 + 15 + 30
    assert scored(spark, add_intraday_score, **{**i, "rsi": 50.0, "volume_ratio": 2.0}).score == 30 + 20 + 30
    l = dict(close=101.0, ema_50=100.0, rsi=40.0, volume_ratio_8=1.15, macd=1.0, macd_signal=0.5, bb_width_rank=0.2)
    assert scored(spark, add_long_score, **l).score == 100
    assert scored(spark, add_long_score, **{**l, "bb_width_rank": 0.25}).score == 85


def test_weights():
    assert max_possible(IntradayWeights()) == max_possible(ShortWeights()) == max_possible(LongWeights()) == 100
    assert weights_from(ShortWeights, {"rsi_momentum": 5, "other": 1}).rsi_momentum == 5


def test_cleaning_functions(spark):
    df = spark.createDataFrame([("nan",), ("-1",), ("2.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(clean_number(F.col("v"))).collect()] == [None, None, 2.5, None, None]
    flags = spark.createDataFrame([(" YES ",), ("0",), ("maybe",)], "v string")
    assert [r[0] for r in flags.select(clean_flag(F.col("v"))).collect()] == [True, False, None]
    sym = spark.createDataFrame([(" $aapl",), ("a b",), ("BRK.B",)], "v string")
    assert [r[0] for r in sym.select(clean_symbol(F.col("v"))).collect()] == ["AAPL", None, "BRK.B"]
    assert spark.range(1).select(half_even(F.lit(2.5), 0)).first()[0] == 2.0


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [3.0, 2.0, 1.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>, c array<double>, d array<double>")
    row = df.select(similarity(F.col("a"), F.col("b")), similarity(F.col("a"), F.col("c")), similarity(F.col("a"), F.col("d"))).first()
    assert tuple(row) == (100.0, 0.0, 0.0)
