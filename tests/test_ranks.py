"""Ranks over the whole past against a plain count, whatever the blocks."""
import numpy as np
import pytest

from barloom.operators.ranks import earlier_smaller, expanding_rank
from barloom.session import settle


def plain(rows):
    """Percent ranks with average ties of (ticker, pos, value) rows."""
    out = {}
    for t, pos, x in rows:
        seen = [v for u, p, v in rows if u == t and p <= pos and v is not None]
        out[t, pos] = None if x is None else (sum(v < x for v in seen) + (sum(v == x for v in seen) + 1) / 2) / len(seen)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [("one", p, float(rng.choice([0.0, 1.5, -2.0, float(rng.normal())]))) for p in range(300)]
    out += [("few", p, v) for p, v in enumerate([None, None, 3.0, 3.0, None, -1.0, -0.0, 0.0])]
    out += [("flat", p, 0.0) for p in range(60)] + [("falling", p, float(-p)) for p in range(60)] + [("none", p, None) for p in range(3)]
    return out


@pytest.mark.parametrize("block", [4, 7, 64, 65_536])
def test_expanding_rank_is_the_same_for_all_blocks(spark, rows, block):
    df = settle(spark.createDataFrame(rows, "ticker string, pos bigint, x double").repartition(5))
    got = {(r.ticker, r.pos): r.x_rank for r in expanding_rank(df, ["ticker"], "x", block).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)


def test_expanding_rank_of_an_empty_table(spark):
    df = settle(spark.createDataFrame([], "ticker string, pos bigint, x double"))
    assert expanding_rank(df, ["ticker"], "x").collect() == []


def test_earlier_smaller_against_pairs():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 9, 200):
        order, value, weight = rng.integers(0, max(1, n // 2), n), rng.integers(-3, 4, n).astype(float), rng.integers(1, 5, n)
        below, same, seen = earlier_smaller(order, value, weight, extra=True)
        earlier = order[None, :] < order[:, None]
        assert (below == ((value[None, :] < value[:, None]) & earlier) @ weight).all()
        assert (same == ((value[None, :] == value[:, None]) & earlier) @ weight).all()
        assert (seen == earlier @ weight).all()
