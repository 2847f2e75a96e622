import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.ranks import last_bar_rank
from barloom.operators.stats import cluster_bootstrap, exact_quantiles, group_metrics
from barloom.plans.context import as_of_join


def test_exact_quantiles_with_hot_group_and_ties(spark):
    rng = np.random.default_rng(5)
    pdf = pd.concat([
        pd.DataFrame({"g": "HOT", "x": np.round(rng.normal(0, 50, 5_000), 1)}), pd.DataFrame({"g": "B", "x": [1.0, 2.0, 4.0]}),
        pd.DataFrame({"g": "C", "x": [7.0] * 50}), pd.DataFrame({"g": "D", "x": [-3.5]}),
    ])
    qs = {"a": 0.05, "b": 0.25, "c": 0.5, "d": 0.9}
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", qs).toPandas().set_index("g")
    for g, p in pdf.groupby("g"):
        for n, q in qs.items():
            assert got.loc[g, n] == pytest.approx(p.x.quantile(q), abs=1e-9)


def test_group_metrics(spark):
    pdf = pd.DataFrame({"g": ["x"] * 6, "ticker": list("aaabbc"), "v": [1.0, -2.0, 3.0, 4.0, 5.0, -6.0]})
    m = group_metrics(spark.createDataFrame(pdf), ["g"], "v", 5).first()
    assert m.event_count == 6 and m.unique_tickers == 3 and m.sample_status == "sufficient_sample"
    assert m.mean_net_return_pct == pytest.approx(pdf.v.mean()) and m.standard_deviation_pct == pytest.approx(pdf.v.std(ddof=0))
    assert m.median_net_return_pct == pytest.approx(pdf.v.median()) and m.positive_return_rate_pct == pytest.approx(4 / 6 * 100)
    means = pdf.groupby("ticker").v.mean()
    assert m.mean_ticker_event_return_pct == pytest.approx(means.mean()) and m.median_ticker_event_return_pct == pytest.approx(means.median())


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "cluster": [f"t{i}" for i in range(40)], "s": rng.normal(10, 3, 40), "n": 1}))
    a = cluster_bootstrap(df, ["g"], "s", "n", 400, 7).first()
    b = cluster_bootstrap(df, ["g"], "s", "n", 400, 7).first()
    assert (a.ci_low, a.ci_high) == (b.ci_low, b.ci_high)
    assert a.ci_low < a.estimate < a.ci_high and a.clusters == 40 and a.replicates == 400


def test_percent_rank_matches_pandas(spark):
    pdf = pd.DataFrame({"t": ["a"] * 7, "pos": range(7), "x": [3.0, 1.0, None, 3.0, 5.0, 2.0, 3.0]})
    df = spark.createDataFrame([("a", i, None if pd.isna(x) else x) for i, x in enumerate(pdf.x)], "t string, pos int, x double")
    got = last_bar_rank(df, ["t"], "x").first().x_rank
    assert got == pytest.approx(pdf.x.rank(pct=True).iloc[-1])


def test_as_of_join_matches_merge_asof(spark):
    rng = np.random.default_rng(3)
    t0 = pd.Timestamp("2020-01-01")
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 200, p=[0.9, 0.1]), "ts": t0 + pd.to_timedelta(np.sort(rng.choice(40_000, 200, replace=False)), "min"), "v": np.arange(200)})
    left = pd.DataFrame({"k": rng.choice(["a", "b", "z"], 300), "ts": t0 + pd.to_timedelta(rng.integers(0, 45_000, 300), "min"), "id": np.arange(300)})
    got = as_of_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], ["v"], bucket_seconds=86_400).toPandas().sort_values("id")
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="k").sort_values("id")
    assert got.v.astype(float).fillna(-1).tolist() == want.v.astype(float).fillna(-1).tolist()


def test_lift_bootstrap_shares_its_draws(spark):
    """Against a plain resampling; clusters of one side only count in the estimate, not in the interval."""
    import hashlib

    import numpy as np

    from barloom.operators.stats import lift_bootstrap

    rows = [("g", f"t{i:02d}", float(i % 4), i % 3 + 1, float(i % 5) / 2, i % 2 + 1) for i in range(17)] + [("g", "only", 9.0, 3, None, None), ("h", "x", 1.0, 1, None, None)]
    df = spark.createDataFrame(rows, "g string, cluster string, sum double, n int, other_sum double, other_n int")
    got = {r.g: r for r in lift_bootstrap(df, ["g"], 300, 11).collect()}
    both = [r[2:] for r in rows if r[0] == "g" and r[5]]

    def word(rep, k):
        return int(hashlib.md5(f"11:{rep}:{k // 4}".encode()).hexdigest()[8 * (k % 4):8 * (k % 4) + 8], 16)

    lifts = []
    for rep in range(300):
        s, n, os, on = np.sum([both[word(rep, k) % len(both)] for k in range(len(both))], axis=0)
        lifts.append((s / n - os / on) * 100)
    all_of = lambda a, b: sum(r[a] or 0 for r in rows if r[0] == "g") / sum(r[b] or 0 for r in rows if r[0] == "g")
    assert abs(got["g"].lift - (all_of(2, 3) - all_of(4, 5)) * 100) < 1e-9 and got["g"].common_clusters == 17 and got["g"].replicates == 300
    assert abs(got["g"].ci_low - np.percentile(lifts, 2.5)) < 1e-9 and abs(got["g"].ci_high - np.percentile(lifts, 97.5)) < 1e-9
    assert got["h"].lift is None and got["h"].ci_low is None and got["h"].common_clusters == 0
