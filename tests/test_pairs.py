"""Exact quantiles of all pair distances, and the membership proxy, against numpy on every pair."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fidelis.operators import pairs
from fidelis.operators import privacy as PV
from fidelis.sources.panel import VARIABLES, load_panel

from .conftest import SF_SMALL

DS = ["technique", "replicate"]


def _rows(df, cols):
    return df.select(*cols).dropna().toPandas()


def _all(x, y):
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(-1))


def test_membership_equals_brute_force(spark):
    p = load_panel(spark, SF_SMALL, extended=True, with_row_id=True)
    nn = PV.nn_distances(p, VARIABLES, 1)
    got = {(r.technique, r.replicate): r for r in PV.membership_proxy(p, nn, VARIABLES).collect()}
    all_ = _rows(p, [*DS, *VARIABLES])
    real = all_[all_.technique == "REAL"][VARIABLES].to_numpy()
    sets = {k: g[VARIABLES].to_numpy() for k, g in all_[all_.technique != "REAL"].groupby(DS)}
    assert set(got) == set(sets)
    for k, x in sets.items():
        d = _all(x, real)
        eps = np.percentile(d, 1)
        assert got[k].radius == pytest.approx(eps, rel=1e-12) and got[k].pairs == d.size and got[k].expanded <= d.size
        assert got[k].membership_inference == pytest.approx((d.min(axis=1) < eps).mean(), abs=1e-12)


@pytest.mark.parametrize("share,leaf_rows,block,listed", [(0.01, 4, 40, 10), (0.5, 8, 100, 4096), (0.0, 8, 64, 3), (1.0, 500, 64, 100)])
def test_quantiles_of_small_blocks(spark, monkeypatch, share, leaf_rows, block, listed):
    monkeypatch.setattr(pairs, "LISTED", listed)
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(0, 1, (260, 3)), 1), np.round(rng.normal(0.5, 1, (330, 3)), 1)  # rounded: many equal distances
    y[:120] = y[0]  # a third of all rows in one leaf
    make = lambda m, g: spark.createDataFrame([(g if g else int(i % 2), i, *map(float, r)) for i, r in enumerate(m)], "g int, id long, u double, v double, w double")
    got = pairs.PairDistances(make(x, None), make(y, 9).drop("g"), ["u", "v", "w"], ["g"], "id", leaf_rows, block).quantile(share)
    for r in got:
        d = _all(x[np.arange(260) % 2 == r["g"]], y)
        assert r["value"] == pytest.approx(np.percentile(d, 100 * share), abs=1e-12) and r["pairs"] == d.size


def test_only_straddling_pairs_are_expanded(spark):
    rng = np.random.default_rng(4)
    far = np.concatenate([rng.normal(c, 0.1, (300, 2)) for c in (0, 50, 100)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(far)], "id long, u double, v double").withColumn("g", F.lit(1))
    r = pairs.PairDistances(df, df.drop("g"), ["u", "v"], ["g"], "id", 20).quantile(0.01)[0]
    assert r["expanded"] < 0.3 * r["pairs"]
    assert r["value"] == pytest.approx(np.percentile(_all(far, far), 1), rel=1e-12)


def test_a_row_travels_few_times_and_only_the_last_pass_lists():
    """A node of up to 65,536 rows is one block, and a wide bracket holds no distances."""
    assert pairs.BLOCK >= 65_536
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 2)), rng.normal(size=(20_000, 2))
    a, b = (pd.DataFrame(m, columns=["u", "v"]).assign(_leaf=0) for m in (x, y))
    d = _all(x, y).ravel()
    below, counts, expanded, found = pairs.count_block(a, b, ["u", "v"], ["u", "v"], np.linspace(0.5, 2.0, 4))
    assert below == (d < 0.5).sum() and expanded == d.size and not len(found)
    assert list(counts) == [((d >= lo) & (d < hi)).sum() for lo, hi in ((0.5, 1.0), (1.0, 1.5), (1.5, 2.0))]
    listed = pairs.count_block(a, b, ["u", "v"], ["u", "v"], np.array([0.5, 0.51]))[3]
    np.testing.assert_allclose(np.sort(listed), np.sort(d[(d >= 0.5) & (d < 0.51)]))


def test_few_true_finds_every_position():
    from fidelis.operators.knn import few_true

    rng = np.random.default_rng(5)
    for n, share in ((0, 0.5), (5, 1.0), (64, 0.0), (1000, 0.01), (1003, 0.4), (8191, 0.001)):
        mask = rng.random(n) < share
        assert (few_true(mask) == np.flatnonzero(mask)).all() and len(few_true(mask)) == mask.sum()


def test_a_wide_bracket_needs_one_counting_pass(spark, monkeypatch):
    """Half a million distances in the first bracket: one pass of bins, one that lists; 256 bins took two."""
    monkeypatch.setattr(pairs, "LISTED", 400)
    df = spark.range(3000).select("id", F.rand(1).alias("u"), F.rand(2).alias("v"), F.lit("A").alias("t"))
    p = pairs.PairDistances(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["u", "v"], ["t"], "id")
    found = p.quantile(0.5)[0]
    assert found["passes"] == 2
    x = df.toPandas()
    a, b = x[x.id % 2 == 0][["u", "v"]].to_numpy(), x[x.id % 2 == 1][["u", "v"]].to_numpy()
    assert found["value"] == pytest.approx(np.quantile(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)), 0.5), abs=1e-12)
