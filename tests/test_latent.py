"""Path model, bootstrap and multivariate screens against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fidelis.functions.stats import erfc, two_sided_p
from fidelis.operators import measurement as MS
from fidelis.operators import multivariate as MV

MODEL = {"FA": ["a1", "a2"], "FB": ["b1", "b2"], "FC": ["c1", "c2"]}
PATHS = [("FA", "FC"), ("FB", "FC")]
ITEMS = [i for c in MODEL for i in MODEL[c]]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    frames = []
    for t, r, n in (("REAL", 0, 900), ("S", 1, 400)):
        fa, fb = rng.normal(size=n), rng.normal(size=n)
        fc = 0.6 * fa + 0.3 * fb + rng.normal(size=n) * 0.7
        cols = {k: f + rng.normal(size=n) * 0.4 for k, f in zip(ITEMS, (fa, fa, fb, fb, fc, fc), strict=True)}
        frames.append(pd.DataFrame({"technique": t, "replicate": r, "row_id": np.arange(n), **cols}))
    return pd.concat(frames)


def test_erfc_to_double_precision(spark):
    xs = [-4.0, -1.0, 0.0, 1e-9, 0.5, 2.9, 3.0, 3.1, 6.0, 12.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(x) for x in xs], rel=1e-9)
    p = spark.createDataFrame([(9.0,)], "t double").select(two_sided_p(F.col("t"))).first()[0]
    assert p == pytest.approx(math.erfc(9 / math.sqrt(2)), rel=1e-9)


def test_path_model_and_bootstrap(spark, panel):
    df = spark.createDataFrame(panel)
    fit = MS.pls_fit(df, MODEL, PATHS)
    real = panel[panel.technique == "REAL"]
    blocks, paths = [[0, 1], [2, 3], [4, 5]], [(0, 2), (1, 2)]
    want = MS.pls_solve(np.corrcoef(real[ITEMS].to_numpy().T), blocks, paths, len(real))
    got = {(r.key1, r.key2): r.value for r in MS.sheet(fit, "paths", "beta").filter("technique = 'REAL'").collect()}
    assert got[("FA", "FC")] == pytest.approx(want["B"][0, 2], abs=1e-6)
    boot = MS.bootstrap_fit(df, MODEL, PATHS, draws=40, seed=7)
    rows = {(r.technique, r.draw, r.iv): r.value for r in boot.filter("effect = 'direct'").collect()}
    assert len(rows) == 2 * 40 * 2
    x, ids = real[ITEMS].to_numpy(), real.row_id.to_numpy()
    w = MS.poisson_weights(ids, 40, 7)
    for d in (0, 17, 39):
        r = np.corrcoef(np.repeat(x, w[:, d].astype(int), axis=0).T)
        assert rows[("REAL", d, "FB")] == pytest.approx(MS.pls_solve(r, blocks, paths, len(x))["B"][1, 2], abs=1e-6)
    summary = MS.bootstrap_summary(boot, MS.path_estimates(fit)).filter("technique = 'REAL' AND iv = 'FA' AND effect = 'direct'").first()
    assert summary.boot_sd > 0 and summary.p_value < 1e-6 and summary.ci_95l < summary.estimate < summary.ci_95u
    adjusted = {(r.iv, r.dv): r.value for r in MS.plsc_adjust(fit, PATHS).filter("technique = 'REAL' AND metric = 'beta'").collect()}
    assert adjusted[("FA", "FC")] > got[("FA", "FC")]


def test_constant_item_does_not_end_the_job(spark, panel):
    df = spark.createDataFrame(panel).withColumn("b1", F.when(F.col("technique") == "S", 1.0).otherwise(F.col("b1")))
    fit = MS.pls_fit(df, MODEL, PATHS)
    done = {r.technique: r.value for r in MS.sheet(fit, "fit", "converged").collect()}
    assert done == {"REAL": 1.0, "S": 0.0}
    assert {r.value for r in MS.sheet(fit, "paths", "beta").filter("technique = 'S'").collect()} == {None}


def test_screens_over_many_datasets(spark, panel):
    df = spark.createDataFrame(panel).withColumn("replicate", (F.col("row_id") % 200).cast("int")).filter("technique = 'REAL'")
    by = ["technique", "replicate"]
    big = spark.createDataFrame(panel)
    x = panel[panel.technique == "REAL"][ITEMS].to_numpy()
    inv = np.linalg.inv(np.cov(x.T))
    d = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), inv, x - x.mean(0)))
    got = MV.mahalanobis_outliers(big, ITEMS).filter("technique = 'REAL'").select("row_id", "mahalanobis").toPandas().sort_values("row_id")
    np.testing.assert_allclose(got.mahalanobis, d, rtol=1e-6)
    v = {r.variable: r.vif for r in MV.vif(big, ITEMS).filter("technique = 'REAL'").collect()}
    np.testing.assert_allclose([v[i] for i in ITEMS], np.diag(np.linalg.inv(np.corrcoef(x.T))), rtol=1e-6)
    assert MV.vif(df, ["a1", "b1"], by).select(*by).distinct().count() == 200
    s = MV.pca_scores(big, ITEMS).filter("technique = 'REAL'").select("row_id", "pc1").toPandas().sort_values("row_id").pc1.to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, vec = np.linalg.eigh(np.corrcoef(x.T))
    first = vec[:, -1] * (1 if vec[:, -1].sum() >= 0 else -1)
    np.testing.assert_allclose(s, z @ first, rtol=1e-6, atol=1e-9)


def test_registered_screens_take_all_indicators(spark):
    from fidelis.functions.stats import chi2_quantile_wh
    from fidelis.plans import ORACLES, QUERIES
    from fidelis.sources.panel import VARIABLES, load_panel
    from tests.conftest import SF_SMALL

    rows = load_panel(spark, SF_SMALL).toPandas()
    vif = {(r.technique, r.replicate, r.variable): r.vif for r in QUERIES["vif"](spark, SF_SMALL).collect()}
    maha = {(r.technique, r.replicate): r for r in QUERIES["mahalanobis_outliers"](spark, SF_SMALL).collect()}
    groups = list(rows.groupby(["technique", "replicate"]))
    assert len(vif) == len(groups) * len(VARIABLES) and len(maha) == len(groups)
    for key, g in groups:
        x = g[VARIABLES].to_numpy(float)
        want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
        np.testing.assert_allclose([vif[(*key, v)] for v in VARIABLES], want, rtol=1e-4)
        d = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(np.cov(x.T)), x - x.mean(0)))
        r = maha[key]
        assert (r.n_rows, r.n_kept) == (len(x), (d < np.sqrt(chi2_quantile_wh(0.999, len(VARIABLES)))).sum())
        np.testing.assert_allclose([r.mean_distance, r.max_distance], [d.mean(), d.max()], rtol=1e-4)
    assert {"vif_three", "mahalanobis_three"} <= ORACLES.keys()


def test_imputation_of_all_columns_returns_rows(spark):
    from fidelis.plans import QUERIES
    from fidelis.sources.panel import VARIABLES, load_panel
    from tests.conftest import SF_SMALL

    rows = load_panel(spark, SF_SMALL, with_row_id=True).toPandas()
    syn = rows[rows.technique != "REAL"].set_index("row_id")[VARIABLES].sort_index()
    got = QUERIES["impute_zero_variance"](spark, SF_SMALL).toPandas().set_index("row_id").sort_index()
    assert len(got) == len(syn) and (got.index == syn.index).all()
    rest = [v for v in VARIABLES if v != "b1"]
    np.testing.assert_allclose(got[rest], syn[rest], atol=1e-6)
    real = rows[rows.technique == "REAL"].b1.to_numpy()
    assert all(np.abs(real - x).min() < 1e-6 for x in got.b1) and got.b1.std() > 0.1


def test_sheets_with_one_source_are_dropped(spark):
    from fidelis.operators import report as RP
    from fidelis.plans import QUERIES
    from tests.conftest import SF_SMALL

    est = spark.createDataFrame([
        ("REAL", 0, "x", "a", None, 1.0), ("S", 1, "x", "a", None, 2.0), ("S", 2, "x", "a", None, 4.0),
        ("REAL", 0, "y", "a", "b", 1.0), ("S", 1, "y", "a", "b", 2.0)], "technique string, replicate int, sheet string, key1 string, key2 string, value double")
    got = RP.compare_sheets(est, ["sheet", "key1", "key2"], "value", sheet=["sheet"]).collect()
    assert list(map(tuple, got)) == [("x", "a", None, "S", 1.0, 3.0, 2.0, 4.0)]
    assert RP.compare_sheets(est.filter("sheet = 'y'"), ["key1", "key2"], "value").collect() == []
    seen = {r[0] for r in QUERIES["compare_sheets"](spark, SF_SMALL).select("sheet").distinct().collect()}
    assert {"paths", "loadings", "reliability", "rsquared", "construct_corr"} <= seen
    assert {r[0] for r in QUERIES["multi_run_summary"](spark, SF_SMALL).select("sheet").distinct().collect()} >= seen


def test_reports_hold_all_their_metrics(spark):
    from fidelis.plans import QUERIES
    from tests.conftest import SF_SMALL

    def rows(name):
        return QUERIES[name](spark, SF_SMALL).toPandas()

    four = {"alpha", "rhoC", "rhoA", "AVE"}
    for name in ("reliability_thresholds", "reliability_mad", "reliability_stability"):
        got, alpha = rows(name), rows(f"{name}_alpha")
        assert set(got.metric) == four and len(got) == 4 * len(alpha)
    grid, ht = rows("grid_rmse"), rows("grid_rmse_htmt")
    assert set(grid.grid) == {"htmt", "fornell_larcker"} and set(grid[grid.grid == "fornell_larcker"].cells) == {6}
    assert sorted(grid[grid.grid == "htmt"].rmse) == sorted(ht.rmse)
    dep, matrix = rows("dependency_metrics").set_index("technique"), rows("dependency_metrics_matrix").set_index("technique")
    spec = rows("eigen_spectrum")
    want = spec[spec.technique != "REAL"].groupby("technique")[["eig_l2", "eig_cosine"]].mean()
    np.testing.assert_allclose(dep.loc[want.index, ["eig_l2", "eig_cosine"]], want, atol=2e-6)
    np.testing.assert_allclose(dep.loc[matrix.index, matrix.columns], matrix, atol=2e-6)


@pytest.mark.parametrize("call", [MV.mahalanobis_outliers, MV.pca_scores])
def test_rows_are_not_shuffled_by_dataset(spark, call):
    rows = [("REAL" if i % 2 else "S", 0, *(float(i * k % 11) for k in range(1, 1 + len(ITEMS)))) for i in range(60)]
    df = spark.createDataFrame(rows, ["technique", "replicate", *ITEMS])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in call(df, ITEMS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_weights_take_no_new_memory_per_block(spark):
    """The weights of a block are those of the plain formula, written into arrays that are kept (F14, F15, F17, F18, F20, F31)."""
    def plain(ids, draws, seed, first):
        with np.errstate(over="ignore"):
            x = ids.astype(np.uint64)[:, None] * np.uint64(0x100000001B3) + np.arange(first, first + draws, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B1)
            x = x + np.uint64(seed) + np.uint64(0x9E3779B97F4A7C15)
            z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(2 ** 53)
        return np.searchsorted(np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(20)]), u, side="right")

    rng = np.random.default_rng(8)
    kept = MS.PoissonWeights(700, 250)
    seen = None
    for size, first in ((700, 0), (700, 250), (31, 1750)):
        ids = rng.integers(-5, 2 ** 45, size)
        got = kept.block(ids, 250, 123, first)
        np.testing.assert_array_equal(got, plain(ids, 250, 123, first).T)
        np.testing.assert_array_equal(got.T, MS.poisson_weights(ids, 250, 123, first))
        assert seen is None or np.shares_memory(seen, got)
        seen = got


def test_estimates_pass_over_the_rows_once(spark, monkeypatch):
    """Direct and total estimates come from one written fit, not from one fit each."""
    from fidelis.plans import q_latent as QL

    monkeypatch.setattr(QL, "DRAWS", 3)
    boot, est = QL.boot_med(spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in est._jdf.queryExecution().executedPlan().toString()
    assert {r.effect for r in est.collect()} == {"direct", "total"} and boot.count() > 0
