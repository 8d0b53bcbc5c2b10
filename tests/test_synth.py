"""Copula synthesis keeps REAL's marginals, range and rank correlation, and repeats itself."""

import numpy as np
from pyspark.sql import functions as F

from fidelis.operators.synth import copula_synthesize


def test_copula(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=1500)
    b = np.exp(0.8 * a + 0.6 * rng.normal(size=1500))
    real = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "row_id long, a double, b double")
    one = copula_synthesize(spark, real, ["a", "b"], 3000, seed=4).toPandas().sort_values("row_id")
    assert len(one) == 3000 and one.notna().all().all()
    assert one.a.between(a.min(), a.max()).all() and one.b.between(b.min(), b.max()).all()
    for name, x in (("a", a), ("b", b)):
        q = [0.1, 0.25, 0.5, 0.75, 0.9]
        assert np.abs(np.quantile(one[name], q) - np.quantile(x, q)).max() < 0.2 * x.std()
    assert abs(one[["a", "b"]].corr("spearman").iloc[0, 1] - np.corrcoef(a.argsort().argsort(), b.argsort().argsort())[0, 1]) < 0.05
    again = copula_synthesize(spark, real, ["a", "b"], 3000, seed=4).toPandas().sort_values("row_id")
    assert (one.to_numpy() == again.to_numpy()).all()


def _spearman(x, y):
    keep = x.notna() & y.notna()
    return np.corrcoef(x[keep].rank(), y[keep].rank())[0, 1]


def test_copula_over_all_column_types(spark):
    """The registered query's columns: marginals, null patterns, ranges and rank correlations of REAL."""
    from fidelis.plans import QUERIES
    from fidelis.plans.q_latent import _DISCRETE
    from fidelis.sources.panel import VARIABLES, load_panel

    sf = "/root/testdata/sf0.01"
    real = load_panel(spark, sf, extended=True).filter("technique = 'REAL'").toPandas()
    syn = QUERIES["copula_synthesize"](spark, sf).toPandas()
    assert len(syn) == len(real) > 10_000
    for v in VARIABLES:
        q = [0.05, 0.25, 0.5, 0.75, 0.95]
        assert np.abs(syn[v].quantile(q) - real[v].quantile(q)).max() < 0.06 * real[v].std(), v
        assert syn[v].min() >= real[v].min() - 1e-6 and syn[v].max() <= real[v].max() + 1e-6
    for v in _DISCRETE:
        assert (syn[v].value_counts(normalize=True).sub(real[v].value_counts(normalize=True), fill_value=0).abs() < 0.015).all(), v
        assert set(syn[v].dropna()) <= set(real[v].dropna())
    assert abs(syn["a2"].isna().mean() - real["a2"].isna().mean()) < 0.005 and not syn["a1"].isna().any()
    codes = {v: {x: i for i, x in enumerate(sorted(real[v].unique()))} for v in _DISCRETE}
    a, b = (df[[*VARIABLES, *_DISCRETE]].assign(**{v: df[v].map(codes[v]) for v in _DISCRETE}) for df in (real, syn))
    cols = list(a.columns)
    off = [abs(_spearman(a[x], a[y]) - _spearman(b[x], b[y])) for i, x in enumerate(cols) for y in cols[i + 1:]]
    assert max(off) < 0.06 and np.mean(off) < 0.015


def test_nearest_correlation():
    from fidelis.operators.synth import nearest_correlation

    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    assert np.linalg.eigvalsh(bad).min() < 0
    good = nearest_correlation(bad)
    assert np.linalg.eigvalsh(good).min() > 0 and np.allclose(np.diag(good), 1)
    np.linalg.cholesky(good)
    # the nearest one by symmetry: all entries of size one half, by a search over that family
    sizes = np.linspace(0.3, 0.9, 6001)
    ok = [s for s in sizes if np.linalg.eigvalsh(np.sign(bad) * np.where(np.eye(3) > 0, 1, s)).min() >= 0]
    assert abs(abs(good[0, 1]) - max(ok)) < 1e-3
    fine = np.array([[1.0, 0.3], [0.3, 1.0]])
    assert np.allclose(nearest_correlation(fine), fine)


def test_indefinite_input_and_null_patterns(spark):
    """Pairwise-complete correlations of three columns that are never filled together need not be positive definite."""
    from fidelis.operators.synth import copula_fit, copula_sample

    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        x = float(rng.normal())
        y = float(0.1 * rng.normal())
        rows.append((i, *[(x, x + y, None), (x, None, -x + y), (None, x, x + y)][i % 3], ["lo", "hi"][int(x > 0.5)]))
    real = spark.createDataFrame(rows, "row_id long, a double, b double, c double, k string")
    fit = copula_fit(real, ["a", "b", "c"], ["k"])
    assert np.linalg.eigvalsh(fit["corr"]).min() > 0
    one = copula_sample(spark, fit, 3000).toPandas()
    assert one[["a", "b", "c"]].isna().sum(axis=1).eq(1).all() and abs((one.k == "hi").mean() - (np.array([r[4] for r in rows]) == "hi").mean()) < 0.03


def test_latent_simulate_and_condition_seed(spark):
    from pyspark.sql import functions as F

    from fidelis.operators.synth import condition_seed, latent_simulate, uniform

    rng = np.random.default_rng(9)
    n, a, b = 4000, rng.normal(size=4000), rng.normal(size=4000)
    df = spark.createDataFrame([(i * 3, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "row_id long, a double, b double")
    sim = latent_simulate(df, {"a": 0.4, "b": -0.3}, 0.25, "lv").toPandas().sort_values("row_id")
    noise = sim.lv.to_numpy() - (0.4 * a - 0.3 * b)
    assert abs(noise.mean()) < 0.05 and abs(noise.std() - np.sqrt(0.75)) < 0.03 and abs(np.corrcoef(noise, a)[0, 1]) < 0.05
    assert abs(np.mean(np.abs(noise) < np.sqrt(0.75)) - 0.6827) < 0.03  # normal
    drawn = condition_seed(spark, df, "a", 2000, seed=3).toPandas().sort_values("row_id")
    u = spark.range(2000).select("id", uniform(F.col("id"), 0, 3).alias("u")).toPandas().sort_values("id").u.to_numpy()
    assert (drawn.a.to_numpy() == a[np.floor(u * n).astype(int)]).all()  # the row at that place in key order


def test_normal_cdf_of_several_columns(spark):
    """Same doubles as the expression, and nothing of the series is computed once a term."""
    from fidelis.functions.stats import normal_cdf, with_normal_cdf

    x = [-40.0, -5.0, -3.0 * 2 ** 0.5, -1.3, -1e-9, 0.0, 1e-9, 0.7, 2.9, 4.2426406871, 4.25, 6.0, 39.0, float("nan")]
    df = spark.createDataFrame([(i, v, -v) for i, v in enumerate(x)] + [(99, None, 0.5)], "k long, a double, b double")
    staged = with_normal_cdf(df, ["a", "b"], [F.col("k")])
    got, want = staged.orderBy("k").collect(), df.select("k", normal_cdf(F.col("a")).alias("a"), normal_cdf(F.col("b")).alias("b")).orderBy("k").collect()
    for g, w in zip(got, want):
        assert [repr(v) for v in g] == [repr(v) for v in w]
    assert got[5]["a"] == 0.5 and abs(got[7]["a"] - 0.758036347776927) < 1e-14 and got[-1]["a"] is None
    top = staged._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].lower()
    assert "abs(" not in top and "least(" not in top
