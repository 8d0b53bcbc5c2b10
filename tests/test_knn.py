"""Exact grid kNN against numpy brute force on a small fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators.knn import _Best, _meet, knn, knn_compared
from fidelis.operators.knn_approx import PairBudgetExceeded, knn_approx
from fidelis.operators.privacy import dcr
from fidelis.sources.panel import VARIABLES, load_panel

from .conftest import SF_SMALL

FEATS = [v for v in VARIABLES if v != "a2"]


def _brute(q, r, k):
    d = np.sqrt(((q[:, None, :] - r[None, :, :]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("leaf_rows,k", [(4, 1), (2, 5), (100000, 3)])
def test_knn_matches_brute_force(spark, leaf_rows, k):
    p = load_panel(spark, SF_SMALL, extended=True, with_row_id=True)
    real = p.filter("technique = 'REAL'")
    syn = p.filter("technique = 'SYN_NOISY'")
    res = knn(syn, real, FEATS, k, query_id="row_id", ref_id="row_id", carry=["technique", "replicate"],
              leaf_rows=leaf_rows).toPandas()
    rp = real.select("row_id", *FEATS).toPandas().sort_values("row_id")
    sp = syn.select("row_id", *FEATS).toPandas().sort_values("row_id")
    want = _brute(sp[FEATS].to_numpy(), rp[FEATS].to_numpy(), k)
    got = res.pivot(index="row_id", columns="rank", values="dist").sort_index().to_numpy()
    assert got.shape == want.shape
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-12)


def test_exact_copies_have_zero_distance(spark):
    p = load_panel(spark, SF_SMALL, extended=True, with_row_id=True)
    real = p.filter("technique = 'REAL'")
    copies = p.filter("technique = 'SYN_COPY'")
    res = knn(copies, real, FEATS, 1, query_id="row_id", ref_id="row_id", leaf_rows=4)
    assert res.agg(F.max("dist")).first()[0] == 0.0
    # the nearest REAL row of a copy is its source row
    assert res.filter(F.col("row_id") != F.col("ref_id")).count() == 0


def test_keys_ties_and_a_hot_cell(spark):
    """A third of all rows equal; references of the query's own key only; fewer than k references."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(900, 2)), 1)
    x[:300] = x[0]
    rows = [(int(i % 3 if i < 890 else 9), i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, id long, u double, v double")
    got = {}
    for r in knn(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["u", "v"], 8, query_id="id", ref_id="id", keys=["g"], leaf_rows=6).collect():
        got.setdefault((r.g, r.id), []).append((r["rank"], r.dist, r.ref_id))
    for g, i, *v in rows[::2]:
        d = sorted((float(np.sqrt(((np.array(w) - v) ** 2).sum())), j) for h, j, *w in rows[1::2] if h == g)[:8]
        assert [(round(a, 12), j) for _, a, j in sorted(got[g, i])] == [(round(a, 12), j) for a, j in d], (g, i)


def test_few_rows_are_compared(spark):
    p = load_panel(spark, SF_SMALL, extended=True, with_row_id=True)
    real, syn = p.filter("technique = 'REAL'"), p.filter("technique = 'SYN_SAME'")
    done = knn_compared(syn, real, FEATS, 1, query_id="row_id", ref_id="row_id", leaf_rows=8).toPandas()
    assert (done.compared >= 1).all() and (done.compared / done.ref_rows).mean() < 0.25


def test_approximate_search(spark):
    p = load_panel(spark, SF_SMALL, extended=True, with_row_id=True)
    real, syn = p.filter("technique = 'REAL'"), p.filter("technique <> 'REAL'")
    args = dict(query_id="row_id", ref_id="row_id", carry=["technique"])
    n = real.dropna(subset=FEATS).count() * syn.dropna(subset=FEATS).count()
    near = knn_approx(syn, real, FEATS, 1, pair_budget=0.3 * n, **args).toPandas()
    exact = knn(syn, real, FEATS, 1, **args).toPandas()
    both = exact.merge(near, on=["technique", "row_id"], how="left")
    assert (both.dist_y.dropna() >= both.dist_x[both.dist_y.notna()] - 1e-12).all()
    assert (both.ref_id_x == both.ref_id_y).mean() >= 0.9 and (near.groupby("technique").recall.first() >= 0.85).all()
    with pytest.raises(PairBudgetExceeded):
        knn_approx(syn, real, FEATS, 1, pair_budget=100, **args)


def _bytes_below(folder):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder.removeprefix("file:")) for f in files)


def test_query_rows_are_not_sent_to_every_cell_they_reach(spark):
    """Ten features without structure: a row's ball reaches most cells, and still neither side is written or shuffled more than a few times."""
    from fidelis.session import checkpoint_dir

    x = [f"x{i}" for i in range(10)]
    rows = spark.range(6000).select("id", *[F.rand(i).alias(c) for i, c in enumerate(x)])
    q, r = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    before = _bytes_below(checkpoint_dir(spark))
    found = knn(q, r, x, 1, query_id="id", ref_id="id", leaf_rows=4)
    assert found.count() == 3000
    assert _bytes_below(checkpoint_dir(spark)) - before < 6 * 6000 * 8 * len(x)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "xplode" not in plan


def test_far_values_and_huge_norms_are_searched_exactly(spark):
    """Rows about 1e8 apart from 0 and rows beyond single precision: the screen must not lose a neighbour."""
    rng = np.random.default_rng(3)
    x = np.vstack([1e8 + rng.normal(size=(300, 3)), rng.normal(size=(100, 3)) * 1e18, rng.normal(size=(300, 3)) * 1e-3])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, u double, v double, w double")
    found = knn(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["u", "v", "w"], 2, query_id="id", ref_id="id", leaf_rows=4).collect()
    got = {(r.id, r["rank"]): (r.dist, r.ref_id) for r in found}
    for i in range(0, len(x), 2):
        d = sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in range(1, len(x), 2))[:2]
        assert [got[i, 1], got[i, 2]] == [(pytest.approx(a, rel=1e-12), j) for a, j in d]


def test_equal_rows_leave_k_candidates_a_leaf():
    """A leaf of equal rows keeps at most k candidates of a query row, and few pairs are measured at once."""
    q, r, ids = np.zeros((300, 2)), np.zeros((4000, 2)), np.arange(4000)[::-1].copy()
    best = _Best(np.full(300, np.inf), 2)
    _meet(best, q, np.arange(300), r, ids)
    assert sum(len(rows) for rows, _, _ in best.rows) == 600
    rows, d, found = best.result()
    assert list(rows) == [i for i in range(300) for _ in (0, 1)] and set(found) == {0, 1} and not d.any()


def test_dcr_searches_once(spark):
    """Mean, minimum and percentile of the distances read one search."""
    ran = spark.sparkContext.accumulator(0)

    def search(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    rows = spark.createDataFrame([("S", 1, i, 1, float(i), i) for i in range(50)], "technique string, replicate int, row_id long, rank int, dist double, ref_id long")
    got = dcr(rows.mapInPandas(search, rows.schema)).first()
    assert (got.dcr_mean, got.dcr_min, got.dcr_p05) == (24.5, 0.0, pytest.approx(np.percentile(np.arange(50), 5)))
    assert ran.value == 50


def _shuffles_on_disk(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


def test_materialise_leaves_no_shuffle_files(spark):
    from fidelis.session import materialise

    before = _shuffles_on_disk(spark)
    out = materialise(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s")), "test")
    assert not _shuffles_on_disk(spark) - before
    assert out.count() == 97


def test_approximate_search_in_passes_equals_one_pass(spark, monkeypatch):
    from fidelis.operators import knn_approx as KA

    rng = np.random.default_rng(8)
    rows = rng.standard_normal((900, 3)).round(2).tolist() + [[0.5, 0.5, 0.5]] * 60
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "row_id long, x double, y double, z double")
    q, r = df.filter("row_id % 3 = 0").withColumn("d", F.col("row_id") % 2), df.filter("row_id % 3 <> 0")
    monkeypatch.setattr(KA, "R_BLOCK", 16)  # large cells are split into blocks as well
    monkeypatch.setattr(KA, "Q_BLOCK", 16)
    got = {}
    for tables in (5, KA.TABLES):
        monkeypatch.setattr(KA, "PASS_TABLES", tables)
        found = KA.knn_approx(q, r, ["x", "y", "z"], 2, query_id="row_id", ref_id="row_id", carry=["d"], pair_budget=1e9)
        got[tables] = sorted(map(tuple, found.collect()))
    assert got[5] == got[KA.TABLES] and len(got[5]) > 300
