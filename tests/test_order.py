"""The order primitive: whole output, right totals, at any number of partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators.marginal import exact_quantiles, ks_two_sample
from fidelis.operators.order import cumulative_counts, ranked_rows, with_row_index
from fidelis.operators.rules import Rule, flag_rules


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_cumulative_counts_is_whole(spark, parts):
    rng = np.random.default_rng(parts)
    rows = {(("hot" if i % 2 else f"k{i % 7}") if i % 11 else None, round(float(rng.normal()), 2)) for i in range(6000)}
    rows = [(k, x, int(rng.integers(0, 4))) for k, x in rows]
    df = spark.createDataFrame(rows, "k string, x double, w long")
    for _ in range(10 if parts == 8 else 2):
        got = cumulative_counts(df, ["k"], "x", ["w"], parts).collect()
        assert len(got) == len(rows)
        by_key = {}
        for k, x, w in sorted(rows, key=lambda r: (r[0] or "", r[1])):
            by_key.setdefault(k, []).append((x, w))
        for r in got:
            own = by_key[r.k]
            assert r.tot_w == sum(w for _, w in own)
            assert r.x_next == min((x for x, _ in own if x > r.x), default=None)
            assert r.cum_w == sum(w for x, w in own if x <= r.x) and r.pos == sum(x <= r.x for x, _ in own)


def test_exact_quantiles_and_ks(spark):
    rng = np.random.default_rng(4)
    real, syn = np.round(rng.normal(0, 1, 700), 1), np.round(rng.normal(0.3, 1.2, 250), 1)
    df = spark.createDataFrame([("REAL", 0, float(x)) for x in real] + [("S", 1, float(x)) for x in syn], "technique string, replicate int, v double")
    q = {r.q: r.quantile for r in exact_quantiles(df.filter("replicate = 1"), ["technique"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    assert q == pytest.approx({p: float(np.quantile(syn, p)) for p in q})
    grid = np.concatenate([real, syn])
    gap = max(abs((real <= g).mean() - (syn <= g).mean()) for g in grid)
    assert ks_two_sample(df, ["v"]).first()["ks_stat"] == pytest.approx(gap)


def test_ks_takes_one_order_of_the_values(spark):
    """REAL and all samples share one order per variable, instead of one each that are joined by value."""
    rng = np.random.default_rng(6)
    vals = {("REAL", 0): rng.normal(0, 1, 400), ("REAL", 4): rng.normal(0, 1, 300), ("S", 1): rng.normal(0.2, 1, 300), ("S", None): rng.normal(5, 0.1, 60),
            ("T", 2): np.full(50, -9.0), ("T", 3): rng.normal(0, 1, 10), (None, 1): rng.normal(0, 3, 90)}
    rows = [(t, r, float(round(x, 1)), float(x) if i % 5 else None) for (t, r), xs in vals.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "technique string, replicate int, u double, v double")
    out = ks_two_sample(df, ["u", "v"])
    got = {(r.technique, r.replicate, r.variable): r.ks_stat for r in out.collect()}
    assert len(got) == 8
    for (t, r, v), d in got.items():
        side = lambda keep: np.array([row["uv".index(v) + 2] for row in rows if keep(row) and row["uv".index(v) + 2] is not None])
        a, b = side(lambda row: row[0] == "REAL"), side(lambda row: row[:2] == (t, r))
        want = max(abs((a <= g).mean() - (b <= g).mean()) for g in [*a, *b])
        assert d is None if len(b) < 20 else d == pytest.approx(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("rangepartitioning") == 0


def test_rules_on_nan_text_and_null(spark):
    df = spark.createDataFrame([(1, "3", 1.0), (2, "abc", 2.0), (3, None, math.nan), (4, "9", None), (5, "1", 40.0)], "row_id int, s string, d double")
    rules = [Rule("s", "likert", 1, 5), Rule("d", "proportion", 0, 10)]
    got = {r.row_id: r.failed_rule for r in flag_rules(df, rules, drop_na=False).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 1, 5: 2}
    assert {r.row_id for r in flag_rules(df, rules).filter(F.col("failed_rule") == 0).collect()} == {3, 4}
    strict = {r.row_id: r.failed_rule for r in flag_rules(df, rules, null_fails=True, drop_na=False).collect()}
    assert strict == {1: None, 2: 1, 3: 1, 4: 1, 5: 2}


def test_row_index_needs_no_checkpoint(spark, monkeypatch):
    """Numbers follow the order, nulls first, whatever the partitions; the rows are written as a table."""
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *_, **__: pytest.fail("checkpoint"))
    rows = [(None if i % 50 == 0 else i * 7 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int")
    want = {r: k for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}
    for parts in (1, 5):
        got = with_row_index(df, ["a", "b"], "n", parts).collect()
        assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(rows)


def test_ranked_rows_moves_rows_once(spark):
    """Ties over slices are whole, and no join shuffles the rows again."""
    rows = [("a" if i % 3 else "b", float(i * 7 % 5 if i % 2 else 2), i, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, id int, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ranked_rows(df, ["k"], "x", ["w"], "id", 16)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(rows)
    for r in got:
        own = [(x, w) for k, x, _, w in rows if k == r.k]
        assert (r.below_w, r.at_w) == (sum(w for x, w in own if x < r.x), sum(w for x, w in own if x == r.x))


def test_dependency_metrics_rank_the_rows_once(spark):
    """The comparisons read written correlations: no pass over rows is left in their plan."""
    from fidelis.plans import q_dependency as Q

    found = Q._dependency_metrics(spark, "/root/testdata/sf0.001", eigen=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "panel-" not in plan
    assert found.count() == 3
