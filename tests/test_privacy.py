"""Disclosure operators against brute force: nearest tuples of many columns, columns per dataset."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fidelis.operators import hamming
from fidelis.operators import privacy as PV

QI = [f"q{i}" for i in range(10)]


def _panel(spark, n_real, n_syn, levels, nulls=0.03, seed=5):
    rng = np.random.default_rng(seed)
    n = n_real + n_syn
    data = {c: rng.integers(0, levels[i % len(levels)], n) for i, c in enumerate(QI)}
    df = pd.DataFrame(data).astype(object).mask(rng.random((n, len(QI))) < nulls, None)
    df["technique"] = ["REAL"] * n_real + [f"S{i % 3}" for i in range(n_syn)]
    df["replicate"], df["row_id"], df["sens"] = 1, np.arange(n) * 7 % 100_003, rng.integers(0, 4, n)
    rows = [tuple(None if v is None else v if isinstance(v, str) else int(v) for v in r) for r in df.itertuples(index=False)]
    schema = ", ".join([*[f"{c} int" for c in QI], "technique string", "replicate int", "row_id long", "sens int"])
    return spark.createDataFrame(rows, schema), df


def _nearest(x, real):
    """Per row of x: (equal columns, smallest row id among the nearest)."""
    out = []
    for t in x[QI].itertuples(index=False):
        equal = sum((real[c] == v).to_numpy() & real[c].notna().to_numpy() if v is not None else np.zeros(len(real), bool) for c, v in zip(QI, t)).astype(int)
        out.append((equal.max(), real["row_id"].to_numpy()[equal == equal.max()].min()))
    return out


@pytest.mark.parametrize("levels,block", [([2, 3, 5], 2048), ([40, 60], 16)])
def test_nearest_tuple_of_ten_columns(spark, monkeypatch, levels, block):
    monkeypatch.setattr(hamming, "BLOCK", block)
    panel, df = _panel(spark, 300, 240, levels)
    real, syn = df[df.technique == "REAL"], df[df.technique != "REAL"]
    want = _nearest(syn, real)
    got = PV.attribute_disclosure(panel, QI, "sens").collect()
    sens = dict(zip(real.row_id, real.sens))
    hit = pd.Series([sens[r] for _, r in want], index=syn.index) == syn.sens
    assert {r.technique: r.attribute_disclosure_sens for r in got} == pytest.approx(hit.groupby(syn.technique).mean().to_dict())
    tuples = hamming.nearest_tuples(panel.filter("technique <> 'REAL'"), panel.filter("technique = 'REAL'"), QI, "row_id").collect()
    key = lambda r: tuple(None if pd.isna(v) else int(v) for v in r)
    assert {key(t[:10]): (t.equal, t.ref_id) for t in tuples} == {key(t): w for t, w in zip(syn[QI].itertuples(index=False), want)}


def test_no_equal_column_gives_the_first_row(spark):
    schema = "technique string, replicate int, row_id long, a int, b string, sens int"
    panel = spark.createDataFrame([("REAL", 0, 9, 1, "x", 3), ("REAL", 0, 4, 2, "y", 5), ("S", 1, 1, 7, "z", 5), ("S", 1, 2, None, None, 3)], schema)
    assert PV.attribute_disclosure(panel, ["a", "b"], "sens").first()[-1] == 0.5


def test_dcr_columns_are_chosen_per_dataset(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3))
    rows = []
    for i, r in enumerate(x.tolist()):
        tech = ("REAL", "A", "B")[i % 3]
        rows.append((tech, 0 if tech == "REAL" else 1, i, *[None if tech == "B" and k == 2 and i % 2 else v for k, v in enumerate(r)]))
    panel = spark.createDataFrame(rows, "technique string, replicate int, row_id long, u double, v double, w double")
    got = {r.technique: r for r in PV.dcr_standardized(panel, ["u", "v", "w"]).collect()}
    assert (got["A"].dcr_common_features, got["B"].dcr_common_features) == (3, 2)
    real = x[0::3]
    for tech, at, cols in (("A", 1, [0, 1, 2]), ("B", 2, [0, 1])):
        z = (real[:, cols] - real[:, cols].mean(0)) / real[:, cols].std(0)
        s = (x[at::3][:, cols] - real[:, cols].mean(0)) / real[:, cols].std(0)
        d = np.sqrt(((s[:, None] - z[None]) ** 2).sum(-1))
        assert got[tech].dcr_s2r_mean == pytest.approx(d.min(1).mean()) and got[tech].dcr_r2s_mean == pytest.approx(d.min(0).mean())
        assert got[tech].dcr_s2r_p05 == pytest.approx(np.percentile(d.min(1), 5))
    assert panel.filter(F.col("w").isNull()).count() > 0
