"""Values of the PLS-based reports against an independent implementation: composite scores on rows, not correlations."""

import itertools
import math

import numpy as np
import pytest

from fidelis.plans import QUERIES
from fidelis.plans import q_latent as QL
from fidelis.plans import q_measurement as QM
from fidelis.sources.panel import MEASUREMENT, STRUCTURE, VARIABLES, load_panel

from .conftest import SF_SMALL

CONS = list(MEASUREMENT)
PAIRS = list(itertools.combinations(CONS, 2))


def pls_rows(x, structure, model=MEASUREMENT):
    """PLS path model (mode A, path weighting) by alternating regressions on rows; x: item -> standardised column."""
    cons = list(model)
    data = {c: np.stack([x[i] for i in model[c]], axis=1) for c in cons}
    std = lambda v: (v - v.mean()) / v.std(ddof=1)
    score = {c: std(data[c].sum(axis=1)) for c in cons}
    weight = {}
    for _ in range(500):
        proxy = {}
        for c in cons:
            pred, succ = [a for a, b in structure if b == c], [b for a, b in structure if a == c]
            z = sum((np.corrcoef(score[c], score[b])[0, 1] * score[b] for b in succ), np.zeros(len(score[c])))
            if pred:
                z = z + np.stack([score[a] for a in pred], axis=1) @ np.linalg.lstsq(np.stack([score[a] for a in pred], axis=1), score[c], rcond=None)[0]
            proxy[c] = z if np.any(z) else data[c].sum(axis=1)
        new = {}
        for c in cons:
            w = data[c].T @ proxy[c]
            new[c] = w / (data[c] @ w).std(ddof=1)
        moved = max(np.abs(new[c] - weight[c]).max() for c in cons) if weight else 1.0
        weight, score = new, {c: data[c] @ new[c] for c in cons}
        if moved < 1e-10:
            break
    out = {"score": {}, "loading": {}, "beta": {}, "r2": {}, "adj": {}, "weight": {}}
    for c in cons:
        load = np.array([np.corrcoef(data[c][:, k], score[c])[0, 1] for k in range(len(model[c]))])
        sign = -1.0 if load.sum() < 0 else 1.0
        out["score"][c], out["weight"][c] = sign * score[c], sign * weight[c]
        out["loading"] |= {(i, c): sign * v for i, v in zip(model[c], load)}
    n = len(next(iter(score.values())))
    for c in cons:
        pred = [a for a, b in structure if b == c]
        if pred:
            m = np.stack([out["score"][a] for a in pred], axis=1)
            beta, rest, *_ = np.linalg.lstsq(m, out["score"][c], rcond=None)
            out["beta"] |= {(a, c): b for a, b in zip(pred, beta)}
            out["r2"][c] = 1 - rest[0] / (out["score"][c] @ out["score"][c])
            out["adj"][c] = 1 - (1 - out["r2"][c]) * (n - 1) / (n - len(pred) - 1)
    out["r"] = {(a, b): np.corrcoef(out["score"][a], out["score"][b])[0, 1] for a in cons for b in cons}
    out["ave"] = {c: np.mean([out["loading"][i, c] ** 2 for i in model[c]]) for c in cons}
    out["rhoC"], out["rhoA"], out["alpha"] = {}, {}, {}
    for c in cons:
        lam = np.array([out["loading"][i, c] for i in model[c]])
        out["rhoC"][c] = lam.sum() ** 2 / (lam.sum() ** 2 + (1 - lam ** 2).sum())
        w, s = out["weight"][c], np.corrcoef(data[c].T)
        off = lambda m: m - np.diag(np.diag(m))
        out["rhoA"][c] = (w @ w) ** 2 * (w @ off(s) @ w) / (w @ off(np.outer(w, w)) @ w)
    return out


def total_effects(beta):
    """Sums over all directed ways."""
    out = {}

    def walk(start, at, product):
        for (a, b), v in beta.items():
            if a == at:
                out[start, b] = out.get((start, b), 0.0) + product * v
                walk(start, b, product * v)

    for c in CONS:
        walk(c, c, 1.0)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return load_panel(spark, SF_SMALL, with_row_id=True).toPandas()


@pytest.fixture(scope="module")
def fits(table):
    out = {}
    for key, g in table.groupby(["technique", "replicate"]):
        x = {v: ((g[v] - g[v].mean()) / g[v].std(ddof=1)).to_numpy() for v in VARIABLES}
        out[key] = {"plain": pls_rows(x, STRUCTURE), "med": pls_rows(x, QL.STRUCTURE_MED), "rows": g["row_id"].to_numpy(), "items": g[VARIABLES]}
    return out


def run(spark, name, *keys):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    return {tuple(r[k] for k in keys): r for r in rows}


def close(got, want, tol=2e-5):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=tol), k


def means(fits, values):
    """technique -> key -> mean over replicates of values(fit)."""
    out = {}
    for (t, _), f in fits.items():
        for k, v in values(f).items():
            out.setdefault(t, {}).setdefault(k, []).append(v)
    return {t: {k: np.mean(v) for k, v in x.items()} for t, x in out.items()}


def spearman(x, y):
    def rank(v):
        return np.array([np.sum(v < a) + (np.sum(v == a) + 1) / 2 for a in v])

    return np.corrcoef(rank(np.array(x)), rank(np.array(y)))[0, 1] if len(x) > 1 else None


def test_reliability_and_correlations(spark, fits):
    for name, metric in (("composite_reliability", "rhoC"), ("ave", "ave"), ("rho_a", "rhoA")):
        got = run(spark, name, "technique", "replicate", "key1")
        close({k: r.value for k, r in got.items()}, {(*d, c): f["plain"][metric][c] for d, f in fits.items() for c in CONS})
    got = run(spark, "latent_corr", "technique", "replicate", "key1", "key2")
    close({k: r.value for k, r in got.items()}, {(*d, *k): v for d, f in fits.items() for k, v in f["plain"]["r"].items()})
    fl = run(spark, "fornell_larcker", "technique", "replicate", "construct_a", "construct_b")
    want = {(*d, c, c): math.sqrt(f["plain"]["ave"][c]) for d, f in fits.items() for c in CONS}
    want |= {(*d, b, a): f["plain"]["r"][a, b] for d, f in fits.items() for a, b in PAIRS}
    close({k: r.value for k, r in fl.items()}, want)
    got = run(spark, "fl_diagonal", "technique", "replicate", "construct")
    close({k: r.sqrt_ave for k, r in got.items()}, {(*d, c): math.sqrt(f["plain"]["ave"][c]) for d, f in fits.items() for c in CONS})
    got = run(spark, "discriminant_margin", "technique", "replicate")
    close({k: r.discriminant_margin for k, r in got.items()}, {
        d: min(math.sqrt(f["plain"]["ave"][c]) - max(abs(f["plain"]["r"][c, o]) for o in CONS if o != c) for c in CONS) for d, f in fits.items()})


def test_scores_loadings_and_r2(spark, fits):
    got = run(spark, "latent_scores", "technique", "replicate", "row_id")
    for d, f in fits.items():
        for c in CONS:
            mine = np.array([got[(*d, i)][f"LV_{c}"] for i in f["rows"]])
            assert np.abs(mine - f["plain"]["score"][c]).max() < 1e-4
    got = run(spark, "loadings_long", "technique", "replicate", "indicator", "construct")
    want = {(*d, *k): v for d, f in fits.items() for k, v in f["plain"]["loading"].items()}
    close({k: r.loading for k, r in got.items()}, want)
    close({k: r.indicator_r2 for k, r in got.items()}, {k: v * v for k, v in want.items()})
    got = run(spark, "r_squared", "technique", "replicate", "key1", "metric")
    want = {(*d, c, "R2"): v for d, f in fits.items() for c, v in f["plain"]["r2"].items()}
    want |= {(*d, c, "Adj_R2"): v for d, f in fits.items() for c, v in f["plain"]["adj"].items()}
    close({k: r.value for k, r in got.items()}, want)
    got = run(spark, "r2_summary", "technique", "construct")
    close({k: r.mean_r2 for k, r in got.items()}, {(t, c): v for t, x in means(fits, lambda f: f["plain"]["r2"]).items() for c, v in x.items()})
    got = run(spark, "total_effects", "technique", "replicate", "key1", "key2")
    close({k: r.value for k, r in got.items()}, {(*d, *k): v for d, f in fits.items() for k, v in total_effects(f["plain"]["beta"]).items()})


def test_loading_reports(spark, fits):
    mean = means(fits, lambda f: f["plain"]["loading"])
    syn = [t for t in mean if t != "REAL"]
    got = run(spark, "loading_delta", "technique", "indicator", "construct")
    close({k: r.delta for k, r in got.items()}, {(t, *k): mean[t][k] - mean["REAL"][k] for t in syn for k in mean[t]})
    got = run(spark, "loading_mae", "technique", "construct")
    close({k: r.loading_mae for k, r in got.items()}, {
        (t, c): np.mean([abs(mean[t][i, c] - mean["REAL"][i, c]) for i in MEASUREMENT[c]]) for t in syn for c in CONS})
    got = run(spark, "tucker_phi", "technique", "construct")
    for t in syn:
        for c in CONS:
            a, b = (np.array([mean[s][i, c] for i in MEASUREMENT[c]]) for s in (t, "REAL"))
            phi = a @ b / math.sqrt((a @ a) * (b @ b))
            assert got[t, c].phi == pytest.approx(phi, abs=1e-5) and got[t, c].band == ("equal" if phi >= 0.95 else "fair" if phi >= 0.85 else "different")
    got = run(spark, "loading_range_flip", "technique", "key1", "key2")
    for (t, i, c), r in got.items():
        v = [f["plain"]["loading"][i, c] for (tech, _), f in fits.items() if tech == t]
        assert r["range"] == pytest.approx(max(v) - min(v), abs=2e-5) and r.sign_flip == (min(v) < 0 < max(v))


def test_path_reports(spark, fits):
    sheets = lambda f: ({("paths", "beta", *k): v for k, v in f["beta"].items()} | {("loadings", "loading", *k): v for k, v in f["loading"].items()}
                        | {("rsquared", "R2", c, ""): v for c, v in f["r2"].items()} | {("total_effects", "total", *k): v for k, v in total_effects(f["beta"]).items()}
                        | {("reliability", m, c, ""): f[{"AVE": "ave"}.get(m, m)][c] for m in ("rhoC", "rhoA", "AVE") for c in CONS})
    mean = means(fits, lambda f: sheets(f["plain"]))
    got = run(spark, "path_errors", "technique", "sheet", "metric")
    for t in mean:
        if t == "REAL":
            continue
        for group in {k[:2] for k in mean[t]}:
            keys = [k for k in mean[t] if k[:2] == group]
            a, b = (np.array([mean[s][k] for k in keys]) for s in (t, "REAL"))
            r = got[(t, *group)]
            assert (r.n, r.mae, r.rmse) == (len(keys), pytest.approx(np.abs(a - b).mean(), abs=2e-5), pytest.approx(math.sqrt(((a - b) ** 2).mean()), abs=2e-5))
            assert r.direction == pytest.approx(np.mean(np.sign(a) == np.sign(b)))
            if len(keys) > 2:
                assert r.rank_rho == pytest.approx(spearman(np.abs(a), np.abs(b)), abs=1e-6)
    assert {k[1:] for k in got} == {g for t in mean for g in {k[:2] for k in mean[t]}} | {("reliability", "alpha")}
    got = run(spark, "path_direction_rank", "technique")
    for (t,), r in got.items():
        keys = [k for k in mean[t] if k[0] == "paths"]
        assert r.n_paths == len(keys) and r.direction_share == pytest.approx(np.mean([np.sign(mean[t][k]) == np.sign(mean["REAL"][k]) for k in keys]))
        assert r.rank_rho == pytest.approx(spearman([abs(mean[t][k]) for k in keys], [abs(mean["REAL"][k]) for k in keys]), abs=1e-6)
    got = run(spark, "mediation_summary", "technique", "replicate")
    for d, f in fits.items():
        b, r = f["med"]["beta"], got[d]
        assert (r.a_std, r.b_std, r.cprime_std) == pytest.approx((b["FA", "FB"], b["FB", "FC"], b["FA", "FC"]), abs=2e-5)
        assert r.total_std == pytest.approx(b["FA", "FC"] + b["FA", "FB"] * b["FB", "FC"], abs=2e-5)


def test_bootstrap_reports(spark, fits, monkeypatch):
    monkeypatch.setattr(QL, "DRAWS", 40)
    boot = {}
    for r in QUERIES["bootstrap_fit"](spark, SF_SMALL).collect():
        boot.setdefault((r.technique, r.replicate, r.iv, r.dv, r.effect), []).append(r.value)
    p2 = lambda t: math.erfc(abs(t) / math.sqrt(2))
    got = run(spark, "std_paths", "technique", "replicate", "iv", "dv", "effect")
    assert len(got) == len(boot)
    for k, r in got.items():
        v, f = np.array(boot[k]), fits[k[:2]]["plain"]
        est = (f["beta"] if k[4] == "direct" else total_effects(f["beta"]))[k[2:4]]
        assert (r.estimate, r.boot_mean, r.boot_sd) == pytest.approx((est, v.mean(), v.std(ddof=1)), abs=2e-5)
        assert (r.ci_95l, r.ci_95u) == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])), abs=2e-5)
        assert r.t_stat == pytest.approx(est / v.std(ddof=1), rel=1e-3) and r.p_value == pytest.approx(p2(est / v.std(ddof=1)), abs=1e-4)
    table = run(spark, "path_beta_table", "technique", "replicate", "iv", "dv")
    for k, r in table.items():
        p = got[(*k, "direct")].p_value
        sig = "**" if p < 0.01 else "*" if p < 0.05 else "ns"
        assert r.cell == f"{got[(*k, 'direct')].estimate:.2f} ± {got[(*k, 'direct')].boot_sd:.2f} {sig}"
    over = run(spark, "path_range_overlap", "technique", "iv", "dv")
    for (t, a, b), r in over.items():
        est = [got[x, k, a, b, "direct"].estimate for x, k in fits if x == t]
        sd = max(got[x, k, a, b, "direct"].boot_sd for x, k in fits if x == t)
        real = round(np.mean([got[x, k, a, b, "direct"].estimate for x, k in fits if x == "REAL"]), 2)
        assert r.overlap == (np.mean(est) - sd <= real <= np.mean(est) + sd)
    ind = run(spark, "indirect_effect", "technique", "replicate")
    cmp = run(spark, "indirect_compare", "technique")
    for d, f in fits.items():
        b = f["med"]["beta"]
        assert ind[d].indirect_b == pytest.approx(b["FA", "FB"] * b["FB", "FC"], abs=2e-5)
        assert ind[d].t_stat == pytest.approx(ind[d].indirect_b / ind[d].std_err, rel=1e-3)
    real = ind["REAL", 0]
    for (t,), r in cmp.items():
        mine = [x for (u, _), x in ind.items() if u == t]
        assert r.abs_delta == pytest.approx(abs(np.mean([x.indirect_b for x in mine]) - real.indirect_b), abs=1e-5)
        assert r.p_agreement == pytest.approx(np.mean([(x.p_value < 0.05) == (real.p_value < 0.05) for x in mine]))
    seeds = run(spark, "seed_pass_rates", "technique", "quantity", "key1", "key2")
    for t in {k[0] for k in fits}:
        mine = [x for (u, _), x in fits.items() if u == t]
        r2, ave = [x["med"]["r2"]["FC"] for x in mine], [x["plain"]["ave"]["FA"] for x in mine]
        r = seeds[t, "R2", "FC", None]
        assert (r.seeds, r["mean"], r["min"], r["max"], r.share_ok) == (len(mine), pytest.approx(np.mean(r2), abs=2e-5), pytest.approx(min(r2), abs=2e-5), pytest.approx(max(r2), abs=2e-5), None)
        assert seeds[t, "AVE", "FA", None].share_ok == pytest.approx(np.mean([a >= 0.5 for a in ave]))
        beta = [x["med"]["beta"]["FA", "FC"] for x in mine]
        assert seeds[t, "beta", "FA", "FC"]["mean"] == pytest.approx(np.mean(beta), abs=2e-5)
        share = np.mean([x.p_value < 0.05 for (u, _), x in ind.items() if u == t])
        assert seeds[t, "indirect", "FA->FB", "FC"].share_ok == pytest.approx(share)
        assert 0 <= seeds[t, "htmt", "FA", "FB"].share_ok <= 1 and seeds[t, "alpha", "FB", None].seeds == len(mine)


def test_eigen_spectrum(spark, fits):
    # spectra are compared at unit length
    values = {d: np.sort(np.linalg.eigvalsh(np.corrcoef(f["items"].to_numpy().T)))[::-1] for d, f in fits.items()}
    values = {d: v / np.linalg.norm(v) for d, v in values.items()}
    got = run(spark, "eigen_spectrum", "technique", "replicate")
    for d, r in got.items():
        a, b = values[d], values["REAL", 0]
        assert r.eig_l2 == pytest.approx(np.linalg.norm(a - b), abs=1e-5)
        assert r.eig_cosine == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-5)


def test_rebuilt_model(spark):
    panel = QM.damaged_panel(spark, SF_SMALL).toPandas()
    got = {}
    for r in QUERIES["rebuilt_model"](spark, SF_SMALL).collect():
        got.setdefault((r.technique, r.replicate), {})[r.sheet, r.key1, r.key2, r.metric] = r.value
    for d, g in panel.groupby(["technique", "replicate"]):
        model = {c: [i for i in its if g[i].std() > 0] for c, its in MEASUREMENT.items()}
        model = {c: its for c, its in model.items() if len(its) > 1}
        assert {"SYN_NOISY1": 8, "SYN_INDEP2": 6}.get(f"{d[0]}{d[1]}", 9) == sum(map(len, model.values()))
        items = [i for its in model.values() for i in its]
        cov, cor = g[items].cov(), g[items].corr().abs()
        for c, its in model.items():
            k, s = len(its), cov.loc[its, its].to_numpy()
            assert got[d]["alpha", c, None, "alpha"] == pytest.approx(k / (k - 1) * (1 - np.diag(s).sum() / s.sum()), abs=1e-6)
        for a, b in itertools.combinations(model, 2):
            mono = [np.mean([cor.loc[i, j] for i, j in itertools.combinations(model[c], 2)]) for c in (a, b)]
            assert got[d]["htmt", a, b, "htmt"] == pytest.approx(cor.loc[model[a], model[b]].to_numpy().mean() / math.sqrt(mono[0] * mono[1]), abs=1e-6)
        assert {k[1] for k in got[d] if k[0] == "loadings"} == set(items)
        paths = [(a, b) for a, b in STRUCTURE if a in model and b in model]
        assert {k[1:3] for k in got[d] if k[0] == "paths"} == set(paths)
        if not g[items].isna().any().any():
            x = {v: ((g[v] - g[v].mean()) / g[v].std(ddof=1)).to_numpy() for v in items}
            want = pls_rows(x, paths, model)
            for k, v in want["beta"].items():
                assert got[d]["paths", *k, "beta"] == pytest.approx(v, abs=2e-5)
            for (i, c), v in want["loading"].items():
                assert got[d]["loadings", i, c, "loading"] == pytest.approx(v, abs=2e-5)


def test_latent_and_path_scores(spark, fits):
    lower = [(b, a) for a, b in PAIRS]
    mean = means(fits, lambda f: {k: f["plain"]["r"][k] for k in lower})
    got = run(spark, "latent_delta", "technique", "var_i", "var_j")
    close({k: r.delta for k, r in got.items()}, {(t, *k): mean[t][k] - mean["REAL"][k] for t in mean if t != "REAL" for k in lower})
    got = run(spark, "latent_stability", "technique")
    scores = run(spark, "score_latent", "technique")
    for (t,), r in got.items():
        d = [abs(mean[t][k] - mean["REAL"][k]) for k in lower]
        assert (r.mean_abs_delta, r.median_abs_delta, r.max_abs_delta) == pytest.approx((np.mean(d), np.median(d), max(d)), abs=2e-5)
        assert scores[t,].latentcorr_score == pytest.approx(-np.mean(d), abs=2e-5)
    real = next(f for (t, _), f in fits.items() if t == "REAL")["med"]["beta"]
    got = run(spark, "path_hybrid_score", "technique", "replicate")
    for (t, k), r in got.items():
        b = fits[t, k]["med"]["beta"]
        keys = sorted(b)
        direction, rho = np.mean([np.sign(b[p]) == np.sign(real[p]) for p in keys]), spearman([b[p] for p in keys], [real[p] for p in keys])
        assert r.n_paths == 3 and r.hybrid == pytest.approx((direction + rho) / 2, abs=1e-6)
    assert all(sum(r.best for (u, _), r in got.items() if u == t) == 1 for t, _ in got)
    score = run(spark, "score_path", "technique")
    assert set(score) == {(t,) for t in mean if t != "REAL"} and all(0 <= r.path_score <= 1 for r in score.values())
