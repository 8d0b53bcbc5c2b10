"""Registered queries: measurement, latent paths and their report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import measurement as MS
from fidelis.operators import report as RP
from fidelis.operators.dependency import moments
from fidelis.operators.reshape import melt
from fidelis.plans.registry import rd, register
from fidelis.session import materialise
from fidelis.sources.panel import MEASUREMENT, STRUCTURE, load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]
CONS = list(MEASUREMENT)


# ------------------------------------------------------------------ alpha (SQL-checkable)
def _alpha_sql():
    parts = []
    for c, its in MEASUREMENT.items():
        k = len(its)
        sv = " + ".join(f"var_samp({i})" for i in its)
        sc = " + ".join(f"covar_samp({a}, {b})" for n, a in enumerate(its) for b in its[n + 1:])
        parts.append(f"SELECT technique, replicate, '{c}' AS construct, {k}.0 / {k - 1}.0 * (1.0 - ({sv}) / (({sv}) + 2 * ({sc}))) "
                     f"AS alpha FROM panel GROUP BY technique, replicate")
    return " UNION ALL ".join(parts)


_ALPHA = ("al", _alpha_sql())


def _alpha(spark, d):
    return MS.cronbach_alpha(load_panel(spark, d), MEASUREMENT)


register("cronbach_alpha", with_panel("SELECT technique, replicate, construct, " + rd("alpha") + " FROM al", [_ALPHA]))(_alpha)

register("reliability_thresholds_alpha", with_panel(
    "SELECT technique, replicate, construct, " + rd("alpha")
    + ", CASE WHEN alpha IS NULL THEN 'NA' WHEN alpha >= 0.7 THEN 'pass' ELSE 'fail' END AS status FROM al", [_ALPHA]))(
    lambda spark, d: RP.thresholds(_alpha(spark, d), "alpha", metric="alpha"))

_TM = ("tm", "SELECT technique, construct, avg(alpha) AS mean, stddev_samp(alpha) AS sd, min(alpha) AS mn, max(alpha) AS mx, "
             "count(DISTINCT replicate) AS n_replicates FROM al GROUP BY technique, construct")
register("reliability_mad_alpha", with_panel(
    "SELECT s.technique, s.construct, " + ", ".join([rd("s.mean", "mean"), rd("s.sd", "sd"), rd("s.mn", "min"), rd("s.mx", "max")])
    + ", s.n_replicates, " + ", ".join([rd("r.mean", "real"), rd("s.mean - r.mean", "delta"), rd("abs(s.mean - r.mean)", "abs_delta")])
    + " FROM tm s LEFT JOIN tm r ON r.technique = 'REAL' AND r.construct = s.construct WHERE s.technique <> 'REAL'",
    [_ALPHA, _TM]))(lambda spark, d: RP.vs_real(_alpha(spark, d), ["construct"], "alpha"))

register("reliability_stability_alpha", with_panel(
    "SELECT technique, construct, " + ", ".join([rd("mean"), rd("sd"), rd("mn", "min"), rd("mx", "max")])
    + ", n_replicates, " + rd("mx - mn", "range") + ", mx - mn > 0.3 AS unstable FROM tm", [_ALPHA, _TM]))(
    lambda spark, d: RP.stability(_alpha(spark, d), ["construct"], "alpha", RP.STABILITY_MAX["alpha"]))


# ------------------------------------------------------------------ HTMT (SQL-checkable)
def _htmt_sql():
    owner = {i: c for c, its in MEASUREMENT.items() for i in its}
    pr = []
    for n, a in enumerate(V):
        for b in V[n + 1:]:
            pr.append(f"SELECT technique, replicate, '{owner[a]}' AS ci, '{owner[b]}' AS cj, abs(corr({a}, {b})) AS ar "
                      "FROM panel GROUP BY technique, replicate")
    return [("pr", " UNION ALL ".join(pr)),
            ("mono", "SELECT technique, replicate, ci, avg(ar) AS mono FROM pr WHERE ci = cj GROUP BY ALL"),
            ("het", "SELECT technique, replicate, ci AS a, cj AS b, avg(ar) AS hetero FROM pr WHERE ci <> cj GROUP BY ALL"),
            ("ht", "SELECT h.technique, h.replicate, h.a AS construct_a, h.b AS construct_b, h.hetero / sqrt(ma.mono * mb.mono) AS htmt "
                   "FROM het h JOIN mono ma ON ma.technique = h.technique AND ma.replicate = h.replicate AND ma.ci = h.a "
                   "JOIN mono mb ON mb.technique = h.technique AND mb.replicate = h.replicate AND mb.ci = h.b")]


def _htmt(spark, d):
    p = load_panel(spark, d)
    return MS.htmt(moments(p, V), MEASUREMENT)


register("htmt", with_panel("SELECT technique, replicate, construct_a, construct_b, " + rd("htmt") + " FROM ht",
                            _htmt_sql()))(_htmt)

register("htmt_max", with_panel(
    "SELECT technique, " + rd("max(htmt)", "htmt_max") + ", max(htmt) < 0.85 AS pass FROM ht GROUP BY technique", _htmt_sql()))(
    lambda spark, d: _htmt(spark, d).groupBy("technique").agg(F.max("htmt").alias("htmt_max"))
    .withColumn("pass", F.col("htmt_max") < RP.HTMT_MAX))

_HT_TM = ("htm", "SELECT technique, construct_a, construct_b, avg(htmt) AS m FROM ht GROUP BY ALL")
register("htmt_stability", with_panel(
    "SELECT technique, " + rd("max(m) - min(m)", "htmt_range") + ", " + rd("stddev_samp(m)", "htmt_sd")
    + " FROM htm GROUP BY technique", _htmt_sql() + [_HT_TM]))(
    lambda spark, d: RP.technique_mean(_htmt(spark, d), ["construct_a", "construct_b"], "htmt").groupBy("technique").agg(
        (F.max("mean") - F.min("mean")).alias("htmt_range"), F.stddev_samp("mean").alias("htmt_sd")))

register("grid_rmse_htmt", with_panel(
    "SELECT s.technique, " + rd("sqrt(avg((s.m - r.m) * (s.m - r.m)))", "rmse") + ", count(*) AS cells FROM htm s JOIN htm r "
    "ON r.technique = 'REAL' AND r.construct_a = s.construct_a AND r.construct_b = s.construct_b "
    "WHERE s.technique <> 'REAL' AND s.m - r.m IS NOT NULL GROUP BY s.technique", _htmt_sql() + [_HT_TM]))(
    lambda spark, d: RP.grid_rmse(RP.vs_real(_htmt(spark, d), ["construct_a", "construct_b"], "htmt")))

# ------------------------------------------------------------------ zero-variance items and the model that is left
# Nothing is constant in the derived panel: one dataset loses an item, another two items and so a construct.
_DAMAGE = {"a1": ("SYN_NOISY", 1), "b1": ("SYN_INDEP", 2), "b3": ("SYN_INDEP", 2)}


def damaged_panel(spark, d):
    p = load_panel(spark, d, extended=True)
    return p.withColumns({v: F.when((F.col("technique") == t) & (F.col("replicate") == k), 0.5).otherwise(F.col(v)) for v, (t, k) in _DAMAGE.items()})


def _damaged_sql(v: str) -> str:
    if v not in _DAMAGE:
        return v
    t, k = _DAMAGE[v]
    return f"CASE WHEN technique = '{t}' AND replicate = {k} THEN 0.5 ELSE {v} END"


register("drop_zero_variance_items", with_panel(
    "SELECT technique, replicate, construct, item, " + rd("sd") + ", constant, n_items, NOT constant AND n_items >= 2 AS kept FROM "
    "(SELECT *, count(CASE WHEN NOT constant THEN 1 END) OVER (PARTITION BY technique, replicate, construct) AS n_items FROM "
    "(SELECT *, sd IS NULL OR sd = 0 AS constant FROM ("
    + " UNION ALL ".join(f"SELECT technique, replicate, '{c}' AS construct, '{v}' AS item, stddev_samp({_damaged_sql(v)}) AS sd FROM panel GROUP BY ALL"
                         for c, its in MEASUREMENT.items() for v in its) + ")))", extended=True))(
    lambda spark, d: MS.item_model(damaged_panel(spark, d), MEASUREMENT).drop("var"))
register("rebuilt_model")(lambda spark, d: MS.fit_rebuilt(damaged_panel(spark, d), MEASUREMENT, STRUCTURE))


# ------------------------------------------------------------------ PLS path model (property-tested)
def _pls(spark, d):
    return MS.pls_fit(load_panel(spark, d), MEASUREMENT, STRUCTURE)


def _pls_sheet(name, metric=None):
    return lambda spark, d: MS.sheet(_pls(spark, d), name, metric)


register("pls_fit")(_pls)
register("composite_reliability")(_pls_sheet("reliability", "rhoC"))
register("ave")(_pls_sheet("reliability", "AVE"))
register("rho_a")(_pls_sheet("reliability", "rhoA"))
register("latent_corr")(_pls_sheet("construct_corr", "r"))
register("r_squared")(_pls_sheet("rsquared"))
register("total_effects")(_pls_sheet("total_effects", "total"))
register("fornell_larcker")(lambda spark, d: MS.fornell_larcker(_pls(spark, d)))
register("latent_scores")(lambda spark, d: MS.latent_scores(load_panel(spark, d, with_row_id=True), _pls(spark, d), MEASUREMENT)
                          .select(*DS, "row_id", *[f"LV_{c}" for c in CONS]))


def _loadings(spark, d):
    return MS.sheet(_pls(spark, d), "loadings").groupBy(*DS, "key1", "key2").pivot("metric", ["loading", "indicator_r2"]) \
        .agg(F.first("value")).select(*DS, F.col("key1").alias("indicator"), F.col("key2").alias("construct"),
                                      "loading", "indicator_r2").filter(F.col("loading") != 0)


register("loadings_long")(_loadings)


def _est(spark, d, name, metric, keys=("key1", "key2")):
    return MS.sheet(_pls(spark, d), name, metric).select(*DS, *keys, "value")


register("loading_delta")(lambda spark, d: RP.vs_real(_est(spark, d, "loadings", "loading"), ["key1", "key2"], "value")
                          .withColumnRenamed("key1", "indicator").withColumnRenamed("key2", "construct"))
register("loading_mae")(lambda spark, d: RP.vs_real(_est(spark, d, "loadings", "loading"), ["key1", "key2"], "value")
                        .groupBy("technique", F.col("key2").alias("construct")).agg(F.avg("abs_delta").alias("loading_mae")))
register("loading_range_flip")(lambda spark, d: RP.sign_flip(_est(spark, d, "loadings", "loading"), ["key1", "key2"], "value"))
register("tucker_phi")(lambda spark, d: _tucker(spark, d))


def _tucker(spark, d):
    est = RP.technique_mean(_est(spark, d, "loadings", "loading"), ["key1", "key2"], "value")
    r = est.filter("technique = 'REAL'").select("key1", "key2", F.col("mean").alias("lr"))
    s = est.filter("technique <> 'REAL'").join(F.broadcast(r), ["key1", "key2"])
    phi = s.groupBy("technique", F.col("key2").alias("construct")).agg(
        (F.sum(F.col("mean") * F.col("lr")) / F.sqrt(F.sum(F.col("mean") ** 2) * F.sum(F.col("lr") ** 2))).alias("phi"))
    return phi.withColumn("band", F.when(F.col("phi") >= 0.95, "equal").when(F.col("phi") >= 0.85, "fair").otherwise("different"))


def _reliability(spark, d):
    """alpha, rhoC, rhoA and AVE per construct: technique, replicate, construct, metric, value."""
    p = load_panel(spark, d)
    alpha = MS.cronbach_alpha(p, MEASUREMENT).select(*DS, "construct", F.lit("alpha").alias("metric"), F.col("alpha").alias("value"))
    pls = MS.sheet(MS.pls_fit(p, MEASUREMENT, STRUCTURE), "reliability").filter(F.col("metric").isin("rhoC", "rhoA", "AVE"))
    return alpha.unionByName(pls.select(*DS, F.col("key1").alias("construct"), "metric", "value"))


def _reliability_stability(spark, d):
    limit = F.create_map(*[x for k, v in RP.STABILITY_MAX.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    return RP.stability(_reliability(spark, d), ["construct", "metric"], "value").withColumn("unstable", F.col("range") > limit)


# all four metrics and both grids; the parts that SQL can rebuild are the queries *_alpha and grid_rmse_htmt
register("reliability_thresholds")(lambda spark, d: RP.thresholds(_reliability(spark, d), "value", metric_col="metric"))
register("reliability_mad")(lambda spark, d: RP.vs_real(_reliability(spark, d), ["construct", "metric"], "value"))
register("reliability_stability")(_reliability_stability)


def _grids(spark, d):
    keys = ["construct_a", "construct_b"]
    ht = _htmt(spark, d).select(*DS, *keys, F.lit("htmt").alias("grid"), F.col("htmt").alias("value"))
    fl = MS.fornell_larcker(_pls(spark, d)).select(*DS, *keys, F.lit("fornell_larcker").alias("grid"), "value")
    return RP.grid_rmse(RP.vs_real(ht.unionByName(fl), ["grid", *keys], "value"), ("technique", "grid"))


register("grid_rmse")(_grids)


def _fl_diag(spark, d):
    return MS.sheet(_pls(spark, d), "reliability", "AVE").select(*DS, F.col("key1").alias("construct"),
                                                                F.sqrt("value").alias("sqrt_ave"))


register("fl_diagonal")(_fl_diag)


def _margin(spark, d):
    res = _pls(spark, d)
    diag = MS.sheet(res, "reliability", "AVE").select(*DS, F.col("key1").alias("construct"), F.sqrt("value").alias("sa"))
    cc = MS.sheet(res, "construct_corr", "r").filter(F.col("key1") != F.col("key2")).groupBy(*DS, F.col("key1").alias("construct")) \
        .agg(F.max(F.abs("value")).alias("max_r"))
    return diag.join(cc, [*DS, "construct"]).groupBy(*DS).agg(F.min(F.col("sa") - F.col("max_r")).alias("discriminant_margin"))


register("discriminant_margin")(_margin)
register("path_direction_rank")(lambda spark, d: RP.direction_rank(
    RP.vs_real(_est(spark, d, "paths", "beta"), ["key1", "key2"], "value"), "key1"))
# every sheet of the estimates: paths, loadings, reliability, R2 and total effects
def estimate_sheets(spark, d):
    """technique, replicate, sheet, metric, key1, key2, value."""
    fit = _pls(spark, d).filter(F.col("sheet").isin("paths", "loadings", "rsquared", "total_effects"))
    fit = fit.filter("metric IN ('beta', 'loading', 'R2', 'total')")
    rel = _reliability(spark, d).select(*DS, F.lit("reliability").alias("sheet"), "metric", F.col("construct").alias("key1"), F.lit(None).cast("string").alias("key2"), "value")
    return fit.select(*DS, "sheet", "metric", "key1", "key2", "value").unionByName(rel)


def _path_errors(spark, d):
    delta = RP.vs_real(estimate_sheets(spark, d).na.fill("", ["key1", "key2"]), ["sheet", "metric", "key1", "key2"], "value")
    return RP.sheet_errors(delta, ["technique", "sheet", "metric"])


register("path_errors")(_path_errors)
register("r2_summary")(lambda spark, d: RP.technique_mean(_est(spark, d, "rsquared", "R2", ("key1",)), ["key1"], "value")
                       .select("technique", F.col("key1").alias("construct"), F.col("mean").alias("mean_r2")))
_SHEET = ["sheet", "metric", "key1", "key2"]
register("multi_run_summary")(lambda spark, d: RP.agg_replicates(_pls(spark, d), _SHEET, "value"))
register("compare_sheets")(lambda spark, d: RP.compare_sheets(
    materialise(_pls(spark, d), "sheets"), _SHEET, "value", sheet=["sheet"]))


def _seed_pass(spark, d):
    """Over the replicates (seeds) of a technique, per quantity: mean, sd, least, greatest, and the share that passes."""
    from fidelis.plans import q_latent as QL  # bootstrap p-values and the mediation model

    boot, est = QL.boot_med(spark, d)
    paths = MS.bootstrap_summary(boot, est).filter("effect = 'direct'")
    name = lambda quantity, k1, k2, value, ok: [F.lit(quantity).alias("quantity"), k1.alias("key1"), k2.alias("key2"), value.alias("value"), ok.alias("ok")]
    none, text = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    parts = [paths.select(*DS, *name("beta", F.col("iv"), F.col("dv"), F.col("estimate"), F.col("p_value") < 0.05))]
    ind = MS.indirect_effects(boot, est, QL.MEDIATIONS)
    parts.append(ind.select(*DS, *name("indirect", F.concat_ws("->", "iv", "mediator"), F.col("dv"), F.col("indirect_b"), F.col("p_value") < 0.05)))
    fit = QL.pls_med(spark, d)
    parts.append(MS.sheet(fit, "rsquared", "R2").select(*DS, *name("R2", F.col("key1"), text, F.col("value"), none)))
    rel = _reliability(spark, d).filter("metric IN ('alpha', 'rhoC', 'AVE')")
    parts.append(rel.select(*DS, F.col("metric").alias("quantity"), F.col("construct").alias("key1"), text.alias("key2"), "value",
                            F.when(F.col("metric") == "AVE", F.col("value") >= RP.RELIABILITY_MIN["AVE"]).alias("ok")))
    parts.append(_htmt(spark, d).select(*DS, *name("htmt", F.col("construct_a"), F.col("construct_b"), F.col("htmt"), F.col("htmt") <= RP.HTMT_SEED_MAX)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return RP.seed_summary(out, ["technique", "quantity", "key1", "key2"])


register("seed_pass_rates")(_seed_pass)
