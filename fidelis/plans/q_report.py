"""Registered queries: aggregations, ranks and the overall ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import marginal as M
from fidelis.operators import privacy as PV
from fidelis.operators import ranking as RK
from fidelis.operators import report as RP
from fidelis.operators.dependency import covariate_corr, pair_delta
from fidelis.operators.reshape import minmax_normalize, sort_real_first
from fidelis.plans import q_measurement as QM
from fidelis.plans import q_privacy as QP
from fidelis.plans.registry import rd, register
from fidelis.session import materialise
from fidelis.sources.panel import MEASUREMENT, load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]

# ------------------------------------------------------------------ agg_counts_pct (masks -> n and %)
_MASKS = {"flag_line1": "l_linenumber = 1", "o1_low": "o1 <= 2", "o1_high": "o1 >= 3", "returned": "l_returnflag = 'R'"}
register("agg_counts_pct", with_panel(
    "SELECT technique, " + ", ".join(
        f"count(CASE WHEN {c} THEN 1 END) AS n_{k}, " + rd(f"100.0 * avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)", f"pct_{k}")
        for k, c in _MASKS.items()) + " FROM panel GROUP BY technique", extended=True))(
    lambda spark, d: load_panel(spark, d, extended=True).groupBy("technique").agg(*[
        x for k, c in _MASKS.items() for x in (
            F.count(F.when(F.expr(c), 1)).alias(f"n_{k}"),
            (100.0 * F.avg(F.when(F.expr(c), 1.0).otherwise(0.0))).alias(f"pct_{k}"))]))

# ------------------------------------------------------------------ agg_mean_per_run (per-run stats, then mean of runs)
register("agg_mean_per_run", with_panel(
    "SELECT technique, count(*) AS runs, " + ", ".join(rd(f"avg({s}_{v})", f"{s}_{v}") for v in V for s in ("mean", "sd"))
    + " FROM (SELECT technique, replicate, " + ", ".join(f"avg({v}) AS mean_{v}, stddev_samp({v}) AS sd_{v}" for v in V)
    + " FROM panel GROUP BY technique, replicate) GROUP BY technique"))(
    lambda spark, d: load_panel(spark, d).groupBy(*DS).agg(
        *[x for v in V for x in (F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"sd_{v}"))]).groupBy("technique").agg(
        F.count(F.lit(1)).alias("runs"), *[F.avg(f"{s}_{v}").alias(f"{s}_{v}") for v in V for s in ("mean", "sd")]))

# ------------------------------------------------------------------ agg_replicates over an estimate table
register("agg_replicates", with_panel(
    "SELECT technique, variable, " + ", ".join([rd("avg(m)", "mean"), rd("stddev_samp(m)", "sd"), rd("min(m)", "min"),
                                                 rd("max(m)", "max")])
    + ", count(DISTINCT replicate) AS n_replicates FROM (SELECT technique, replicate, variable, avg(value) AS m FROM long "
      "GROUP BY ALL) GROUP BY technique, variable HAVING count(DISTINCT replicate) >= 2",
    [("long", " UNION ALL ".join(f"SELECT technique, replicate, '{v}' AS variable, {v} AS value FROM panel" for v in V))]))(
    lambda spark, d: RP.agg_replicates(
        M.continuous_summary(load_panel(spark, d), V, ("technique", "replicate")).select(*DS, "variable", F.col("mean").alias("m")),
        ["variable"], "m"))


# ------------------------------------------------------------------ ranks of technique metrics
def _dist(spark, d):
    return M.dist_summary(load_panel(spark, d), V).filter("technique <> 'REAL'")


_DIST_CTE = ("ds", "SELECT technique, avg(CASE WHEN r.sd > 0 THEN abs(s.mean - r.mean) / r.sd END) AS mean_abs_dmu "
                   "FROM (SELECT technique, variable, avg(value) AS mean, stddev_samp(value) AS sd FROM long GROUP BY ALL) s "
                   "JOIN (SELECT variable, avg(value) AS mean, stddev_samp(value) AS sd FROM long WHERE technique = 'REAL' "
                   "GROUP BY variable) r USING (variable) WHERE technique <> 'REAL' GROUP BY technique")
_LONG = ("long", " UNION ALL ".join(f"SELECT technique, '{v}' AS variable, {v} AS value FROM panel" for v in V))
register("rank_desc_min", with_panel(
    "SELECT technique, " + rd("mean_abs_dmu") + ", CAST(rank() OVER (ORDER BY mean_abs_dmu DESC) AS INTEGER) AS rank_min FROM ds",
    [_LONG, _DIST_CTE]))(
    lambda spark, d: RP.rank_min(_dist(spark, d).select("technique", "mean_abs_dmu"), "mean_abs_dmu", "rank_min"))
register("rank_average", with_panel(
    "SELECT technique, " + rd("mean_abs_dmu") + ", rank() OVER (ORDER BY round(mean_abs_dmu, 1) DESC) + "
    "(count(*) OVER (PARTITION BY round(mean_abs_dmu, 1)) - 1) / 2.0 AS rank_avg FROM ds", [_LONG, _DIST_CTE]))(
    lambda spark, d: RP.rank_average(_dist(spark, d).select("technique", "mean_abs_dmu").withColumn(
        "_r1", F.round("mean_abs_dmu", 1)), "_r1", "rank_avg").drop("_r1"))

register("minmax_normalize", with_panel(
    "SELECT technique, " + rd("mean_abs_dmu") + ", " + rd(
        "CASE WHEN max(mean_abs_dmu) OVER () = min(mean_abs_dmu) OVER () THEN 0.0 ELSE (mean_abs_dmu - min(mean_abs_dmu) OVER ()) / "
        "(max(mean_abs_dmu) OVER () - min(mean_abs_dmu) OVER ()) END", "mm") + " FROM ds", [_LONG, _DIST_CTE]))(
    lambda spark, d: minmax_normalize(_dist(spark, d).select("technique", "mean_abs_dmu"), "mean_abs_dmu", "mm"))

register("top_k_pairs", with_panel(
    "SELECT technique, var_i, var_j, " + rd("r") + ", CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY "
    "abs(r) DESC, var_i, var_j) AS k FROM pr) WHERE k <= 5",
    [("pr", " UNION ALL ".join(f"SELECT technique, '{a}' AS var_i, '{b}' AS var_j, corr({a}, {b}) AS r FROM panel GROUP BY technique"
                               for n, a in enumerate(V) for b in V[n + 1:]))]))(
    lambda spark, d: _topk(spark, d))


def _topk(spark, d):
    from pyspark.sql import Window

    from fidelis.operators.dependency import corr_pearson

    r = corr_pearson(load_panel(spark, d), V, ["technique"], min_periods=False)
    w = Window.partitionBy("technique").orderBy(F.desc(F.abs("r")), "var_i", "var_j")  # p^2 rows per technique
    return r.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("technique", "var_i", "var_j", "r", "k")


register("pivot_wide", with_panel(
    "SELECT variable, " + ", ".join(rd(f"avg(CASE WHEN technique = '{t}' THEN value END)", t.lower()) for t in
                                    ["REAL", "SYN_SAME", "SYN_NOISY", "SYN_INDEP"]) + " FROM long GROUP BY variable", [_LONG]))(
    lambda spark, d: M.continuous_summary(load_panel(spark, d), V).groupBy("variable").pivot(
        "technique", ["REAL", "SYN_SAME", "SYN_NOISY", "SYN_INDEP"]).agg(F.first("mean")).select(
        "variable", *[F.col(t).alias(t.lower()) for t in ["REAL", "SYN_SAME", "SYN_NOISY", "SYN_INDEP"]]))

register("sort_real_first", with_panel(
    "SELECT technique, variable, " + rd("avg(value)", "mean") + " FROM long GROUP BY technique, variable", [_LONG]))(
    lambda spark, d: sort_real_first(M.continuous_summary(load_panel(spark, d), V).select("technique", "variable", "mean")))


# ------------------------------------------------------------------ overall ranking of the panel's techniques
def path_inputs(pls):
    return RP.direction_rank(RP.vs_real(QM.MS.sheet(pls, "paths", "beta").select(*DS, "key1", "key2", "value"),
                                        ["key1", "key2"], "value"), "key1").select(
        "technique", F.col("direction_share").alias("direction"), F.coalesce("rank_rho", F.lit(0.0)).alias("rank_rho"))


def latent_inputs(pls):
    return RP.vs_real(QM.MS.sheet(pls, "construct_corr", "r").filter("key1 < key2").select(*DS, "key1", "key2", "value"),
                      ["key1", "key2"], "value").groupBy("technique").agg(F.avg("abs_delta").alias("latent_err"))


def htmt_inputs(spark, d):
    return RP.grid_rmse(RP.vs_real(QM._htmt(spark, d), ["construct_a", "construct_b"], "htmt")).select("technique", F.col("rmse").alias("htmt_rmse"))


def privacy_inputs(p):
    """Exact matches, membership inference, distance to the nearest REAL row and its 5th percentile, per technique."""
    nn = materialise(PV.nn_distances(p, V, 1), "nn")
    per_run = PV.exact_match_rate(p, V).join(PV.membership_proxy(p, nn, V).select(*DS, "membership_inference"), DS) \
        .join(PV.nn_distance_mean(nn), DS).join(PV.dcr(nn).select(*DS, "dcr_p05"), DS)
    return per_run.groupBy("technique").agg(*[F.avg(c).alias(c) for c in ["exact_match_rate", "membership_inference", "nn_distance_mean", "dcr_p05"]])


def _rank_inputs(spark, d):
    """Component inputs measured on the panel, one row per technique.  CB-SEM fit is not measured; its part is left
    out and the other weights scaled (see ``parts_used``)."""
    p = load_panel(spark, d, extended=True, with_row_id=True)
    dist = M.dist_summary(p, V, ["o1", "sens"])
    cont = dist.filter("variable_type = 'continuous'").select("technique", F.col("mean_abs_dmu").alias("e_mu"),
                                                              F.col("mean_abs_dsd").alias("e_sig"),
                                                              F.col("mean_adherence").alias("cont_adherence"))
    cat = dist.filter("variable_type <> 'continuous'").select("technique", F.col("mean_adherence").alias("cat_adherence"))
    pls = QM._pls(spark, d)
    paths, lat = path_inputs(pls), latent_inputs(pls)
    cov = pair_delta(covariate_corr(p, MEASUREMENT)).filter("var_i <> var_j").groupBy("technique").agg(
        F.avg("abs_delta").alias("covariate_err"))
    load = RP.vs_real(QM.MS.sheet(pls, "loadings", "loading").select(*DS, "key1", "key2", "value"), ["key1", "key2"], "value") \
        .groupBy("technique", "key2").agg(F.avg("abs_delta").alias("m")).groupBy("technique").agg(F.avg("m").alias("loading_err"))
    rel = RP.vs_real(QM.MS.sheet(pls, "reliability").filter(F.col("metric").isin("rhoC", "AVE", "rhoA")).select(
        *DS, "key1", "metric", "value"), ["key1", "metric"], "value").groupBy("technique").agg(F.avg("abs_delta").alias("reliability_err"))
    ht, priv = htmt_inputs(spark, d), privacy_inputs(p)
    t = cont.join(cat, "technique").join(paths, "technique").join(lat, "technique").join(cov, "technique") \
        .join(load, "technique").join(rel, "technique").join(ht, "technique").join(priv, "technique")
    t = t.filter("technique <> 'REAL'").select("technique", *[c for c in RK.INPUTS if c in t.columns])
    return materialise(t, "rank-inputs")


register("join_inner_components")(_rank_inputs)
register("rank_overall")(lambda spark, d: RK.rank_overall(_rank_inputs(spark, d), compat=True))
register("score_path")(lambda spark, d: RK.component_scores(path_inputs(QM._pls(spark, d))))
register("score_latent")(lambda spark, d: RK.component_scores(latent_inputs(QM._pls(spark, d))))
register("score_htmt", with_panel("SELECT s.technique, " + rd("-sqrt(avg((s.m - r.m) * (s.m - r.m)))", "htmt_score")
    + " FROM htm s JOIN htm r ON r.technique = 'REAL' AND r.construct_a = s.construct_a AND r.construct_b = s.construct_b "
    "WHERE s.technique <> 'REAL' AND s.m - r.m IS NOT NULL GROUP BY s.technique", QM._htmt_sql() + [QM._HT_TM]))(
    lambda spark, d: RK.component_scores(htmt_inputs(spark, d)))
_PRIV = {"exact_match_rate": "-", "membership_inference": "-", "nn_distance_mean": "", "dcr_p05": ""}
_mm = "CASE WHEN max({0}) OVER () = min({0}) OVER () THEN 0.0 ELSE ({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) END".format
register("score_privacy", with_panel(
    "SELECT technique, " + rd("(" + " + ".join(_mm(f"({sign}{c})") for c, sign in _PRIV.items()) + ") / 4", "privacy_score") + " FROM pv",
    [*QP._MP_CTES,
     ("em", "SELECT technique, avg(e) AS exact_match_rate FROM (SELECT s.technique, s.replicate, avg(CASE WHEN h.hit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS e FROM panel s "
            "LEFT JOIN (SELECT DISTINCT " + ", ".join(V) + ", 1 AS hit FROM panel WHERE technique = 'REAL') h ON " + " AND ".join(f"s.{v} = h.{v}" for v in V)
            + " WHERE s.technique <> 'REAL' GROUP BY ALL) GROUP BY technique"),
     ("mm", "SELECT technique, avg(membership_inference) AS membership_inference FROM mp GROUP BY technique"),
     ("nm", "SELECT technique, avg(m) AS nn_distance_mean, avg(p) AS dcr_p05 FROM (SELECT technique, replicate, avg(d1) AS m, quantile_cont(d1, 0.05) AS p FROM mn GROUP BY ALL) GROUP BY technique"),
     ("pv", "SELECT * FROM em JOIN mm USING (technique) JOIN nm USING (technique)")], extended=True, with_row_id=True))(
    lambda spark, d: RK.component_scores(privacy_inputs(load_panel(spark, d, extended=True, with_row_id=True))))
