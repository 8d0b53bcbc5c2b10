"""Registered queries: moments, correlations and their comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import dependency as D
from fidelis.plans.registry import rd, register
from fidelis.session import materialise
from fidelis.sources.panel import MEASUREMENT, load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]
SP_VARS = list(V)


def _pairs_sql(src, by, variables, stats=("corr",)):
    byl = ", ".join(by)
    parts = []
    for a, b in D.pairs(variables):
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        cols = [f"'{a}' AS var_i", f"'{b}' AS var_j", f"count(CASE WHEN {both} THEN 1 END) AS n", "count(*) AS n_rows"]
        if "full" in stats:
            cols += [f"avg(CASE WHEN {both} THEN {a} END) AS mean_i", f"avg(CASE WHEN {both} THEN {b} END) AS mean_j",
                     f"stddev_samp(CASE WHEN {both} THEN {a} END) AS sd_i",
                     f"stddev_samp(CASE WHEN {both} THEN {b} END) AS sd_j", f"covar_samp({a}, {b}) AS cov"]
        cols.append(f"corr({a}, {b}) AS corr")
        parts.append(f"SELECT {byl}, {', '.join(cols)} FROM {src} GROUP BY {byl}")
    return "\nUNION ALL\n".join(parts)


_MINP = "CASE WHEN n >= greatest(10, CAST(floor(n_rows * 0.2) AS BIGINT)) THEN corr END"


def _spearman_sql(src, by, variables):
    """Average-tie ranks within each pair's complete rows, then Pearson."""
    byl = ", ".join(by)
    parts = []
    for a, b in D.pairs(variables):
        def avg_rank(x):
            return (f"(rank() OVER (PARTITION BY {byl} ORDER BY {x}) + rank() OVER (PARTITION BY {byl} ORDER BY {x}) "
                    f"+ count(*) OVER (PARTITION BY {byl}, {x}) - 1) / 2.0")
        ranked = (f"SELECT {byl}, {avg_rank(a)} AS ra, {avg_rank(b)} AS rb FROM {src} "
                  f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
        parts.append(f"SELECT {byl}, '{a}' AS var_i, '{b}' AS var_j, count(*) AS n, corr(ra, rb) AS corr "
                     f"FROM ({ranked}) GROUP BY {byl}")
    return (f"SELECT s.*, t.n_rows FROM ({' UNION ALL '.join(parts)}) s JOIN "
            f"(SELECT {byl}, count(*) AS n_rows FROM {src} GROUP BY {byl}) t USING ({byl})")


# ------------------------------------------------------------------ moments / pearson / spearman
register("moments", with_panel(
    "SELECT technique, replicate, var_i, var_j, n, " + ", ".join(rd(c) for c in
                                                                  ["mean_i", "mean_j", "sd_i", "sd_j", "cov", "corr"])
    + ", n_rows FROM m", [("m", _pairs_sql("panel", DS, V, ("full",)))], extended=True))(
    lambda spark, d: D.moments(load_panel(spark, d, extended=True), V))

register("corr_pearson", with_panel(
    "SELECT technique, replicate, var_i, var_j, n, " + rd(_MINP, "r") + " FROM m",
    [("m", _pairs_sql("panel", DS, V))], extended=True))(
    lambda spark, d: D.corr_pearson(load_panel(spark, d, extended=True), V))

register("corr_spearman", with_panel(
    "SELECT technique, replicate, var_i, var_j, n, " + rd(_MINP, "r") + " FROM m",
    [("m", _spearman_sql("panel", DS, SP_VARS))], extended=True, with_row_id=True))(
    lambda spark, d: D.corr_spearman(load_panel(spark, d, extended=True, with_row_id=True), SP_VARS))


# ------------------------------------------------------------------ corr_error / topk
def _pearson_spearman(spark, d):
    """Both tables written (p^2 rows a dataset): every comparison reads them, and none repeats the pass over rows or the ranks."""
    p = load_panel(spark, d, with_row_id=True)
    return materialise(D.corr_pearson(p, V), "pearson"), materialise(D.corr_spearman(p, V), "spearman")


_ERR_CTES = [
    ("pm", _pairs_sql("panel", DS, V)),
    ("pr", f"SELECT technique, replicate, var_i, var_j, {_MINP} AS r FROM pm"),
    ("sm", _spearman_sql("panel", DS, V)),
    ("sr", f"SELECT technique, replicate, var_i, var_j, {_MINP} AS r FROM sm"),
    ("pd", "SELECT s.technique, s.replicate, s.r, x.r AS r_real, s.r - x.r AS d FROM pr s LEFT JOIN pr x "
           "ON x.technique = 'REAL' AND s.var_i = x.var_i AND s.var_j = x.var_j WHERE s.technique <> 'REAL'"),
    ("sd", "SELECT s.technique, s.replicate, s.r - x.r AS d FROM sr s LEFT JOIN sr x "
           "ON x.technique = 'REAL' AND s.var_i = x.var_i AND s.var_j = x.var_j WHERE s.technique <> 'REAL'"),
    ("pe", "SELECT technique, replicate, avg(abs(d)) AS pearson_mae, sqrt(2 * sum(d * d)) AS pearson_fro, "
           "CASE WHEN least(count(r), count(r_real)) > 10 THEN corr(CASE WHEN d IS NOT NULL THEN r END, "
           "CASE WHEN d IS NOT NULL THEN r_real END) END AS mantel_flat_corr FROM pd GROUP BY technique, replicate"),
    ("se", "SELECT technique, replicate, avg(abs(d)) AS spearman_mae, sqrt(2 * sum(d * d)) AS spearman_fro "
           "FROM sd GROUP BY technique, replicate"),
    ("err", "SELECT pe.*, se.spearman_mae, se.spearman_fro FROM pe LEFT JOIN se USING (technique, replicate)"),
]
register("corr_error", with_panel(
    "SELECT technique, replicate, " + ", ".join(rd(c) for c in
                                                ["pearson_mae", "pearson_fro", "spearman_mae", "spearman_fro", "mantel_flat_corr"])
    + " FROM err", _ERR_CTES, with_row_id=True))(
    lambda spark, d: D.corr_error(*_pearson_spearman(spark, d)))

_TOPK_CTES = [
    ("pm", _pairs_sql("panel", DS, V)),
    ("pr", f"SELECT technique, replicate, var_i, var_j, {_MINP} AS r FROM pm"),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY technique, replicate ORDER BY abs(r) DESC, var_i, var_j) AS k "
           "FROM pr WHERE r IS NOT NULL"),
    ("topr", "SELECT var_i, var_j, r AS r_real FROM rk WHERE technique = 'REAL' AND k <= 30"),
    ("tops", "SELECT technique, replicate, var_i, var_j FROM rk WHERE technique <> 'REAL' AND k <= 30"),
    ("tk", "SELECT s.technique, s.replicate, CAST(count(ts.var_i) AS DOUBLE) / count(*) AS topk_overlap_rate, "
           "avg(CASE WHEN sign(coalesce(s.r, 0.0)) = sign(t.r_real) THEN 1.0 ELSE 0.0 END) AS topk_sign_agreement, "
           "count(*) AS topk_k FROM pr s JOIN topr t ON s.var_i = t.var_i AND s.var_j = t.var_j "
           "LEFT JOIN tops ts ON ts.technique = s.technique AND ts.replicate = s.replicate AND ts.var_i = s.var_i "
           "AND ts.var_j = s.var_j WHERE s.technique <> 'REAL' GROUP BY s.technique, s.replicate"),
]
register("topk_interactions", with_panel(
    "SELECT technique, replicate, " + rd("topk_overlap_rate") + ", " + rd("topk_sign_agreement") + ", topk_k FROM tk",
    _TOPK_CTES))(
    lambda spark, d: D.topk_interactions(D.corr_pearson(load_panel(spark, d), V)))

register("eigen_spectrum")(
    lambda spark, d: D.eigen_spectrum(D.corr_pearson(load_panel(spark, d), V), V))


def _dependency_metrics(spark, d, eigen=True):
    pear, spear = _pearson_spearman(spark, d)
    per_run = D.corr_error(pear, spear).join(D.topk_interactions(pear), DS, "full_outer")
    cols = ["pearson_mae", "pearson_fro", "spearman_mae", "spearman_fro", "mantel_flat_corr",
            "topk_overlap_rate", "topk_sign_agreement"]
    if eigen:
        dist = D.eigen_spectrum(pear, V).filter("technique <> 'REAL'")
        per_run = per_run.join(dist.select(*DS, "eig_l2", "eig_cosine"), DS, "full_outer")
        cols += ["eig_l2", "eig_cosine"]
    return per_run.groupBy("technique").agg(F.countDistinct("replicate").alias("runs_used"),
                                            *[F.avg(c).alias(c) for c in cols])


register("dependency_metrics_matrix", with_panel(
    "SELECT technique, count(DISTINCT replicate) AS runs_used, " + ", ".join(rd(f"avg({c})", c) for c in [
        "pearson_mae", "pearson_fro", "spearman_mae", "spearman_fro", "mantel_flat_corr",
        "topk_overlap_rate", "topk_sign_agreement"])
    + " FROM err FULL OUTER JOIN tk USING (technique, replicate) GROUP BY technique",
    _ERR_CTES + [(n, q) for n, q in _TOPK_CTES if n not in ("pm", "pr")], with_row_id=True))(
    lambda spark, d: _dependency_metrics(spark, d, eigen=False))
# with the eigen distances, which SQL cannot rebuild
register("dependency_metrics")(_dependency_metrics)

# ------------------------------------------------------------------ covariate family (composites)
_CONS = list(MEASUREMENT)


def _comp_sql():
    cols = []
    for name, items in MEASUREMENT.items():
        tot = " + ".join(f"coalesce({c}, 0.0)" for c in items)
        cnt = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in items)
        cols.append(f"CASE WHEN {cnt} > 0 THEN ({tot}) / ({cnt}) END AS {name}")
    return f"SELECT technique, replicate, {', '.join(cols)} FROM panel"


_COV_CTES = [
    ("comp", _comp_sql()),
    ("cm", _pairs_sql("comp", DS, _CONS)),
    ("cc", "SELECT technique, replicate, var_j AS var_i, var_i AS var_j, corr AS r FROM cm UNION ALL "
           "SELECT DISTINCT technique, replicate, v AS var_i, v AS var_j, 1.0 AS r FROM comp, "
           f"(SELECT unnest([{', '.join(repr(c) for c in _CONS)}]) AS v)"),
    ("tm", "SELECT technique, var_i, var_j, avg(r) AS r_syn, min(r) AS r_min, max(r) AS r_max FROM cc "
           "GROUP BY technique, var_i, var_j"),
    ("dl", "SELECT s.technique, s.var_i, s.var_j, x.r_syn AS r_real, s.r_syn, s.r_min, s.r_max, s.r_syn - x.r_syn AS delta, "
           "abs(s.r_syn - x.r_syn) AS abs_delta FROM tm s JOIN tm x ON x.technique = 'REAL' AND s.var_i = x.var_i "
           "AND s.var_j = x.var_j WHERE s.technique <> 'REAL'"),
]


def _cov_delta(spark, d):
    return D.pair_delta(D.covariate_corr(load_panel(spark, d, extended=True), MEASUREMENT))


register("covariate_corr", with_panel(
    "SELECT technique, replicate, var_i, var_j, " + rd("r") + " FROM cc", _COV_CTES[:3], extended=True))(
    lambda spark, d: D.covariate_corr(load_panel(spark, d, extended=True), MEASUREMENT))

register("covariate_delta", with_panel(
    "SELECT technique, var_i, var_j, " + ", ".join(rd(c) for c in ["r_real", "r_syn", "r_min", "r_max", "delta", "abs_delta"])
    + " FROM dl WHERE var_i <> var_j", _COV_CTES, extended=True))(
    lambda spark, d: _cov_delta(spark, d).filter(F.col("var_i") != F.col("var_j")))

register("covariate_summary", with_panel(
    "SELECT technique, " + rd("avg(abs_delta)", "mean_abs_delta") + ", " + rd("median(abs_delta)", "median_abs_delta")
    + ", " + rd("max(abs_delta)", "max_abs_delta") + " FROM dl WHERE var_i <> var_j AND abs_delta IS NOT NULL GROUP BY technique",
    _COV_CTES, extended=True))(lambda spark, d: D.covariate_summary(_cov_delta(spark, d)))

register("covariate_delta_matrix", with_panel(
    "SELECT variable, technique, " + rd("avg(abs_delta)", "mean_abs_delta") + " FROM ("
    "SELECT technique, var_i AS variable, abs_delta FROM dl WHERE var_i <> var_j UNION ALL "
    "SELECT technique, var_j, abs_delta FROM dl WHERE var_i <> var_j) GROUP BY variable, technique",
    _COV_CTES, extended=True))(lambda spark, d: D.covariate_delta_matrix(_cov_delta(spark, d)))

register("covariate_range", with_panel(
    "SELECT technique, var_i, var_j, " + ", ".join(rd(c) for c in ["r_min", "r_max", "r_real"])
    + ", r_real BETWEEN r_min AND r_max AS contains_real FROM dl WHERE var_i <> var_j", _COV_CTES, extended=True))(
    lambda spark, d: D.covariate_range(_cov_delta(spark, d)))

register("corr_diff", with_panel(
    "SELECT s.technique, s.var_i, s.var_j, " + rd("x.corr - s.corr", "diff")
    + " FROM m s JOIN m x ON x.technique = 'REAL' AND s.var_i = x.var_i AND s.var_j = x.var_j WHERE s.technique <> 'REAL'",
    # one scan: all correlations of a technique in one row
    [("g", "SELECT technique, " + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a, b in D.pairs(V)) + " FROM panel GROUP BY technique"),
     ("m", " UNION ALL ".join(f"SELECT technique, '{a}' AS var_i, '{b}' AS var_j, {a}_{b} AS corr FROM g" for a, b in D.pairs(V)))]))(
    lambda spark, d: D.corr_diff(load_panel(spark, d), V))
