"""Registered queries: marginal-distribution family."""

from __future__ import annotations

from fidelis.functions.stats import kolmogorov_sf_sql
from fidelis.operators import marginal as M
from fidelis.plans.registry import rd, register
from fidelis.plans.sqlgen import melt_sql
from fidelis.sources.panel import VARIABLES as V
from fidelis.sources.panel import load_panel, with_panel

CAT = ["o1", "sens"]
CAT_ALL = ["o1", "sens", "l_linenumber", "l_returnflag"]


def _long(ids=("technique",), variables=V, dtype="DOUBLE", drop_nulls=True, src="panel"):
    return ("long", melt_sql(src, list(ids), variables, dtype=dtype, drop_nulls=drop_nulls))


# ------------------------------------------------------------------ sample_size
register("sample_size", with_panel(
    "SELECT technique, count(*) AS n_rows, count(DISTINCT replicate) AS n_replicates, "
    + rd("count(*) / count(DISTINCT replicate)", "rows_per_replicate")
    + " FROM panel GROUP BY technique", extended=True))(
    lambda spark, d: M.sample_size(load_panel(spark, d, extended=True)))

# ------------------------------------------------------------------ continuous_summary
register("continuous_summary", with_panel(
    "SELECT technique, variable, count(value) AS n, " + ", ".join([
        rd("avg(value)", "mean"), rd("stddev_samp(value)", "sd"), rd("min(value)", "min"), rd("max(value)", "max")])
    + " FROM long GROUP BY technique, variable", [_long()]))(
    lambda spark, d: M.continuous_summary(load_panel(spark, d), V))

# ------------------------------------------------------------------ boundary_adherence
_BOUNDS = ("bounds", "SELECT variable, min(value) AS lo, max(value) AS hi FROM long WHERE technique = 'REAL' GROUP BY variable")
register("boundary_adherence", with_panel(
    "SELECT l.technique, l.variable, "
    + rd("avg(CASE WHEN l.value BETWEEN b.lo AND b.hi THEN 1.0 ELSE 0.0 END)", "boundary_adherence")
    + " FROM long l JOIN bounds b ON l.variable = b.variable GROUP BY l.technique, l.variable",
    [_long(), _BOUNDS]))(
    lambda spark, d: M.boundary_adherence(load_panel(spark, d), V))

# ------------------------------------------------------------------ category_adherence
register("category_adherence", with_panel(
    "SELECT l.technique, l.variable, "
    + rd("avg(CASE WHEN c.hit IS NOT NULL THEN 1.0 ELSE 0.0 END)", "category_adherence")
    + " FROM long l LEFT JOIN cats c ON l.variable = c.variable AND l.value = c.value GROUP BY l.technique, l.variable",
    [_long(variables=CAT_ALL, dtype="VARCHAR"),
     ("cats", "SELECT DISTINCT variable, value, 1 AS hit FROM long WHERE technique = 'REAL'")], extended=True))(
    lambda spark, d: M.category_adherence(load_panel(spark, d, extended=True), CAT_ALL))

# ------------------------------------------------------------------ boundary_diff
_SUMM = ("summ", "SELECT technique, variable, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, "
                 "min(value) AS mn, max(value) AS mx FROM long GROUP BY technique, variable")
register("boundary_diff", with_panel(
    "SELECT s.technique, s.variable, s.n, " + ", ".join([
        rd("s.mean", "mean"), rd("s.sd", "sd"), rd("s.mn", "min"), rd("s.mx", "max"),
        rd("s.mean - r.mean", "d_mean"), rd("s.sd - r.sd", "d_sd")])
    + " FROM summ s JOIN summ r ON s.variable = r.variable AND r.technique = 'REAL'",
    [_long(), _SUMM]))(
    lambda spark, d: M.boundary_diff(load_panel(spark, d), V))

# ------------------------------------------------------------------ missingness
register("missingness", with_panel(
    "SELECT technique, variable, " + rd("avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100.0", "missing_pct")
    + " FROM long GROUP BY technique, variable",
    [_long(variables=V + ["o1"], drop_nulls=False)], extended=True))(
    lambda spark, d: M.missingness(load_panel(spark, d, extended=True), V + ["o1"]))

# ------------------------------------------------------------------ range_sanity
register("range_sanity", with_panel(
    "SELECT s.technique, s.variable, " + ", ".join([
        rd("r.mn", "real_min"), rd("r.mx", "real_max"), rd("s.mn", "syn_min"), rd("s.mx", "syn_max")])
    + ", (round(s.mn, 2) = round(r.mn, 2) AND round(s.mx, 2) = round(r.mx, 2)) AS same_as_real"
    + " FROM summ s JOIN summ r ON s.variable = r.variable AND r.technique = 'REAL'",
    [_long(), _SUMM]))(
    lambda spark, d: M.range_sanity(load_panel(spark, d), V))

# ------------------------------------------------------------------ dist_summary (flagship)
DIST_SUMMARY_SQL = with_panel(
    "SELECT s.technique, 'continuous' AS variable_type, "
    + rd("avg(CASE WHEN r.sd > 0 THEN abs(s.mean - r.mean) / r.sd END)", "mean_abs_dmu") + ", "
    + rd("avg(CASE WHEN r.sd > 0 THEN abs(s.sd - r.sd) / r.sd END)", "mean_abs_dsd") + ", "
    + rd("avg(ba.boundary_adherence)", "mean_adherence")
    + " FROM summ s JOIN summ r ON s.variable = r.variable AND r.technique = 'REAL'"
    " JOIN ba ON ba.technique = s.technique AND ba.variable = s.variable GROUP BY s.technique\n"
    "UNION ALL\n"
    "SELECT technique, 'ordinal/categorical' AS variable_type, CAST(NULL AS DOUBLE) AS mean_abs_dmu, "
    "CAST(NULL AS DOUBLE) AS mean_abs_dsd, " + rd("avg(category_adherence)", "mean_adherence")
    + " FROM ca GROUP BY technique",
    [_long(), _SUMM, _BOUNDS,
     ("ba", "SELECT l.technique, l.variable, avg(CASE WHEN l.value BETWEEN b.lo AND b.hi THEN 1.0 ELSE 0.0 END) "
            "AS boundary_adherence FROM long l JOIN bounds b ON l.variable = b.variable GROUP BY l.technique, l.variable"),
     ("clong", melt_sql("panel", ["technique"], CAT, dtype="VARCHAR")),
     ("cats", "SELECT DISTINCT variable, value, 1 AS hit FROM clong WHERE technique = 'REAL'"),
     ("ca", "SELECT l.technique, l.variable, avg(CASE WHEN c.hit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS category_adherence"
            " FROM clong l LEFT JOIN cats c ON l.variable = c.variable AND l.value = c.value"
            " GROUP BY l.technique, l.variable")],
    extended=True)


def dist_summary_query(spark, d):
    return M.dist_summary(load_panel(spark, d, extended=True), V, CAT)


register("dist_summary", DIST_SUMMARY_SQL)(dist_summary_query)

# ------------------------------------------------------------------ value_proportions
register("value_proportions", with_panel(
    "SELECT technique, variable, value, " + rd("count(*) / sum(count(*)) OVER (PARTITION BY technique, variable)", "share")
    + " FROM long GROUP BY technique, variable, value",
    [_long(variables=["o1", "l_returnflag"], dtype="VARCHAR")], extended=True))(
    lambda spark, d: M.value_proportions(load_panel(spark, d, extended=True), ["o1", "l_returnflag"]))

# ------------------------------------------------------------------ skew_kurtosis
register("skew_kurtosis", with_panel(
    "SELECT technique, variable, n, "
    + rd("g1 * sqrt(n * (n - 1.0)) / (n - 2.0)", "skewness") + ", "
    + rd("((n + 1.0) * g2 + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0))", "kurtosis")
    + " FROM (SELECT technique, variable, count(*) AS n, avg(dv*dv*dv) / pow(avg(dv*dv), 1.5) AS g1, "
      "avg(dv*dv*dv*dv) / pow(avg(dv*dv), 2) - 3.0 AS g2 FROM ("
      "SELECT technique, variable, value - avg(value) OVER (PARTITION BY technique, variable) AS dv FROM long) "
      "GROUP BY technique, variable)",
    [_long()]))(
    lambda spark, d: M.skew_kurtosis(load_panel(spark, d), V))

# ------------------------------------------------------------------ describe_table
register("describe_table", with_panel(
    "SELECT technique, variable, count(value) AS n, " + ", ".join([
        rd("avg(value)", "mean"), rd("stddev_samp(value)", "sd"), rd("min(value)", "min"),
        rd("quantile_cont(value, 0.25)", "q25"), rd("quantile_cont(value, 0.5)", "q50"),
        rd("quantile_cont(value, 0.75)", "q75"), rd("max(value)", "max")])
    + " FROM long GROUP BY technique, variable", [_long()], extended=True))(
    lambda spark, d: M.describe_table(load_panel(spark, d, extended=True), V))


# ------------------------------------------------------------------ two-sample CDF family
def _grid_ctes(by):
    byl = ", ".join(by)
    sby = ", ".join(f"sm.{b}" for b in by)
    return [
        _long(ids=by),
        ("samples", f"SELECT DISTINCT {byl}, variable FROM long WHERE technique <> 'REAL'"),
        ("grid0",
         f"SELECT {byl}, variable, value AS x, CAST(0 AS BIGINT) AS w_r, count(*) AS w_s FROM long "
         f"WHERE technique <> 'REAL' GROUP BY {byl}, variable, value\nUNION ALL\n"
         f"SELECT {sby}, r.variable, r.value AS x, count(*) AS w_r, CAST(0 AS BIGINT) AS w_s FROM long r "
         f"JOIN samples sm ON r.variable = sm.variable WHERE r.technique = 'REAL' GROUP BY {sby}, r.variable, r.value"),
        ("grid", f"SELECT {byl}, variable, x, sum(w_r) AS w_r, sum(w_s) AS w_s FROM grid0 GROUP BY {byl}, variable, x"),
        ("cdf",
         f"SELECT *, CAST(sum(w_r) OVER w AS DOUBLE) / CAST(sum(w_r) OVER wa AS DOUBLE) AS f_r, "
         f"CAST(sum(w_s) OVER w AS DOUBLE) / CAST(sum(w_s) OVER wa AS DOUBLE) AS f_s, "
         f"sum(w_r) OVER wa AS n_r, sum(w_s) OVER wa AS n_s, lead(x) OVER w AS x_next FROM grid "
         f"WINDOW w AS (PARTITION BY {byl}, variable ORDER BY x), wa AS (PARTITION BY {byl}, variable)"),
    ]


register("wasserstein_1d", with_panel(
    "SELECT technique, variable, " + rd("coalesce(sum(abs(f_r - f_s) * (x_next - x)), 0.0)", "wasserstein")
    + " FROM cdf GROUP BY technique, variable", _grid_ctes(["technique"])))(
    lambda spark, d: M.wasserstein_1d(load_panel(spark, d), V))

_LAM = "sqrt(CAST(n_r AS DOUBLE) * CAST(n_s AS DOUBLE) / (CAST(n_r AS DOUBLE) + CAST(n_s AS DOUBLE))) * d"
register("ks_two_sample", with_panel(
    "SELECT technique, replicate, variable, "
    + rd("CASE WHEN n_r >= 20 AND n_s >= 20 THEN d END", "ks_stat") + ", "
    + rd(f"CASE WHEN n_r >= 20 AND n_s >= 20 THEN {kolmogorov_sf_sql(_LAM)} END", "ks_pvalue")
    + " FROM (SELECT technique, replicate, variable, max(abs(f_r - f_s)) AS d, max(n_r) AS n_r, max(n_s) AS n_s "
      "FROM cdf GROUP BY technique, replicate, variable)",
    _grid_ctes(["technique", "replicate"])))(
    lambda spark, d: M.ks_two_sample(load_panel(spark, d), V))


def _share_ctes(by, variables, na=None):
    byl = ", ".join(by)
    sby = ", ".join(f"sm.{b}" for b in by)
    if na is None:
        lng = melt_sql("panel", by, variables, dtype="VARCHAR")
    else:
        lng = melt_sql("panel", by, variables, dtype="VARCHAR", drop_nulls=False, value="v0")
        lng = f"SELECT {byl}, variable, coalesce(v0, '{na}') AS value FROM ({lng})"
    return [
        ("long", lng),
        ("shares", f"SELECT {byl}, variable, value, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER "
                   f"(PARTITION BY {byl}, variable) AS p FROM long GROUP BY {byl}, variable, value"),
        ("samples", f"SELECT DISTINCT {byl}, variable FROM shares WHERE technique <> 'REAL'"),
        ("rrep", f"SELECT {sby}, r.variable, r.value, r.p AS p_r FROM shares r JOIN samples sm "
                 f"ON r.variable = sm.variable WHERE r.technique = 'REAL'"),
        ("pq", "SELECT " + ", ".join(f"coalesce(s.{b}, rr.{b}) AS {b}" for b in by)
         + ", coalesce(s.variable, rr.variable) AS variable, coalesce(rr.p_r, 0.0) AS p_r, coalesce(s.p, 0.0) AS p_s "
         f"FROM (SELECT * FROM shares WHERE technique <> 'REAL') s FULL OUTER JOIN rrep rr ON "
         + " AND ".join(f"s.{b} = rr.{b}" for b in by) + " AND s.variable = rr.variable AND s.value = rr.value"),
    ]


_JS_TERM = ("CASE WHEN p_r > 0 THEN p_r * ln(p_r / ((p_r + p_s) / 2)) ELSE 0.0 END + "
            "CASE WHEN p_s > 0 THEN p_s * ln(p_s / ((p_r + p_s) / 2)) ELSE 0.0 END")
JS_VARS = ["o1", "sens", "l_returnflag"]
register("js_distance", with_panel(
    "SELECT technique, variable, " + rd(f"sqrt(greatest(sum({_JS_TERM}) / 2, 0.0))", "js_distance")
    + " FROM pq GROUP BY technique, variable", _share_ctes(["technique"], JS_VARS), extended=True))(
    lambda spark, d: M.js_distance(load_panel(spark, d, extended=True), JS_VARS))

TVD_VARS = ["o1", "sens", "l_returnflag", "l_linestatus"]
register("tvd_categorical", with_panel(
    "SELECT technique, replicate, variable, " + rd("sum(abs(p_r - p_s)) / 2", "tvd")
    + " FROM pq GROUP BY technique, replicate, variable",
    _share_ctes(["technique", "replicate"], TVD_VARS, na="__NA__"), extended=True))(
    lambda spark, d: M.tvd_categorical(load_panel(spark, d, extended=True), TVD_VARS))


def _hist_ctes(by):
    byl = ", ".join(by)
    lb = ", ".join(f"l.{b}" for b in by)
    on = " AND ".join(f"l.{b} = g.{b}" for b in by)
    gby = ", ".join(f"g.{b}" for b in by)
    binx = "least(floor((value - g.lo) * (20.0 / (g.hi - g.lo))), 19)"
    return [
        _long(ids=by),
        ("rst", "SELECT variable, min(value) AS r_lo, max(value) AS r_hi, count(*) AS n_r FROM long "
                "WHERE technique = 'REAL' GROUP BY variable"),
        ("sst", f"SELECT {byl}, variable, min(value) AS s_lo, max(value) AS s_hi, count(*) AS n_s FROM long "
                f"WHERE technique <> 'REAL' GROUP BY {byl}, variable"),
        ("rng", f"SELECT {', '.join('s.' + b for b in by)}, s.variable, n_r, n_s, least(r_lo, s_lo) AS lo, "
                f"greatest(r_hi, s_hi) AS hi FROM sst s JOIN rst r ON s.variable = r.variable"),
        ("valid", "SELECT * FROM rng WHERE n_r >= 20 AND n_s >= 20 AND hi > lo"),
        ("sc", f"SELECT {lb}, l.variable, {binx} AS bin, count(*) AS c_s FROM long l JOIN valid g ON {on} "
               f"AND l.variable = g.variable WHERE l.technique <> 'REAL' GROUP BY ALL"),
        ("rc", f"SELECT {gby}, g.variable, {binx} AS bin, count(*) AS c_r FROM long l JOIN valid g "
               f"ON l.variable = g.variable WHERE l.technique = 'REAL' GROUP BY ALL"),
        ("ov", f"SELECT {', '.join(f'coalesce(sc.{b}, rc.{b}) AS {b}' for b in by)}, "
               "coalesce(sc.variable, rc.variable) AS variable, coalesce(sc.bin, rc.bin) AS bin, "
               "coalesce(c_r, 0) AS c_r, coalesce(c_s, 0) AS c_s FROM sc FULL OUTER JOIN rc ON "
               + " AND ".join(f"sc.{b} = rc.{b}" for b in by) + " AND sc.variable = rc.variable AND sc.bin = rc.bin"),
        ("hov", f"SELECT {', '.join('o.' + b for b in by)}, o.variable, sum(least(CAST(c_r AS DOUBLE) / v.n_r, "
                f"CAST(c_s AS DOUBLE) / v.n_s)) AS overlap FROM ov o JOIN valid v ON "
                + " AND ".join(f"o.{b} = v.{b}" for b in by) + f" AND o.variable = v.variable GROUP BY ALL"),
    ]


register("hist_overlap", with_panel(
    "SELECT r.technique, r.replicate, r.variable, " + rd("h.overlap", "overlap")
    + " FROM rng r LEFT JOIN hov h ON r.technique = h.technique AND r.replicate = h.replicate AND r.variable = h.variable",
    _hist_ctes(["technique", "replicate"])))(
    lambda spark, d: M.hist_overlap(load_panel(spark, d), V))

MM_CAT = ["o1", "sens", "l_returnflag"]


def _marginal_metrics_sql():
    by = ["technique", "replicate"]
    ks = _grid_ctes(by)[1:]  # reuse samples/grid/cdf on the shared long
    hist = _hist_ctes(by)[1:]
    share = [(f"t_{n}", q.replace("FROM long", "FROM tlong").replace("FROM shares", "FROM t_shares")
              .replace("JOIN samples", "JOIN t_samples").replace("JOIN rrep", "JOIN t_rrep"))
             for n, q in _share_ctes(by, MM_CAT, na="__NA__")[1:]]
    tl = melt_sql("panel", by, MM_CAT, dtype="VARCHAR", drop_nulls=False, value="v0")
    tlong = ("tlong", f"SELECT technique, replicate, variable, coalesce(v0, '__NA__') AS value FROM ({tl})")
    ctes = [_long(ids=by), *ks,
            ("ks", "SELECT technique, replicate, variable, CASE WHEN max(n_r) >= 20 AND max(n_s) >= 20 THEN max(abs(f_r - f_s)) END AS ks_stat, "
                   "max(n_r) AS n_r, max(n_s) AS n_s FROM cdf GROUP BY technique, replicate, variable"),
            ("ksp", "SELECT *, CASE WHEN n_r >= 20 AND n_s >= 20 THEN "
                    + kolmogorov_sf_sql(_LAM.replace(" * d", " * ks_stat")) + " END AS ks_pvalue FROM ks"),
            *[(n, q) for n, q in hist],
            ("hist", "SELECT r.technique, r.replicate, r.variable, h.overlap FROM rng r LEFT JOIN hov h "
                     "ON r.technique = h.technique AND r.replicate = h.replicate AND r.variable = h.variable"),
            tlong, *share,
            ("tvd", "SELECT technique, replicate, variable, sum(abs(p_r - p_s)) / 2 AS tvd FROM t_pq GROUP BY ALL"),
            ("run_num", "SELECT coalesce(k.technique, h.technique) AS technique, coalesce(k.replicate, h.replicate) AS replicate, "
                        "avg(ks_stat) AS ks_mean, avg(CASE WHEN ks_pvalue IS NOT NULL THEN CASE WHEN ks_pvalue < 0.05 THEN 1.0 ELSE 0.0 END END) AS ks_sig_frac, "
                        "avg(overlap) AS hist_overlap_mean FROM ksp k FULL OUTER JOIN hist h ON k.technique = h.technique "
                        "AND k.replicate = h.replicate AND k.variable = h.variable GROUP BY ALL"),
            ("run_cat", "SELECT technique, replicate, avg(tvd) AS tvd_cat_mean FROM tvd GROUP BY ALL"),
            ("runs", "SELECT coalesce(a.technique, b.technique) AS technique, coalesce(a.replicate, b.replicate) AS replicate, "
                     "ks_mean, ks_sig_frac, hist_overlap_mean, tvd_cat_mean FROM run_num a FULL OUTER JOIN run_cat b "
                     "ON a.technique = b.technique AND a.replicate = b.replicate")]
    final = ("SELECT technique, count(DISTINCT replicate) AS runs_used, " + ", ".join(
        rd(f"avg({c})", c) for c in ["ks_mean", "ks_sig_frac", "hist_overlap_mean", "tvd_cat_mean"])
        + " FROM runs GROUP BY technique")
    return with_panel(final, ctes, extended=True)


register("marginal_metrics", _marginal_metrics_sql())(
    lambda spark, d: M.marginal_metrics(load_panel(spark, d, extended=True), V, MM_CAT))
