"""Registered queries: disclosure risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import privacy as PV
from fidelis.operators.knn import knn_compared
from fidelis.operators.knn_approx import knn_approx
from fidelis.plans.registry import rd, register
from fidelis.session import materialise
from fidelis.sources.panel import QI_COLUMNS, SENSITIVE, load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]
NN_FEATURES = list(V)  # a row with a missing value has no distance
QI = list(QI_COLUMNS)


def _px(spark, d):
    return load_panel(spark, d, extended=True, with_row_id=True)


def _dist_sql(feats, a="s", b="r"):
    return "sqrt(" + " + ".join(f"({a}.{v} - {b}.{v}) * ({a}.{v} - {b}.{v})" for v in feats) + ")"


_NN_CTES = [
    ("rl", "SELECT * FROM panel WHERE technique = 'REAL'"),
    ("sy", "SELECT * FROM panel WHERE technique <> 'REAL'"),
    ("nn", f"SELECT s.technique, s.replicate, s.row_id, min({_dist_sql(NN_FEATURES)}, 5) AS d5 "
           "FROM sy s, rl r GROUP BY s.technique, s.replicate, s.row_id"),
    ("d1", "SELECT technique, replicate, row_id, d5[1] AS d1, d5[5] AS dk FROM nn"),
]

# ------------------------------------------------------------------ exact_match_rate
register("exact_match_rate", with_panel(
    "SELECT s.technique, s.replicate, " + rd("avg(CASE WHEN h.hit IS NOT NULL THEN 1.0 ELSE 0.0 END)", "exact_match_rate")
    + " FROM panel s LEFT JOIN (SELECT DISTINCT " + ", ".join(V) + ", 1 AS hit FROM panel WHERE technique = 'REAL') h ON "
    + " AND ".join(f"s.{v} = h.{v}" for v in V) + " WHERE s.technique <> 'REAL' GROUP BY s.technique, s.replicate",
    extended=True))(
    lambda spark, d: PV.exact_match_rate(load_panel(spark, d, extended=True), V))

# ------------------------------------------------------------------ nn distances
register("nn_distance_mean", with_panel(
    "SELECT technique, replicate, " + rd("avg(d1)", "nn_distance_mean") + " FROM d1 GROUP BY technique, replicate",
    _NN_CTES, extended=True, with_row_id=True))(
    lambda spark, d: PV.nn_distance_mean(PV.nn_distances(_px(spark, d), NN_FEATURES, 1)))

register("dcr", with_panel(
    "SELECT technique, replicate, " + rd("avg(d1)", "dcr_mean") + ", " + rd("min(d1)", "dcr_min") + ", "
    + rd("quantile_cont(d1, 0.05)", "dcr_p05") + " FROM d1 GROUP BY technique, replicate",
    _NN_CTES, extended=True, with_row_id=True))(
    lambda spark, d: PV.dcr(PV.nn_distances(_px(spark, d), NN_FEATURES, 1)))

register("k_distance", with_panel(
    "SELECT technique, replicate, " + rd("avg(dk)", "mean_k_distance") + ", " + rd("min(dk)", "min_k_distance")
    + " FROM d1 GROUP BY technique, replicate", _NN_CTES, extended=True, with_row_id=True))(
    lambda spark, d: PV.k_distance(PV.nn_distances(_px(spark, d), NN_FEATURES, 5), 5))

# ------------------------------------------------------------------ work of the exact search, and the approximate one
register("nn_compared_share")(lambda spark, d: _compared(spark, d))
PAIR_SHARE = 0.15  # the approximate search may compare so much of all pairs


def _compared(spark, d):
    """Share of REAL's rows that a synthetic row is compared with, per dataset."""
    r, s = PV._split(_px(spark, d), "REAL")
    done = knn_compared(s, r, NN_FEATURES, 1, query_id="row_id", ref_id="row_id", carry=DS)
    return done.groupBy(*DS).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("compared") / F.col("ref_rows")).alias("share"), F.max(F.col("compared") / F.col("ref_rows")).alias("max_share"))


def _approx(spark, d):
    r, s = PV._split(_px(spark, d), "REAL")
    near = knn_approx(s, r, NN_FEATURES, 1, query_id="row_id", ref_id="row_id", carry=DS, pair_budget=PAIR_SHARE * s.count() * r.count())
    return near.groupBy(*DS).agg(F.count(F.lit(1)).alias("n_found"), F.avg("dist").alias("nn_distance_mean"), F.first("recall").alias("recall"))


register("nn_distance_approx")(_approx)

# ------------------------------------------------------------------ membership_proxy
def membership(px):
    nn = materialise(PV.nn_distances(px, NN_FEATURES, 1), "nn")
    return PV.membership_proxy(px, nn, NN_FEATURES).select(*DS, "radius", "membership_inference")


# The twin brackets the percentile by the distances to every 29th REAL row, counts all pairs below the bracket and
# sorts those within it; a bracket that missed the rank would give no radius, not another one.
_COMPLETE = " AND ".join(f"{v} IS NOT NULL" for v in V)
_MP_CTES = [
    ("mr", f"SELECT * FROM panel WHERE technique = 'REAL' AND {_COMPLETE}"),
    ("ms", f"SELECT * FROM panel WHERE technique <> 'REAL' AND {_COMPLETE}"),
    ("mb", f"SELECT s.technique, s.replicate, quantile_cont({_dist_sql(V)}, 0.007) AS lo, quantile_cont({_dist_sql(V)}, 0.014) AS hi "
           "FROM ms s, (SELECT * FROM mr WHERE row_id % 29 = 0) r GROUP BY s.technique, s.replicate"),
    ("mn", f"SELECT technique, replicate, row_id, min(d) AS d1, count(*) AS n, count(CASE WHEN d < lo THEN 1 END) AS below, "
           "list(d) FILTER (WHERE d >= lo AND d < hi) AS inside FROM (SELECT s.technique, s.replicate, s.row_id, b.lo, b.hi, "
           f"{_dist_sql(V)} AS d FROM ms s JOIN mb b USING (technique, replicate), mr r) GROUP BY technique, replicate, row_id"),
    ("mt", "SELECT technique, replicate, sum(n) AS n, sum(below) AS below FROM mn GROUP BY technique, replicate"),
    ("mi", "SELECT technique, replicate, d, row_number() OVER (PARTITION BY technique, replicate ORDER BY d) - 1 AS k "
           "FROM (SELECT technique, replicate, unnest(inside) AS d FROM mn)"),
    ("me", "SELECT t.technique, t.replicate, max(CASE WHEN k = floor(0.01 * (n - 1)) - below THEN d END) AS v0, "
           "max(CASE WHEN k = floor(0.01 * (n - 1)) + 1 - below THEN d END) AS v1, any_value(0.01 * (n - 1) - floor(0.01 * (n - 1))) AS part "
           "FROM mt t JOIN mi i ON i.technique = t.technique AND i.replicate = t.replicate GROUP BY t.technique, t.replicate"),
    ("mp", "SELECT technique, replicate, any_value(e.v0 + (e.v1 - e.v0) * e.part) AS radius, "
           "avg(CASE WHEN d1 < e.v0 + (e.v1 - e.v0) * e.part THEN 1.0 ELSE 0.0 END) AS membership_inference "
           "FROM mn JOIN me e USING (technique, replicate) GROUP BY technique, replicate"),
]
register("membership_proxy", with_panel(
    "SELECT technique, replicate, " + rd("radius") + ", " + rd("membership_inference") + " FROM mp",
    _MP_CTES, extended=True, with_row_id=True))(lambda spark, d: membership(_px(spark, d)))

# ------------------------------------------------------------------ attribute_disclosure
_QI_MATCH = " + ".join(f"CAST(st.{c} = rt.{c} AS INTEGER)" for c in QI)
_AD_CTES = [
    ("rt", f"SELECT {', '.join(QI)}, min(row_id) AS rid, arg_min({SENSITIVE}, row_id) AS sens_r FROM panel "
           f"WHERE technique = 'REAL' GROUP BY {', '.join(QI)}"),
    ("st", f"SELECT DISTINCT {', '.join(QI)} FROM panel WHERE technique <> 'REAL'"),
    ("best", f"SELECT {', '.join('st.' + c for c in QI)}, rt.sens_r, row_number() OVER (PARTITION BY "
             f"{', '.join('st.' + c for c in QI)} ORDER BY {_QI_MATCH} DESC, rt.rid) AS k FROM st, rt"),
    ("ad", f"SELECT p.technique, p.replicate, avg(CASE WHEN p.{SENSITIVE} = b.sens_r THEN 1.0 ELSE 0.0 END) AS ad "
           f"FROM panel p JOIN best b ON " + " AND ".join(f"p.{c} = b.{c}" for c in QI)
           + " AND b.k = 1 WHERE p.technique <> 'REAL' GROUP BY p.technique, p.replicate"),
]
register("attribute_disclosure", with_panel(
    f"SELECT technique, replicate, {rd('ad', f'attribute_disclosure_{SENSITIVE}')} FROM ad",
    _AD_CTES, extended=True, with_row_id=True))(
    lambda spark, d: PV.attribute_disclosure(_px(spark, d), QI, SENSITIVE))

# ------------------------------------------------------------------ qi_linkability
_QS = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '__NA__') AS {c}" for c in QI)
_QL_CTES = [
    ("cls", f"SELECT {', '.join(QI)}, count(*) AS kk FROM (SELECT {_QS} FROM panel WHERE technique = 'REAL') "
            f"GROUP BY {', '.join(QI)}"),
    ("sq", f"SELECT technique, replicate, {_QS} FROM panel WHERE technique <> 'REAL'"),
    ("ql", "SELECT s.technique, s.replicate, avg(CASE WHEN c.kk IS NOT NULL THEN 1.0 ELSE 0.0 END) AS qi_match_rate, "
           "avg(CASE WHEN c.kk = 1 THEN 1.0 ELSE 0.0 END) AS qi_unique_match_rate, avg(c.kk) AS qi_avg_equiv_class_size, "
           "avg(CASE WHEN c.kk <= 5 THEN 1.0 ELSE 0.0 END) AS qi_high_risk_rate FROM sq s LEFT JOIN cls c ON "
           + " AND ".join(f"s.{c} = c.{c}" for c in QI) + " GROUP BY s.technique, s.replicate"),
]
register("qi_linkability", with_panel(
    "SELECT technique, replicate, " + ", ".join(rd(c) for c in [
        "qi_match_rate", "qi_unique_match_rate", "qi_avg_equiv_class_size", "qi_high_risk_rate"]) + " FROM ql",
    _QL_CTES, extended=True))(
    lambda spark, d: PV.qi_linkability(load_panel(spark, d, extended=True), QI))


# ------------------------------------------------------------------ dcr_standardized (both directions)
def _dcr_std_sql():
    z = ", ".join(f"({v} - m_{v}) / s_{v} AS {v}" for v in V)
    stats = ", ".join(f"avg({v}) AS m_{v}, CASE WHEN stddev_pop({v}) < 1e-8 THEN 1.0 ELSE stddev_pop({v}) END AS s_{v}"
                      for v in V)
    full = " AND ".join(f"{v} IS NOT NULL" for v in V)
    ctes = [
        ("rc", f"SELECT * FROM panel WHERE technique = 'REAL' AND {full}"),
        ("st", f"SELECT {stats} FROM rc"),
        ("rz", f"SELECT row_id, {z} FROM rc, st"),
        ("sz", f"SELECT technique, replicate, row_id, {z} FROM panel, st WHERE technique <> 'REAL' AND {full}"),
        ("s2r", f"SELECT s.technique, s.replicate, min({_dist_sql(V)}) AS dist FROM sz s, rz r "
                "GROUP BY s.technique, s.replicate, s.row_id"),
        ("r2s", f"SELECT s.technique, s.replicate, min({_dist_sql(V)}) AS dist FROM sz s JOIN rz r ON TRUE "
                "GROUP BY s.technique, s.replicate, r.row_id"),
    ]
    sel = []
    for name in ("r2s", "s2r"):
        sel.append(f"SELECT technique, replicate, avg(dist) AS {name}_mean, min(dist) AS {name}_min, "
                   f"quantile_cont(dist, 0.01) AS {name}_p01, quantile_cont(dist, 0.05) AS {name}_p05, "
                   f"quantile_cont(dist, 0.5) AS {name}_p50 FROM {name} GROUP BY technique, replicate")
    ctes += [("a", sel[0]), ("b", sel[1])]
    cols = [f"{n}_{s}" for n in ("dcr_r2s", "dcr_s2r") for s in ("mean", "min", "p01", "p05", "p50")]
    return with_panel("SELECT technique, replicate, " + ", ".join(rd(c.replace("dcr_", ""), c) for c in cols)
                      + f", {len(V)} AS dcr_common_features FROM a JOIN b USING (technique, replicate)",
                      ctes, extended=True, with_row_id=True)


register("dcr_standardized", _dcr_std_sql())(
    lambda spark, d: PV.dcr_standardized(_px(spark, d), V))


# ------------------------------------------------------------------ privacy_by_technique
def _privacy_by_technique(spark, d):
    px = _px(spark, d)
    nn = materialise(PV.nn_distances(px, NN_FEATURES, 5), "nn")
    parts = [PV.exact_match_rate(px, V), PV.nn_distance_mean(nn), PV.dcr(nn), PV.k_distance(nn, 5),
             PV.attribute_disclosure(px, QI, SENSITIVE), PV.qi_linkability(px, QI)]
    per_run = parts[0]
    for p in parts[1:]:
        per_run = per_run.join(materialise(p, "privacy-part"), DS, "full_outer")
    metrics = [c for c in per_run.columns if c not in DS]
    return per_run.groupBy("technique").agg(F.countDistinct("replicate").alias("runs_used"),
                                            *[F.avg(c).alias(c) for c in metrics])


def _pbt_sql():
    em = ("em", "SELECT s.technique, s.replicate, avg(CASE WHEN h.hit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS exact_match_rate "
                "FROM panel s LEFT JOIN (SELECT DISTINCT " + ", ".join(V) + ", 1 AS hit FROM panel WHERE technique = 'REAL') h ON "
          + " AND ".join(f"s.{v} = h.{v}" for v in V) + " WHERE s.technique <> 'REAL' GROUP BY s.technique, s.replicate")
    dd = ("dd", "SELECT technique, replicate, avg(d1) AS nn_distance_mean, avg(d1) AS dcr_mean, min(d1) AS dcr_min, "
                "quantile_cont(d1, 0.05) AS dcr_p05, avg(dk) AS mean_k_distance, min(dk) AS min_k_distance "
                "FROM d1 GROUP BY technique, replicate")
    ctes = [*_NN_CTES, *_AD_CTES, *[c for c in _QL_CTES if c[0] != "st"], em, dd,
            ("pr", "SELECT * FROM em JOIN dd USING (technique, replicate) JOIN ad USING (technique, replicate) "
                   "JOIN ql USING (technique, replicate)")]
    ctes = [(n if n != "sq" else "sq", q) for n, q in ctes]
    metrics = ["exact_match_rate", "nn_distance_mean", "dcr_mean", "dcr_min", "dcr_p05", "mean_k_distance",
               "min_k_distance", "ad", "qi_match_rate", "qi_unique_match_rate", "qi_avg_equiv_class_size",
               "qi_high_risk_rate"]
    sel = ", ".join(rd(f"avg({m})", f"attribute_disclosure_{SENSITIVE}" if m == "ad" else m) for m in metrics)
    return with_panel(f"SELECT technique, count(DISTINCT replicate) AS runs_used, {sel} FROM pr GROUP BY technique",
                      ctes, extended=True, with_row_id=True)


register("privacy_by_technique", _pbt_sql())(_privacy_by_technique)
