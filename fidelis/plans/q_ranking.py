"""Registered queries: component scores and rankings over a component table that SQL can rebuild.

Loadings are correlations of items with their equal-weight composite, reliability is alpha;
parts without an input here (paths, fit) are left out by the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import marginal as M
from fidelis.operators import privacy as PV
from fidelis.operators import ranking as RK
from fidelis.operators import report as RP
from fidelis.operators.prep import row_mean
from fidelis.plans import q_dependency as QD
from fidelis.plans import q_marginal as QM
from fidelis.plans import q_measurement as QS
from fidelis.plans.registry import rd, register
from fidelis.plans.sqlgen import melt_sql
from fidelis.session import materialise
from fidelis.sources.panel import MEASUREMENT, load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]
CAT = ["o1", "sens"]
OWNER = {i: c for c, items in MEASUREMENT.items() for i in items}


def loading_errors(panel):
    """Mean over constructs of the mean |difference| of item-composite correlations to REAL, per technique."""
    wide = panel.select("technique", *V, *[row_mean(items).alias(f"_{c}") for c, items in MEASUREMENT.items()])
    g = wide.groupBy("technique").agg(*[F.corr(i, f"_{OWNER[i]}").alias(i) for i in V])
    long = g.unpivot(["technique"], V, "item", "loading")
    owner = F.create_map(*[F.lit(x) for i, c in OWNER.items() for x in (i, c)])
    real = long.filter("technique = 'REAL'").select("item", F.col("loading").alias("real"))
    diff = long.filter("technique <> 'REAL'").join(real, "item").withColumn("construct", owner[F.col("item")])
    return diff.groupBy("technique", "construct").agg(F.avg(F.abs(F.col("loading") - F.col("real"))).alias("m")).groupBy("technique").agg(F.avg("m").alias("loading_err"))


def component_table(spark, d):
    p = load_panel(spark, d, extended=True)
    dist = M.dist_summary(p, V, CAT)
    cont = dist.filter("variable_type = 'continuous'").select(
        "technique", F.col("mean_abs_dmu").alias("e_mu"), F.col("mean_abs_dsd").alias("e_sig"), F.col("mean_adherence").alias("cont_adherence"))
    cat = dist.filter("variable_type <> 'continuous'").select("technique", F.col("mean_adherence").alias("cat_adherence"))
    cov = QD._cov_delta(spark, d).filter("var_i <> var_j").groupBy("technique").agg(F.avg("abs_delta").alias("covariate_err"))
    rel = RP.vs_real(_alpha(p), ["construct"], "alpha").groupBy("technique").agg(F.avg("abs_delta").alias("reliability_err"))
    priv = PV.exact_match_rate(p, V).groupBy("technique").agg(F.avg("exact_match_rate").alias("exact_match_rate"))
    t = cont.filter("technique <> 'REAL'")
    for part in (cat, cov, rel, loading_errors(p), priv):
        t = t.join(part, "technique")
    return materialise(t, "components")


def _alpha(p):
    return QS.MS.cronbach_alpha(p.filter("a2 IS NOT NULL"), MEASUREMENT)


def _loading_sql():
    rows = []
    for i, c in OWNER.items():
        rows.append(f"SELECT technique, '{i}' AS item, '{c}' AS construct, corr({i}, x_{c}) AS loading FROM lw GROUP BY technique")
    return " UNION ALL ".join(rows)


_COMP = [f"CASE WHEN {' + '.join(f'CAST({i} IS NOT NULL AS INTEGER)' for i in items)} > 0 THEN ({' + '.join(f'coalesce({i}, 0.0)' for i in items)}) "
         f"/ ({' + '.join(f'CAST({i} IS NOT NULL AS INTEGER)' for i in items)}) END AS x_{c}" for c, items in MEASUREMENT.items()]
_MATCH = " AND ".join(f"s.{v} = h.{v}" for v in V)
COMPONENT_CTES = [
    ("long", melt_sql("panel", ["technique"], V)), QM._SUMM, QM._BOUNDS,
    ("e1", "SELECT s.technique, avg(CASE WHEN r.sd > 0 THEN abs(s.mean - r.mean) / r.sd END) AS e_mu, avg(CASE WHEN r.sd > 0 THEN abs(s.sd - r.sd) / r.sd END) AS e_sig "
           "FROM summ s JOIN summ r ON s.variable = r.variable AND r.technique = 'REAL' WHERE s.technique <> 'REAL' GROUP BY s.technique"),
    ("e2", "SELECT technique, avg(a) AS cont_adherence FROM (SELECT l.technique, l.variable, avg(CASE WHEN l.value BETWEEN b.lo AND b.hi THEN 1.0 ELSE 0.0 END) AS a "
           "FROM long l JOIN bounds b ON l.variable = b.variable GROUP BY ALL) GROUP BY technique"),
    ("clong", melt_sql("panel", ["technique"], CAT, dtype="VARCHAR")),
    ("cats", "SELECT DISTINCT variable, value, 1 AS hit FROM clong WHERE technique = 'REAL'"),
    ("e3", "SELECT technique, avg(a) AS cat_adherence FROM (SELECT l.technique, l.variable, avg(CASE WHEN c.hit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS a "
           "FROM clong l LEFT JOIN cats c ON l.variable = c.variable AND l.value = c.value GROUP BY ALL) GROUP BY technique"),
    *QD._COV_CTES,
    ("e4", "SELECT technique, avg(abs_delta) AS covariate_err FROM dl WHERE var_i <> var_j GROUP BY technique"),
    ("al", QS._alpha_sql().replace("FROM panel", "FROM panel WHERE a2 IS NOT NULL")),
    ("alm", "SELECT technique, construct, avg(alpha) AS m FROM al GROUP BY ALL"),
    ("e5", "SELECT s.technique, avg(abs(s.m - r.m)) AS reliability_err FROM alm s JOIN alm r ON r.technique = 'REAL' AND r.construct = s.construct GROUP BY s.technique"),
    ("lw", f"SELECT technique, {', '.join(V)}, {', '.join(_COMP)} FROM panel"), ("ld", _loading_sql()),
    ("e6", "SELECT technique, avg(m) AS loading_err FROM (SELECT s.technique, s.construct, avg(abs(s.loading - r.loading)) AS m FROM ld s JOIN ld r "
           "ON r.technique = 'REAL' AND r.item = s.item GROUP BY ALL) GROUP BY technique"),
    ("e7", "SELECT technique, avg(e) AS exact_match_rate FROM (SELECT s.technique, s.replicate, avg(CASE WHEN h.hit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS e FROM panel s "
           f"LEFT JOIN (SELECT DISTINCT {', '.join(V)}, 1 AS hit FROM panel WHERE technique = 'REAL') h ON {_MATCH} GROUP BY ALL) GROUP BY technique"),
    ("ct", "SELECT * FROM e1 JOIN e2 USING (technique) JOIN e3 USING (technique) JOIN e4 USING (technique) JOIN e5 USING (technique) JOIN e6 USING (technique) "
           "JOIN e7 USING (technique)"),
]


def _mm(x: str) -> str:
    return f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 0.0 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


_SCORES = {
    "distribution_score": "(" + " + ".join(_mm(x) for x in ("(-e_mu)", "(-e_sig)", "cont_adherence", "cat_adherence")) + ") / 4",
    "covariate_score": "-covariate_err", "loading_score": "-loading_err", "reliability_score": "-reliability_err",
    "privacy_score": _mm("(-exact_match_rate)"),
}
_SC = ("sc", "SELECT technique, e_mu + e_sig + (1 - cont_adherence) + (1 - cat_adherence) AS distribution_error_raw, "
             + ", ".join(f"{e} AS {k}" for k, e in _SCORES.items()) + " FROM ct")
_ALL = [*COMPONENT_CTES, _SC]


def _sql(select: str, ctes=_ALL) -> str:
    return with_panel(select, ctes, extended=True)


def _scores(spark, d):
    return RK.component_scores(component_table(spark, d))


for _name, _part in (("score_covariate", "covariate_score"), ("score_loading", "loading_score"), ("score_reliability", "reliability_score"),
                     ("score_privacy_matches", "privacy_score")):
    register(_name, _sql(f"SELECT technique, {rd(_part)} FROM sc"))(lambda spark, d, part=_part: _scores(spark, d).select("technique", part))
register("score_distribution", _sql(f"SELECT technique, {rd('distribution_score')}, {rd('distribution_error_raw')} FROM sc"))(
    lambda spark, d: _scores(spark, d).select("technique", "distribution_score", "distribution_error_raw"))
register("score_measurement", _sql("SELECT technique, " + rd(f"1 - ({_mm('abs(loading_score)')} + {_mm('abs(reliability_score)')}) / 2", "measurement_composite") + " FROM sc"))(
    lambda spark, d: RK.section_composites(_scores(spark, d)).select("technique", "measurement_composite"))
register("component_ranks", _sql("SELECT technique, " + ", ".join(f"CAST(rank() OVER (ORDER BY round({k}, 12) DESC) AS INTEGER) AS {k.replace('_score', '_rank')}" for k in _SCORES) + " FROM sc"))(
    lambda spark, d: RK.component_ranks(_rounded(_scores(spark, d))).select("technique", *[k.replace("_score", "_rank") for k in _SCORES]))


def _rounded(s):
    return s.select("technique", *[F.round(k, 12).alias(k) for k in _SCORES])


_HIGH = ("cont_adherence", "cat_adherence")
_IN = ["e_mu", "e_sig", "cont_adherence", "cat_adherence", "covariate_err", "loading_err", "reliability_err", "exact_match_rate"]
register("detailed_breakdown", _sql(
    "SELECT technique, metric, " + rd("value") + ", coalesce(g = max(g) OVER (PARTITION BY metric), FALSE) AS best FROM ("
    + " UNION ALL ".join(f"SELECT technique, '{c}' AS metric, CAST(round({c}, 9) AS DOUBLE) AS value, {'' if c in _HIGH else '-'}CAST(round({c}, 9) AS DOUBLE) AS g FROM ct" for c in _IN) + ")"))(
    lambda spark, d: RK.detailed_breakdown(component_table(spark, d).select("technique", *[F.round(c, 9).alias(c) for c in _IN])))


def _overall(weights: dict[str, float], normalise: bool) -> str:
    used = {k: w for k, w in weights.items() if k in _SCORES}
    scale = sum(weights.values()) / sum(used.values())
    terms = [f"{w * scale!r} * {k if k in RK.RAW_PARTS or not normalise else _mm(k)}" for k, w in used.items()]
    return _sql("SELECT technique, " + rd("s", "overall_score") + ", CAST(row_number() OVER (ORDER BY s DESC, technique) AS INTEGER) AS overall_rank, '"
                + ",".join(k.removesuffix("_score") for k in used) + "' AS parts_used FROM (SELECT technique, " + " + ".join(terms) + " AS s FROM sc)")


_OUT = ["technique", "overall_score", "overall_rank", "parts_used"]
register("rank_overall_components", _overall(RK.OVERALL_WEIGHTS, True))(lambda spark, d: RK.rank_overall(component_table(spark, d)).select(*_OUT))
register("rank_overall_v1", _overall(RK.V1_WEIGHTS, False))(lambda spark, d: RK.rank_overall_v1(component_table(spark, d)).select(*_OUT))
