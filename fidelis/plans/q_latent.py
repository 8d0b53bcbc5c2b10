"""Registered queries: bootstrap, mediation, multivariate screens and synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import measurement as MS
from fidelis.operators import multivariate as MV
from fidelis.operators import report as RP
from fidelis.operators import synth as SY
from fidelis.plans.registry import rd, register
from fidelis.session import materialise
from fidelis.sources.panel import MEASUREMENT, STRUCTURE, load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]
# mediation model on the same indicators: FA -> FB -> FC plus the direct FA -> FC
STRUCTURE_MED = [("FA", "FB"), ("FA", "FC"), ("FB", "FC")]
MEDIATIONS = [("FA", "FB", "FC")]
DRAWS, SEED = 2000, 123


def _draws(spark, d, structure=STRUCTURE):
    p = load_panel(spark, d, with_row_id=True)
    return materialise(MS.bootstrap_fit(p, MEASUREMENT, structure, DRAWS, SEED), "bootstrap")


def _boot(spark, d, structure=STRUCTURE):
    # the estimates are written, as their readers take several parts and each would pass over the rows again
    fit = materialise(MS.pls_fit(load_panel(spark, d, with_row_id=True), MEASUREMENT, structure), "estimates")
    return _draws(spark, d, structure), MS.path_estimates(fit)


def _paths(spark, d):
    return MS.bootstrap_summary(*_boot(spark, d))


def boot_med(spark, d):
    """Bootstrap draws and estimates of the mediation model."""
    return _boot(spark, d, STRUCTURE_MED)


def pls_med(spark, d):
    return MS.pls_fit(load_panel(spark, d), MEASUREMENT, STRUCTURE_MED)


def _indirect(spark, d):
    return MS.indirect_effects(*boot_med(spark, d), MEDIATIONS)


register("bootstrap_fit")(_draws)
register("std_paths")(_paths)
register("indirect_effect")(_indirect)
register("indirect_compare")(lambda spark, d: RP.indirect_compare(_indirect(spark, d)))
register("path_beta_table")(lambda spark, d: RP.beta_table(_paths(spark, d).filter("effect = 'direct'").select(
    *DS, "iv", "dv", F.col("estimate").alias("mean"), F.col("boot_sd").alias("sd"), F.col("p_value").alias("p"))))
register("path_range_overlap")(lambda spark, d: RP.path_range_overlap(_paths(spark, d).filter("effect = 'direct'"), ["iv", "dv"]))
register("plsc_adjust")(lambda spark, d: MS.plsc_adjust(MS.pls_fit(load_panel(spark, d), MEASUREMENT, STRUCTURE), STRUCTURE))
# path table that SQL can rebuild: correlations of item pairs stand in for paths
_PAIRS = [("a1", "b1"), ("a1", "c1"), ("b1", "c1"), ("a2", "b2")]
_PT = ("pt", " UNION ALL ".join(f"SELECT technique, replicate, '{a}-{b}' AS path, round(corr({a}, {b}), 9) AS beta FROM panel GROUP BY technique, replicate" for a, b in _PAIRS))
_HY = ("hy", "SELECT s.technique, s.replicate, s.beta, r.beta AS real FROM pt s JOIN (SELECT path, avg(beta) AS beta FROM pt WHERE technique = 'REAL' GROUP BY path) r "
             "ON r.path = s.path WHERE s.technique <> 'REAL'")
_RANK = "rank() OVER (PARTITION BY technique, replicate ORDER BY {0}) + (count(*) OVER (PARTITION BY technique, replicate, {0}) - 1) / 2.0"
_HG = ("hg", "SELECT technique, replicate, count(*) AS n_paths, avg(CASE WHEN sign(beta) = sign(real) THEN 1.0 ELSE 0.0 END) AS direction, "
             f"coalesce(corr(rs, rr), 0.0) AS rho FROM (SELECT *, {_RANK.format('beta')} AS rs, {_RANK.format('real')} AS rr FROM hy) GROUP BY technique, replicate")
register("path_hybrid_score")(lambda spark, d: RP.path_hybrid_score(
    MS.sheet(pls_med(spark, d), "paths", "beta").select(*DS, "key1", "key2", "value"), ["key1", "key2"], "value"))
register("path_hybrid_score_pairs", with_panel(
    "SELECT technique, replicate, n_paths, " + ", ".join([rd("direction"), rd("rho"), rd("(direction + rho) / 2", "hybrid")])
    + ", row_number() OVER (PARTITION BY technique ORDER BY round((direction + rho) / 2, 9) DESC, replicate) = 1 AS best FROM hg", [_PT, _HY, _HG]))(
    lambda spark, d: RP.path_hybrid_score(_pair_table(spark, d), ["path"], "beta").withColumn("hybrid", F.round("hybrid", 9)))


def _pair_table(spark, d):
    g = load_panel(spark, d).groupBy(*DS).agg(*[F.round(F.corr(a, b), 9).alias(f"{a}-{b}") for a, b in _PAIRS])
    return g.unpivot(DS, [F.col(f"`{a}-{b}`") for a, b in _PAIRS], "path", "beta")


register("mediation_summary")(lambda spark, d: MS.mediation_summary(
    MS.pls_fit(load_panel(spark, d), MEASUREMENT, STRUCTURE_MED), MEDIATIONS))

# closed form of three items, so that SQL can check the algebra: correlations p, q, r of (a1,a2), (a1,a3), (a2,a3)
_THREE = ["a1", "a2", "a3"]
_C3 = ("c3", "SELECT technique, replicate, corr(a1, a2) AS p, corr(a1, a3) AS q, corr(a2, a3) AS r, avg(a1) AS m1, avg(a2) AS m2, avg(a3) AS m3, "
             "stddev_samp(a1) AS s1, stddev_samp(a2) AS s2, stddev_samp(a3) AS s3 FROM panel GROUP BY technique, replicate")
_DET = "(1 + 2 * p * q * r - p * p - q * q - r * r)"
_Z = "(panel.a{0} - m{0}) / s{0}"
_MAHA = ("md", "SELECT panel.technique, panel.replicate, sqrt(((1 - r * r) * z1 * z1 + (1 - q * q) * z2 * z2 + (1 - p * p) * z3 * z3 "
               f"+ 2 * (q * r - p) * z1 * z2 + 2 * (p * r - q) * z1 * z3 + 2 * (p * q - r) * z2 * z3) / {_DET}) AS dist FROM "
               "(SELECT panel.technique, panel.replicate, p, q, r, " + ", ".join(f"{_Z.format(i)} AS z{i}" for i in (1, 2, 3))
               + " FROM panel JOIN c3 USING (technique, replicate)) panel")

register("mahalanobis_three", with_panel(
    "SELECT technique, replicate, count(*) AS n_rows, " + rd("avg(dist)", "mean_distance") + ", " + rd("max(dist)", "max_distance")
    + " FROM md GROUP BY technique, replicate", [_C3, _MAHA]))(
    lambda spark, d: MV.mahalanobis_outliers(load_panel(spark, d), _THREE).groupBy(*DS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("mahalanobis").alias("mean_distance"), F.max("mahalanobis").alias("max_distance")))
register("vif_three", with_panel(
    " UNION ALL ".join(f"SELECT technique, replicate, '{v}' AS variable, " + rd(f"(1 - {x} * {x}) / {_DET}", "vif") + " FROM c3"
                       for v, x in zip(_THREE, "rqp", strict=True)), [_C3]))(
    lambda spark, d: MV.vif(load_panel(spark, d), _THREE))
# the operators themselves: all nine indicators, tested against numpy
register("mahalanobis_outliers")(lambda spark, d: MV.mahalanobis_outliers(load_panel(spark, d), V).groupBy(*DS).agg(
    F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("keep"), 1)).alias("n_kept"),
    F.avg("mahalanobis").alias("mean_distance"), F.max("mahalanobis").alias("max_distance")))
register("vif")(lambda spark, d: MV.vif(load_panel(spark, d), V))
register("mahalanobis_nine")(lambda spark, d: MV.mahalanobis_outliers(load_panel(spark, d), V).groupBy(*DS).agg(
    F.count(F.lit(1)).alias("n_before"), F.count(F.when(F.col("keep"), 1)).alias("n_kept")))
register("pca_first_component")(lambda spark, d: MV.pca_first_component(load_panel(spark, d), V))
register("pca_scores")(lambda spark, d: MV.pca_scores(load_panel(spark, d, with_row_id=True), V).select(*DS, "row_id", "pc1"))


def _real(spark, d):
    return load_panel(spark, d, with_row_id=True).filter("technique = 'REAL'")


# all nine indicators (a2 has nulls), the ordinal o1, the sensitive attribute and a text category
_DISCRETE = ["o1", "sens", "l_returnflag"]


def _copula(spark, d):
    real = load_panel(spark, d, extended=True, with_row_id=True).filter("technique = 'REAL'")
    return SY.copula_synthesize(spark, real, V, real.count(), seed=42, discrete=_DISCRETE)


register("copula_synthesize")(_copula)
register("discretize_clip", with_panel(
    "SELECT row_id, " + rd("least(greatest(round_even(a1 + 3, 0), 1), 5)", "a1_ordinal") + " FROM panel WHERE technique = 'REAL'", with_row_id=True))(lambda spark, d: _real(spark, d).select(
    "row_id", SY.discretize_clip(F.col("a1") + 3, 1, 5).alias("a1_ordinal")))
register("latent_simulate")(lambda spark, d: SY.latent_simulate(
    _real(spark, d).select("row_id", "a1", "b1"), {"a1": 0.4, "b1": 0.3}, 0.25, "lv_c").select("row_id", "lv_c"))
register("condition_seed")(lambda spark, d: SY.condition_seed(spark, _real(spark, d), "a1", _real(spark, d).count()))
# nothing is constant in the derived panel, so b1 is made so; all nine columns are examined and the rows returned
register("impute_zero_variance")(lambda spark, d: SY.impute_zero_variance(
    load_panel(spark, d, with_row_id=True).filter("technique <> 'REAL'").withColumn("b1", F.lit(0.5)),
    _real(spark, d), V).select(*DS, "row_id", *V))
