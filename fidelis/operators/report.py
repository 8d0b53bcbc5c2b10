"""Report operators over estimate tables.

Inputs are long estimate tables keyed by (technique, replicate, <keys>) with one
value column; all comparisons are joins with REAL's rows (one row per key:
broadcast) and groupBy aggregations.  Nothing here touches data rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REAL = "REAL"

# fixed values: report thresholds
RELIABILITY_MIN = {"alpha": 0.70, "rhoC": 0.70, "rhoA": 0.70, "AVE": 0.50}
STABILITY_MAX = {"alpha": 0.30, "rhoC": 0.30, "rhoA": 0.30, "AVE": 0.10}
HTMT_MAX = 0.85
HTMT_SEED_MAX = 0.90


def thresholds(est: DataFrame, value: str, metric_col: str | None = None, metric: str | None = None) -> DataFrame:
    """pass / fail / NA against the minimum for the metric."""
    lim = F.lit(RELIABILITY_MIN[metric]) if metric else F.create_map(
        *[x for k, v in RELIABILITY_MIN.items() for x in (F.lit(k), F.lit(v))])[F.col(metric_col)]
    return est.withColumn("status", F.when(F.col(value).isNull(), "NA").when(F.col(value) >= lim, "pass").otherwise("fail"))


def technique_mean(est: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sd (ddof 1), min, max over replicates per technique and key; replicate count."""
    return est.groupBy("technique", *keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.countDistinct("replicate").alias("n_replicates"))


def vs_real(est: DataFrame, keys: Sequence[str], value: str, real: str = REAL) -> DataFrame:
    """Technique mean next to REAL's value, with signed and absolute difference."""
    keys = list(keys)
    tm = technique_mean(est, keys, value)
    r = tm.filter(F.col("technique") == real).select(*keys, F.col("mean").alias("real"))
    return tm.filter(F.col("technique") != real).join(F.broadcast(r), keys, "left").withColumn(
        "delta", F.col("mean") - F.col("real")).withColumn("abs_delta", F.abs(F.col("mean") - F.col("real")))


def stability(est: DataFrame, keys: Sequence[str], value: str, limit: float | None = None) -> DataFrame:
    """Range (max - min) over replicates; flagged unstable above ``limit``."""
    tm = technique_mean(est, keys, value).withColumn("range", F.col("max") - F.col("min"))
    return tm.withColumn("unstable", F.col("range") > F.lit(limit)) if limit is not None else tm


def grid_rmse(delta: DataFrame, by: Sequence[str] = ("technique",)) -> DataFrame:
    """RMSE of |d| over non-null cells."""
    return delta.filter(F.col("abs_delta").isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(F.col("abs_delta") * F.col("abs_delta"))).alias("rmse"), F.count(F.lit(1)).alias("cells"))


def pairwise_error(delta: DataFrame, by: Sequence[str] = ("technique",)) -> DataFrame:
    """MAE, RMSE and direction agreement of a REAL-vs-technique table."""
    return delta.groupBy(*by).agg(
        F.avg("abs_delta").alias("mae"), F.sqrt(F.avg(F.col("abs_delta") * F.col("abs_delta"))).alias("rmse"),
        F.avg((F.signum("mean") == F.signum("real")).cast("double")).alias("direction"))


def sheet_errors(delta: DataFrame, by: Sequence[str]) -> DataFrame:
    """``pairwise_error`` with the number of compared estimates and the Spearman rho between ranks of |estimate|, per group."""
    by = list(by)
    d = delta.filter("mean IS NOT NULL AND real IS NOT NULL").withColumns({"_s": F.abs("mean"), "_r": F.abs("real")})
    # the windows run over one technique's estimates of one sheet
    d = rank_average(rank_average(d, "_s", "_rs", True, by), "_r", "_rr", True, by)
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_delta").alias("mae"), F.sqrt(F.avg(F.col("abs_delta") * F.col("abs_delta"))).alias("rmse"),
        F.avg((F.signum("mean") == F.signum("real")).cast("double")).alias("direction"), F.corr("_rs", "_rr").alias("rank_rho"))


def seed_summary(est: DataFrame, keys: Sequence[str], value: str = "value", ok: str = "ok") -> DataFrame:
    """Over the replicates of each key: seeds, mean, sd, min, max, and the share of seeds that pass (a null ``ok`` is left out)."""
    return est.groupBy(*keys).agg(
        F.count(value).alias("seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.avg(F.col(ok).cast("double")).alias("share_ok"))


def indirect_compare(indirect: DataFrame, real: str = REAL, alpha: float = 0.05) -> DataFrame:
    """Technique mean of the indirect effect against REAL's: absolute difference, share of replicates on the same side of p < ``alpha``."""
    keys = ["iv", "mediator", "dv"]
    r = indirect.filter(F.col("technique") == real).select(*keys, F.col("indirect_b").alias("real"), (F.col("p_value") < alpha).alias("_real_ok"))
    s = indirect.filter(F.col("technique") != real).join(r, keys)
    return s.groupBy("technique", *keys).agg(
        F.first("real").alias("real"), F.avg("indirect_b").alias("mean"), F.abs(F.avg("indirect_b") - F.first("real")).alias("abs_delta"),
        F.avg(((F.col("p_value") < alpha) == F.col("_real_ok")).cast("double")).alias("p_agreement"))


def direction_rank(delta: DataFrame, key: str) -> DataFrame:
    """Share of equal signs and Spearman rho between ranks of |estimate| (average ties) per technique."""
    w_s = Window.partitionBy("technique").orderBy(F.abs("mean"))
    w_r = Window.partitionBy("technique").orderBy(F.abs("real"))
    ties_s = Window.partitionBy("technique", F.abs("mean"))
    ties_r = Window.partitionBy("technique", F.abs("real"))
    # the windows run over one technique's paths: a few rows per group
    d = delta.withColumn("rk_s", F.rank().over(w_s) + (F.count(F.lit(1)).over(ties_s) - 1) / 2.0) \
        .withColumn("rk_r", F.rank().over(w_r) + (F.count(F.lit(1)).over(ties_r) - 1) / 2.0)
    return d.groupBy("technique").agg(
        F.avg((F.signum("mean") == F.signum("real")).cast("double")).alias("direction_share"),
        F.corr("rk_s", "rk_r").alias("rank_rho"), F.count(F.lit(1)).alias("n_paths"))


def significance_label(p: str) -> F.Column:
    return F.when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("ns")


def beta_table(paths: DataFrame) -> DataFrame:
    """'beta +- sd sig' strings per technique and path (presentation of estimate, sd and p)."""
    return paths.withColumn("cell", F.format_string("%.2f ± %.2f %s", F.col("mean"), F.col("sd"), significance_label("p")))


def sign_flip(est: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """max - min over replicates and a flag when the sign changes (min < 0 < max)."""
    tm = technique_mean(est, keys, value)
    return tm.withColumn("range", F.col("max") - F.col("min")).withColumn(
        "sign_flip", (F.col("min") < 0) & (F.col("max") > 0))


def agg_replicates(est: DataFrame, keys: Sequence[str], value: str, min_replicates: int = 2) -> DataFrame:
    """Aggregated sheet: mean, sd, min, max per technique and key; techniques with fewer than
    two replicates are skipped."""
    tm = technique_mean(est, keys, value)
    return tm.filter(F.col("n_replicates") >= min_replicates)


def compare_sheets(est: DataFrame, keys: Sequence[str], value: str, real: str = REAL, sheet: Sequence[str] = ()) -> DataFrame:
    """REAL point estimate aligned with every technique's mean and range (long form); null keys match.

    A sheet (the columns ``sheet``, a part of ``keys``; none: all rows are one) for which fewer than
    two sources, REAL or a technique that ``agg_replicates`` keeps, have a value is dropped.
    """
    keys, sheet = list(keys), list(sheet)
    r = est.filter(F.col("technique") == real).groupBy(*keys).agg(F.first(value).alias("real"))
    tm = agg_replicates(est.filter(F.col("technique") != real), keys, value)
    have = r.filter("real IS NOT NULL").select(*keys, F.lit(real).alias("_t")).unionByName(
        tm.filter("mean IS NOT NULL").select(*keys, F.col("technique").alias("_t")))
    two = have.groupBy(*sheet).agg(F.countDistinct("_t").alias("_sources")).filter("_sources >= 2").drop("_sources")
    r = r.join(F.broadcast(two), sheet or F.lit(True), "left_semi")
    t = tm.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "technique", "mean", "min", "max")
    on = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    return r.join(t, on, "left").select(*keys, "technique", "real", "mean", "min", "max")


def rank_min(df: DataFrame, value: str, out: str, ascending: bool = False, partition: Sequence[str] = ()) -> DataFrame:
    """Competition rank (ties share the lowest rank)."""
    o = F.col(value).asc() if ascending else F.col(value).desc()
    w = Window.partitionBy(*partition).orderBy(o) if partition else Window.orderBy(o)
    return df.withColumn(out, F.rank().over(w))


def rank_average(df: DataFrame, value: str, out: str, ascending: bool = False, partition: Sequence[str] = ()) -> DataFrame:
    """Average-tie rank."""
    o = F.col(value).asc() if ascending else F.col(value).desc()
    w = Window.partitionBy(*partition).orderBy(o) if partition else Window.orderBy(o)
    t = Window.partitionBy(*partition, value) if partition else Window.partitionBy(value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(t) - 1) / 2.0)


def path_range_overlap(summary: DataFrame, keys: Sequence[str], real: str = REAL) -> DataFrame:
    """Does REAL's estimate, rounded to 2 decimals, lie within the technique's mean estimate plus or
    minus its largest bootstrap SD?"""
    keys = list(keys)
    tm = summary.groupBy("technique", *keys).agg(F.avg("estimate").alias("mean"), F.max("boot_sd").alias("max_sd"))
    r = tm.filter(F.col("technique") == real).select(*keys, F.round("mean", 2).alias("real"))
    return tm.filter(F.col("technique") != real).join(r, keys).withColumn(
        "overlap", F.col("real").between(F.col("mean") - F.col("max_sd"), F.col("mean") + F.col("max_sd")))


def path_hybrid_score(est: DataFrame, keys: Sequence[str], value: str, candidate: Sequence[str] = ("technique", "replicate"), real: str = REAL,
                      min_paths: int = 3) -> DataFrame:
    """Half the share of equal signs plus half the Spearman rho of signed estimates against REAL, per
    candidate with at least ``min_paths`` paths; ``best`` marks each technique's best candidate."""
    keys, candidate = list(keys), list(candidate)
    r = est.filter(F.col("technique") == real).groupBy(*keys).agg(F.avg(value).alias("real"))
    d = est.filter(F.col("technique") != real).join(r, keys)
    d = rank_average(rank_average(d, value, "rk_s", True, candidate), "real", "rk_r", True, candidate)
    g = d.groupBy(*candidate).agg(
        F.count(F.lit(1)).alias("n_paths"), F.avg((F.signum(value) == F.signum("real")).cast("double")).alias("direction"),
        F.coalesce(F.corr("rk_s", "rk_r"), F.lit(0.0)).alias("rho")).filter(F.col("n_paths") >= min_paths)
    g = g.withColumn("hybrid", (F.col("direction") + F.col("rho")) / 2)
    best = Window.partitionBy("technique").orderBy(F.col("hybrid").desc(), *candidate)
    return g.withColumn("best", F.row_number().over(best) == 1)
