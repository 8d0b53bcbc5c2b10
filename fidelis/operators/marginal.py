"""Marginal-distribution operators (per technique x variable).

Input is the wide ``panel`` (technique, replicate, <variables>).  Every operator
melts to long form, aggregates with map-side partial aggregation, and joins
REAL's statistics as a table with one row per variable (broadcast: bounded by
the number of variables, not by rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.functions.stats import kolmogorov_sf
from fidelis.operators.order import cumulative_counts
from fidelis.operators.reshape import melt
from fidelis.session import materialise

REAL = "REAL"


def _long(panel: DataFrame, variables: Sequence[str], ids=("technique",), dtype="double") -> DataFrame:
    return melt(panel, list(ids), variables, dtype=dtype, drop_nulls=True)


def sample_size(panel: DataFrame, by: str = "technique") -> DataFrame:
    """Rows per replicate of every technique (REAL counts as one replicate)."""
    return panel.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("replicate").alias("n_replicates"),
    ).withColumn("rows_per_replicate", F.col("n_rows") / F.col("n_replicates"))


def continuous_summary(panel: DataFrame, variables: Sequence[str], by=("technique",)) -> DataFrame:
    """n, mean, sd (ddof 1), min, max per (technique, variable), replicates pooled."""
    return _long(panel, variables, by).groupBy(*by, "variable").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def _real_stats(long: DataFrame, real: str) -> DataFrame:
    return long.filter(F.col("technique") == real).groupBy("variable").agg(
        F.avg("value").alias("real_mean"),
        F.stddev_samp("value").alias("real_sd"),
        F.min("value").alias("real_min"),
        F.max("value").alias("real_max"),
    )


def boundary_adherence(panel: DataFrame, variables: Sequence[str], real: str = REAL, by=("technique",)) -> DataFrame:
    """Share of non-null values inside [min REAL, max REAL], per (technique, variable)."""
    long = _long(panel, variables, by)
    bounds = F.broadcast(_real_stats(long, real).select("variable", "real_min", "real_max"))
    inside = F.col("value").between(F.col("real_min"), F.col("real_max")).cast("double")
    return long.join(bounds, "variable").groupBy(*by, "variable").agg(F.avg(inside).alias("boundary_adherence"))


def category_adherence(panel: DataFrame, variables: Sequence[str], real: str = REAL, by=("technique",)) -> DataFrame:
    """Share of non-null values whose category occurs in REAL (values compared as strings)."""
    counts = _long(panel, variables, by_all := list(dict.fromkeys(["technique", *by])), dtype="string").groupBy(
        *by_all, "variable", "value").agg(F.count(F.lit(1)).alias("_n"))
    cats = counts.filter(F.col("technique") == real).select("variable", "value").distinct().withColumn("_hit", F.lit(True))
    # one row per category on both sides
    return (
        counts.join(cats, ["variable", "value"], "left")
        .groupBy(*by, "variable")
        .agg((F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("category_adherence"))
    )


def boundary_diff(panel: DataFrame, variables: Sequence[str], real: str = REAL) -> DataFrame:
    """mean/sd/min/max per (technique, variable) with differences to REAL."""
    summ = continuous_summary(panel, variables)
    r = summ.filter(F.col("technique") == real).select(
        "variable", F.col("mean").alias("real_mean"), F.col("sd").alias("real_sd"))
    return summ.join(F.broadcast(r), "variable").select(
        "technique", "variable", "n", "mean", "sd", "min", "max",
        (F.col("mean") - F.col("real_mean")).alias("d_mean"),
        (F.col("sd") - F.col("real_sd")).alias("d_sd"),
    )


def missingness(panel: DataFrame, variables: Sequence[str], by=("technique",)) -> DataFrame:
    """Percent null per (technique, variable)."""
    long = melt(panel, list(by), variables)
    return long.groupBy(*by, "variable").agg(
        (F.avg(F.col("value").isNull().cast("double")) * 100.0).alias("missing_pct"))


def range_sanity(panel: DataFrame, variables: Sequence[str], real: str = REAL) -> DataFrame:
    """min/max per technique next to REAL's; equal when both agree after rounding to 2 decimals."""
    summ = continuous_summary(panel, variables)
    r = summ.filter(F.col("technique") == real).select(
        "variable", F.col("min").alias("real_min"), F.col("max").alias("real_max"))
    same = (F.round("min", 2) == F.round("real_min", 2)) & (F.round("max", 2) == F.round("real_max", 2))
    return summ.join(F.broadcast(r), "variable").select(
        "technique", "variable", "real_min", "real_max",
        F.col("min").alias("syn_min"), F.col("max").alias("syn_max"), same.alias("same_as_real"))


def dist_summary(panel: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (),
                 real: str = REAL) -> DataFrame:
    """Per technique: mean |dmu|/sd_real, mean |dsd|/sd_real (variables with sd_real > 0),
    mean boundary adherence; and mean category adherence for ordinal/categorical variables."""
    summ = continuous_summary(panel, continuous)
    r = summ.filter(F.col("technique") == real).select(
        "variable", F.col("mean").alias("rm"), F.col("sd").alias("rs"))
    ba = boundary_adherence(panel, continuous, real)
    cont = (
        summ.join(F.broadcast(r), "variable")
        .join(ba, ["technique", "variable"])
        .groupBy("technique")
        .agg(
            F.avg(F.when(F.col("rs") > 0, F.abs(F.col("mean") - F.col("rm")) / F.col("rs"))).alias("mean_abs_dmu"),
            F.avg(F.when(F.col("rs") > 0, F.abs(F.col("sd") - F.col("rs")) / F.col("rs"))).alias("mean_abs_dsd"),
            F.avg("boundary_adherence").alias("mean_adherence"),
        )
        .withColumn("variable_type", F.lit("continuous"))
    )
    out = cont.select("technique", "variable_type", "mean_abs_dmu", "mean_abs_dsd", "mean_adherence")
    if categorical:
        ca = category_adherence(panel, categorical, real).groupBy("technique").agg(
            F.avg("category_adherence").alias("mean_adherence"))
        out = out.unionByName(ca.select(
            "technique", F.lit("ordinal/categorical").alias("variable_type"),
            F.lit(None).cast("double").alias("mean_abs_dmu"), F.lit(None).cast("double").alias("mean_abs_dsd"),
            "mean_adherence"))
    return out


def value_proportions(panel: DataFrame, variables: Sequence[str], by=("technique",)) -> DataFrame:
    """Share of each category among non-null values, per (technique, variable)."""
    long = _long(panel, variables, by, dtype="string")
    counts = long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = long.groupBy(*by, "variable").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, [*by, "variable"]).select(
        *by, "variable", "value", (F.col("n") / F.col("total")).alias("share"))


def skew_kurtosis(panel: DataFrame, variables: Sequence[str], by=("technique",)) -> DataFrame:
    """Bias-corrected skewness G1 and excess kurtosis G2 (pandas definitions)."""
    long = _long(panel, variables, by)
    g = long.groupBy(*by, "variable").agg(
        F.count("value").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    n = F.col("n").cast("double")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return g.select(*by, "variable", "n",
                    F.when(F.col("n") > 2, skew).alias("skewness"),
                    F.when(F.col("n") > 3, kurt).alias("kurtosis"))


# ----------------------------------------------------------------- exact quantiles

def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key (numpy 'linear' = Spark percentile).

    Distinct (key, value) counts are ranked with the distributed CDF; each quantile
    needs the values at two ranks, found by a join of the CDF with a table of
    targets (keys x probs rows: bounded by metadata).
    """
    keys = list(keys)
    counts = long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("w"))
    cdf = cumulative_counts(counts, keys, value, ["w"])
    totals = cdf.select(*keys, "tot_w").distinct()
    plist = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("q")) for i, p in enumerate(probs)])
    h = (F.col("tot_w") - 1).cast("double") * F.col("q")
    targets = (
        totals.select(*keys, "tot_w", F.explode(plist).alias("_p")).select(*keys, "tot_w", "_p.qi", "_p.q")
        .withColumn("h", h)
        .withColumn("lo", F.floor("h").cast("long"))
        .withColumn("hi", F.least(F.col("lo") + 1, F.col("tot_w") - 1))
        .withColumn("frac", F.col("h") - F.col("lo"))
    )
    ranks = targets.select(*keys, "qi", "q", "frac", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.col("lo").alias("r")),
        F.struct(F.lit("hi").alias("side"), F.col("hi").alias("r")))).alias("t")).select(
        *keys, "qi", "q", "frac", "t.side", "t.r")
    hit = cdf.join(F.broadcast(ranks), keys).filter(
        (F.col("cum_w") - F.col("w") <= F.col("r")) & (F.col("r") < F.col("cum_w")))
    vals = hit.groupBy(*keys, "qi", "q", "frac").agg(
        F.max(F.when(F.col("side") == "lo", F.col(value))).alias("x_lo"),
        F.max(F.when(F.col("side") == "hi", F.col(value))).alias("x_hi"))
    return vals.select(*keys, "q", (F.col("x_lo") + F.col("frac") * (F.col("x_hi") - F.col("x_lo"))).alias("quantile"))


def describe_table(panel: DataFrame, variables: Sequence[str], by=("technique",)) -> DataFrame:
    """mean, sd, min, exact quartiles, max per (technique, variable)."""
    long = _long(panel, variables, by)
    summ = long.groupBy(*by, "variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, [*by, "variable"], "value", [0.25, 0.5, 0.75])
    qw = q.groupBy(*by, "variable").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q25"),
        F.max(F.when(F.col("q") == 0.5, F.col("quantile"))).alias("q50"),
        F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q75"))
    return summ.join(qw, [*by, "variable"]).select(*by, "variable", "n", "mean", "sd", "min", "q25", "q50", "q75", "max")


# ----------------------------------------------------------------- two-sample CDF family

def sample_label(by: Sequence[str]) -> Column:
    """String id of a sample: the technique, or technique#replicate per run."""
    if list(by) == ["technique"]:
        return F.col("technique")
    return F.concat_ws("#", *[F.col(c).cast("string") for c in by])


def paired_grid(panel: DataFrame, variables: Sequence[str], real: str = REAL, by=("technique",)) -> DataFrame:
    """Distinct values of REAL united with each other sample, per (sample, variable):
    rows (technique[, replicate], variable, x, w_r, w_s).  REAL's counts are attached to
    every other sample by an equi-join on ``variable`` with the (sample, variable) list."""
    by = list(by)
    long = _long(panel, variables, by).withColumnRenamed("value", "x")
    is_real = F.col("technique") == real
    syn = long.filter(~is_real).groupBy(*by, "variable", "x").agg(F.count(F.lit(1)).alias("w_s"))
    real_counts = long.filter(is_real).groupBy("variable", "x").agg(F.count(F.lit(1)).alias("w_r"))
    samples = syn.select(*by, "variable").distinct()
    # samples has (#samples x #variables) rows
    real_rep = real_counts.join(F.broadcast(samples), "variable").select(
        *by, "variable", "x", "w_r", F.lit(0).cast("long").alias("w_s"))
    both = syn.select(*by, "variable", "x", F.lit(0).cast("long").alias("w_r"), "w_s").unionByName(real_rep)
    return both.groupBy(*by, "variable", "x").agg(F.sum("w_r").alias("w_r"), F.sum("w_s").alias("w_s"))


def two_sample_cdf(panel: DataFrame, variables: Sequence[str], real: str = REAL, by=("technique",)) -> DataFrame:
    by = list(by)
    grid = paired_grid(panel, variables, real, by)
    cdf = cumulative_counts(grid, [*by, "variable"], "x", ["w_r", "w_s"])
    return cdf.withColumn("f_r", F.col("cum_w_r") / F.col("tot_w_r")).withColumn("f_s", F.col("cum_w_s") / F.col("tot_w_s"))


def wasserstein_1d(panel: DataFrame, variables: Sequence[str], real: str = REAL, by=("technique",)) -> DataFrame:
    """W1 = sum |F_r - F_s| * (x_next - x) over the merged distinct values."""
    by = list(by)
    cdf = two_sample_cdf(panel, variables, real, by)
    return cdf.groupBy(*by, "variable").agg(
        F.coalesce(F.sum(F.abs(F.col("f_r") - F.col("f_s")) * (F.col("x_next") - F.col("x"))), F.lit(0.0))
        .alias("wasserstein"))


def ks_two_sample(panel: DataFrame, variables: Sequence[str], real: str = REAL,
                  by=("technique", "replicate"), min_n: int = 20) -> DataFrame:
    """KS statistic max|F_r - F_s| and asymptotic p-value; null when either side has < min_n values."""
    by = list(by)
    counts = _long(panel, variables, by).withColumnRenamed("value", "x").groupBy(*by, "variable", "x").agg(F.count(F.lit(1)).alias("w"))
    # one order per variable for REAL and all samples: the rows of a value share a slice, at most one row per sample
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
    sliced = materialise(counts.repartitionByRange(n, "variable", "x").withColumn("_slice", F.spark_partition_id()), "ks-slices")
    is_real = F.col("technique") == real
    sliced = sliced.withColumn("w_r", F.when(is_real, F.col("w")).otherwise(F.lit(0)))
    # what lies in earlier slices: at most slices + variables rows, for each sample
    totals = materialise(sliced.groupBy("_slice", "variable", *by).agg(F.sum("w").alias("_t"), F.sum("w_r").alias("_t_r")), "ks-totals")
    before, whole = (lambda *keys: Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), Window.partitionBy
    at = [F.col("_slice").alias("_at"), F.col("variable").alias("_v")]
    of_sample = totals.filter(~is_real).select(
        *at, *[F.col(c).alias(f"_k_{c}") for c in by], F.coalesce(F.sum("_t").over(before("variable", *by)), F.lit(0)).alias("_o"),
        F.sum("_t").over(whole("variable", *by)).alias("n_s"))
    of_real = totals.groupBy("_slice", "variable").agg(F.sum("_t_r").alias("_t_r")).select(
        *at, F.coalesce(F.sum("_t_r").over(before("variable")), F.lit(0)).alias("_o_r"), F.sum("_t_r").over(whole("variable")).alias("n_r"))
    ordered = Window.partitionBy("_slice", "variable").orderBy("x")
    running = sliced.select(
        "_slice", "variable", *by, "x", "w", F.sum("w_r").over(ordered.rangeBetween(Window.unboundedPreceding, 0)).alias("_c_r"),
        F.sum("w_r").over(ordered.rangeBetween(0, 0)).alias("_e_r")).filter(~is_real)
    own = Window.partitionBy("_slice", "variable", *by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = running.withColumn("_c", F.sum("w").over(own))
    here = (F.col("_slice") == F.col("_at")) & (F.col("variable") == F.col("_v"))
    same = here
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    j = running.join(F.broadcast(of_sample), same).drop("_at", "_v").join(F.broadcast(of_real), here)
    # between two values of the sample its CDF is constant, so the largest gap lies at a value or just before it
    cum_r, cum = F.col("_o_r") + F.col("_c_r"), F.col("_o") + F.col("_c")
    f_r, f_before = cum_r / F.col("n_r"), (cum_r - F.col("_e_r")) / F.col("n_r")
    f_s, s_before = cum / F.col("n_s"), (cum - F.col("w")) / F.col("n_s")
    g = j.groupBy(*by, "variable").agg(
        F.max(F.greatest(F.abs(f_r - f_s), F.abs(f_before - s_before))).alias("d"), F.first("n_r").alias("n_r"), F.first("n_s").alias("n_s"))
    ok = (F.col("n_r") >= min_n) & (F.col("n_s") >= min_n)
    nr, ns = F.col("n_r").cast("double"), F.col("n_s").cast("double")
    en = nr * ns / (nr + ns)
    return g.select(*by, "variable",
                    F.when(ok, F.col("d")).alias("ks_stat"),
                    F.when(ok, kolmogorov_sf(F.sqrt(en) * F.col("d"))).alias("ks_pvalue"))


def _category_shares(panel: DataFrame, variables, real, by, na_label=None):
    by = list(by)
    long = melt(panel, by, variables, dtype="string")
    if na_label is None:
        long = long.filter(F.col("value").isNotNull())
    else:
        long = long.withColumn("value", F.coalesce(F.col("value"), F.lit(na_label)))
    counts = long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*by, "variable"))
    shares = counts.withColumn("p", F.col("n") / tot)
    is_real = F.col("technique") == real
    r = shares.filter(is_real).select("variable", "value", F.col("p").alias("p_r"))
    s = shares.filter(~is_real).select(*by, "variable", "value", F.col("p").alias("p_s"))
    samples = s.select(*by, "variable").distinct()
    r_rep = r.join(F.broadcast(samples), "variable")
    return s.join(r_rep, [*by, "variable", "value"], "full_outer").select(
        *by, "variable", "value", F.coalesce("p_r", F.lit(0.0)).alias("p_r"), F.coalesce("p_s", F.lit(0.0)).alias("p_s"))


def js_distance(panel: DataFrame, variables: Sequence[str], real: str = REAL, by=("technique",)) -> DataFrame:
    """Jensen-Shannon distance sqrt(JSD), natural log, between category shares."""
    by = list(by)
    pq = _category_shares(panel, variables, real, by)
    m = (F.col("p_r") + F.col("p_s")) / 2
    term = (F.when(F.col("p_r") > 0, F.col("p_r") * F.log(F.col("p_r") / m)).otherwise(0.0)
            + F.when(F.col("p_s") > 0, F.col("p_s") * F.log(F.col("p_s") / m)).otherwise(0.0))
    return pq.groupBy(*by, "variable").agg(F.sqrt(F.greatest(F.sum(term) / 2, F.lit(0.0))).alias("js_distance"))


def tvd_categorical(panel: DataFrame, variables: Sequence[str], real: str = REAL,
                    by=("technique", "replicate")) -> DataFrame:
    """Total variation distance, nulls as their own category ``__NA__``."""
    by = list(by)
    pq = _category_shares(panel, variables, real, by, na_label="__NA__")
    return pq.groupBy(*by, "variable").agg((F.sum(F.abs(F.col("p_r") - F.col("p_s"))) / 2).alias("tvd"))


def hist_overlap(panel: DataFrame, variables: Sequence[str], real: str = REAL,
                 by=("technique", "replicate"), bins: int = 20, min_n: int = 20) -> DataFrame:
    """Overlap of two densities on ``bins`` equal bins over the joint range (last bin closed)."""
    by = list(by)
    long = _long(panel, variables, by)
    is_real = F.col("technique") == real
    rstat = long.filter(is_real).groupBy("variable").agg(
        F.min("value").alias("r_lo"), F.max("value").alias("r_hi"), F.count(F.lit(1)).alias("n_r"))
    sstat = long.filter(~is_real).groupBy(*by, "variable").agg(
        F.min("value").alias("s_lo"), F.max("value").alias("s_hi"), F.count(F.lit(1)).alias("n_s"))
    rng = sstat.join(F.broadcast(rstat), "variable").select(
        *by, "variable", "n_r", "n_s",
        F.least("r_lo", "s_lo").alias("lo"), F.greatest("r_hi", "s_hi").alias("hi"))
    valid = rng.filter((F.col("n_r") >= min_n) & (F.col("n_s") >= min_n) & (F.col("hi") > F.col("lo")))

    def binned(x: Column) -> Column:
        return F.least(F.floor((x - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                       F.lit(bins - 1)).cast("int")

    # synthetic side: each row meets the range of its own sample
    s_counts = long.filter(~is_real).join(F.broadcast(valid.select(*by, "variable", "lo", "hi")), [*by, "variable"]) \
        .groupBy(*by, "variable", binned(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("c_s"))
    # REAL side: REAL values binned once per sample range (REAL counted on distinct values first)
    r_vals = long.filter(is_real).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("c"))
    r_counts = r_vals.join(F.broadcast(valid.select(*by, "variable", "lo", "hi")), "variable") \
        .groupBy(*by, "variable", binned(F.col("value")).alias("bin")).agg(F.sum("c").alias("c_r"))
    both = s_counts.join(r_counts, [*by, "variable", "bin"], "full_outer").join(
        F.broadcast(valid.select(*by, "variable", "n_r", "n_s")), [*by, "variable"])
    ov = both.groupBy(*by, "variable").agg(F.sum(F.least(
        F.coalesce(F.col("c_r"), F.lit(0)) / F.col("n_r"), F.coalesce(F.col("c_s"), F.lit(0)) / F.col("n_s"))).alias("overlap"))
    return rng.select(*by, "variable").join(ov, [*by, "variable"], "left")


def marginal_metrics(panel: DataFrame, numeric: Sequence[str], categorical: Sequence[str], real: str = REAL,
                     alpha: float = 0.05) -> DataFrame:
    """Per (technique, replicate): mean KS, share of variables with p < alpha, mean overlap,
    mean TVD; then averaged over replicates per technique (mean of runs, not pooled)."""
    by = ["technique", "replicate"]
    ks = ks_two_sample(panel, numeric, real, by)
    ov = hist_overlap(panel, numeric, real, by)
    per_run = ks.join(ov, [*by, "variable"], "full_outer").groupBy(*by).agg(
        F.avg("ks_stat").alias("ks_mean"),
        F.avg(F.when(F.col("ks_pvalue").isNotNull(), (F.col("ks_pvalue") < alpha).cast("double"))).alias("ks_sig_frac"),
        F.avg("overlap").alias("hist_overlap_mean"))
    if categorical:
        tv = tvd_categorical(panel, categorical, real, by).groupBy(*by).agg(F.avg("tvd").alias("tvd_cat_mean"))
        per_run = per_run.join(tv, by, "full_outer")
    else:
        per_run = per_run.withColumn("tvd_cat_mean", F.lit(None).cast("double"))
    return per_run.groupBy("technique").agg(
        F.countDistinct("replicate").alias("runs_used"),
        *[F.avg(c).alias(c) for c in ["ks_mean", "ks_sig_frac", "hist_overlap_mean", "tvd_cat_mean"]])
