"""Table synthesis that is data work: Gaussian copula, clipping, latent
simulation, seeded conditioning.  Randomness comes from hashes of (row id, stream,
seed), never from ``rand``: results do not depend on partitioning or retries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.operators.marginal import exact_quantiles
from fidelis.operators.reshape import melt

_TWO53 = float(2 ** 53)


def uniform(key: Column, stream: int, seed: int) -> Column:
    """U(0,1) from a 64-bit hash of (key, stream, seed); never exactly 0 or 1."""
    h = F.xxhash64(key, F.lit(stream), F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(_TWO53)


def normal(key: Column, stream: int, seed: int) -> Column:
    """Standard normal by Box-Muller from two hashed uniforms."""
    u1, u2 = uniform(key, 2 * stream, seed), uniform(key, 2 * stream + 1, seed)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def discretize_clip(c: Column, lo: float, hi: float) -> Column:
    """Round half-even to an integer and clip to [lo, hi]."""
    return F.least(F.greatest(F.bround(c, 0), F.lit(float(lo))), F.lit(float(hi)))


MAX_LEVELS = 1_000  # categories of a discrete column
MAX_PATTERNS = 4_096  # different null patterns
CALIBRATION = 8_192  # normal pairs that carry a rank correlation over to the normal scale


def nearest_correlation(a: np.ndarray, floor: float = 1e-6, rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Nearest correlation matrix: alternating projections onto matrices with eigenvalues of at least ``floor`` and
    onto those with a unit diagonal, with the correction of the former carried along."""
    y, fix = (a + a.T) / 2, np.zeros_like(a)
    for _ in range(rounds):
        r = y - fix
        w, v = np.linalg.eigh(r)
        x = (v * np.maximum(w, floor)) @ v.T
        fix = x - r
        last, y = y, x.copy()
        np.fill_diagonal(y, 1.0)
        if np.abs(y - last).max() < tol:
            break
    # the last projection was onto the unit diagonal: give back the floor
    w, v = np.linalg.eigh(y)
    x = (v * np.maximum(w, floor)) @ v.T
    d = np.sqrt(np.diag(x))
    return x / d[:, None] / d[None, :]


def _scores(z: np.ndarray, cuts: np.ndarray | None) -> np.ndarray:
    """Mid-ranks of normals whose column is continuous (no cuts) or cut into categories at cumulative shares."""
    order = (np.argsort(np.argsort(z)) + 0.5) / len(z)
    if cuts is None:
        return order
    edges = np.concatenate([[0.0], cuts])
    at = np.minimum(np.searchsorted(cuts, order, "left"), len(cuts) - 1)
    return (edges[at] + edges[at + 1]) / 2


def normal_correlation(rho: float, cuts_a: np.ndarray | None, cuts_b: np.ndarray | None) -> float:
    """Correlation of two normals whose columns then have Spearman's ``rho``: in closed form for two continuous columns,
    else by bisection over ``CALIBRATION`` fixed pairs of normals (categories weaken a rank correlation)."""
    if cuts_a is None and cuts_b is None:
        return 2 * math.sin(math.pi * rho / 6)
    rng = np.random.default_rng(20)
    u, v = rng.standard_normal(CALIBRATION), rng.standard_normal(CALIBRATION)
    low, high = -1.0, 1.0
    sa = _scores(u, cuts_a)
    for _ in range(30):
        mid = (low + high) / 2
        sb = _scores(mid * u + math.sqrt(max(0.0, 1 - mid * mid)) * v, cuts_b)
        got = np.corrcoef(sa, sb)[0, 1] if sa.std() > 0 and sb.std() > 0 else 0.0
        low, high = (mid, high) if got < rho else (low, mid)
    return (low + high) / 2


def copula_fit(real: DataFrame, continuous: Sequence[str], discrete: Sequence[str] = (), grid: int = 200, row_key: str = "row_id") -> dict:
    """Marginals, normal correlation and null patterns of ``real``.

    ``tables``: continuous column -> ``grid`` exact quantiles; ``levels``: discrete column -> values in order and their
    cumulative shares; ``corr``: normal correlation matrix, projected to the nearest one that is positive definite;
    ``patterns``: (null columns, cumulative share).  All are bounded by columns, levels and patterns, not by rows."""
    from fidelis.operators.dependency import corr_spearman

    continuous, discrete = list(continuous), list(discrete)
    items = [*continuous, *discrete]
    probs = [i / (grid - 1) for i in range(grid)]
    tables: dict = {}
    if continuous:
        long = melt(real.withColumn("_g", F.lit(0)), ["_g"], continuous, drop_nulls=True)
        q = exact_quantiles(long, ["variable"], "value", probs).collect()
        tables = {it: [x for _, x in sorted((r["q"], r["quantile"]) for r in q if r["variable"] == it)] for it in continuous}
    levels, coded = {}, real
    for it in discrete:
        counts = real.filter(F.col(it).isNotNull()).groupBy(it).count().orderBy(it).limit(MAX_LEVELS + 1).collect()
        if len(counts) > MAX_LEVELS:
            raise ValueError(f"{it} has more than {MAX_LEVELS} values: treat it as continuous")
        total = sum(r["count"] for r in counts)
        levels[it] = ([r[it] for r in counts], np.cumsum([r["count"] / total for r in counts]))
        # categories are ordered by value: their number is the rank that correlations see
        codes = F.array(*[F.lit(v) for v in levels[it][0]])
        coded = coded.withColumn(it, F.when(F.col(it).isNotNull(), F.array_position(codes, F.col(it)).cast("double")))
    masks = real.groupBy(F.concat(*[F.col(it).isNull().cast("int").cast("string") for it in items]).alias("mask")).count()
    masks = masks.orderBy("mask").limit(MAX_PATTERNS + 1).collect()
    if len(masks) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} null patterns")
    shares = np.cumsum([r["count"] for r in masks]) / sum(r["count"] for r in masks)
    corr = np.eye(len(items))
    idx = {v: i for i, v in enumerate(items)}
    if len(items) > 1:
        cuts = {it: levels[it][1] if it in levels else None for it in items}
        for r in corr_spearman(coded.withColumn("_g", F.lit(0)).select("_g", row_key, *items), items, ["_g"], row_key=row_key).collect():
            a, b = r["var_i"], r["var_j"]
            corr[idx[a], idx[b]] = corr[idx[b], idx[a]] = normal_correlation(r["r"] or 0.0, cuts[a], cuts[b])
    return {"items": items, "tables": tables, "levels": levels, "corr": nearest_correlation(corr),
            "patterns": [(r["mask"], float(s)) for r, s in zip(masks, shares)], "types": {it: real.schema[it].dataType for it in items}}


def _passed(shares: Sequence[float], u: Column) -> Column:
    """How many of the cumulative ``shares`` are at most ``u``."""
    return F.size(F.filter(F.array(*[F.lit(s) for s in shares]), lambda s: s <= u))


def copula_sample(spark, fit: dict, n: int, seed: int = 42) -> DataFrame:
    """n rows: correlated normals (Cholesky as linear column expressions), mapped through the normal CDF to each column's
    quantiles or levels; the row's null pattern is drawn on its own.  Values never leave REAL's range."""
    from fidelis.functions.stats import with_normal_cdf

    items, tables, levels = fit["items"], fit["tables"], fit["levels"]
    lchol = np.linalg.cholesky(fit["corr"])
    base = spark.range(n).withColumnRenamed("id", "row_id")
    # step by step, so that no long expression is repeated inside another
    normals = base.select("row_id", *[normal(F.col("row_id"), k, seed).alias(f"_z{k}") for k in range(len(items))])
    mixed = normals.select("row_id", *[sum((F.lit(float(lchol[i, j])) * F.col(f"_z{j}") for j in range(1, i + 1)),
                                           F.lit(float(lchol[i, 0])) * F.col("_z0")).alias(f"_n{i}") for i in range(len(items))])
    draw = uniform(F.col("row_id"), 2 * len(items), seed)
    # the first pattern whose cumulative share is above the draw
    pattern = F.get(F.array(*[F.lit(m) for m, _ in fit["patterns"]]), F.least(_passed([s for _, s in fit["patterns"]], draw), F.lit(len(fit["patterns"]) - 1)))
    names = [f"_u{i}" for i in range(len(items))]
    ranks = with_normal_cdf(mixed.toDF("row_id", *names), names, [F.col("row_id"), pattern.alias("_mask")])
    out = [F.col("row_id")]
    for i, it in enumerate(items):
        u = F.col(f"_u{i}")
        if it in levels:
            values, cum = levels[it]
            if not values:
                out.append(F.lit(None).cast(fit["types"][it]).alias(it))
                continue
            at = F.least(_passed([float(c) for c in cum], u), F.lit(len(values) - 1))
            value = F.get(F.array(*[F.lit(v) for v in values]), at).cast(fit["types"][it])
        else:
            points = tables[it]
            if not points:
                out.append(F.lit(None).cast("double").alias(it))
                continue
            # the grid of probabilities is even: a position in the quantile table, then linear between two entries
            table, last = F.array(*[F.lit(float(x)) for x in points]), len(points) - 1
            place = u * last
            at = F.least(F.floor(place), F.lit(last - 1)).cast("int")
            low, high = F.get(table, at), F.get(table, at + 1)
            value = F.least(F.greatest(low + (place - at) * (high - low), F.lit(float(points[0]))), F.lit(float(points[-1])))
        out.append(F.when(F.substring("_mask", i + 1, 1) == "0", value).alias(it))
    return ranks.select(*out)


def copula_synthesize(spark, real: DataFrame, items: Sequence[str], n: int, seed: int = 42, grid: int = 200, discrete: Sequence[str] = ()) -> DataFrame:
    """n synthetic rows of a Gaussian copula over continuous ``items`` and ``discrete`` (ordinal or categorical) columns."""
    return copula_sample(spark, copula_fit(real, items, discrete, grid), n, seed)


def latent_simulate(df: DataFrame, betas: dict[str, float], r2: float, out: str, key: str = "row_id",
                    seed: int = 7) -> DataFrame:
    """latent = sum beta * x + N(0, sqrt(1 - R2)) from stored path estimates."""
    lin = None
    for c, b in betas.items():
        t = F.lit(float(b)) * F.col(c)
        lin = t if lin is None else lin + t
    return df.withColumn(out, lin + F.lit(math.sqrt(max(0.0, 1.0 - r2))) * normal(F.col(key), 0, seed))


def condition_seed(spark, real: DataFrame, column: str, n: int, key: str = "row_id", seed: int = 11) -> DataFrame:
    """n rows whose ``column`` is drawn with replacement from REAL (other columns null):
    hashed draw -> position in REAL's ``key`` order -> equi-join."""
    from fidelis.operators.order import with_row_index

    ranked = with_row_index(real.select(key, column), [key], "_k")
    m = real.count()
    draws = spark.range(n).withColumnRenamed("id", "row_id").withColumn(
        "_k", (F.floor(uniform(F.col("row_id"), 0, seed) * m) + 1).cast("long"))
    return draws.join(ranked.select("_k", column), "_k").select("row_id", column)


def impute_zero_variance(syn: DataFrame, real: DataFrame, items: Sequence[str], by=("technique", "replicate"),
                         key: str = "row_id", seed: int = 5, jitter: float = 0.3, min_sd: float = 0.1) -> DataFrame:
    """A synthetic column that is constant gets values drawn from REAL's values; one with
    sd < 0.1 gets +-0.3 uniform jitter, clipped to REAL's range."""
    from fidelis.operators.order import with_row_index
    from fidelis.session import materialise

    by = list(by)
    st = materialise(syn.groupBy(*by).agg(
        *[F.stddev_samp(i).alias(f"_s_{i}") for i in items],
        *[(F.coalesce(F.min(i) == F.max(i), F.lit(True))).alias(f"_c_{i}") for i in items]), "variance")
    constant = st.agg(*[F.max(f"_c_{i}").alias(i) for i in items]).first()
    rng = real.agg(*[F.min(i).alias(f"_lo_{i}") for i in items], *[F.max(i).alias(f"_hi_{i}") for i in items]).first()
    m = real.count()
    j = syn.join(F.broadcast(st), by)
    out = j
    drawn = [it for it in items if constant[it]]
    # REAL is ordered once, and only if a column is constant somewhere
    ranks = with_row_index(real.select(key, *drawn), [key], "_p") if drawn else None
    for k, it in enumerate(items):
        pos = (F.floor(uniform(F.col(key), 100 + k, seed) * m) + 1).cast("long")
        if it in drawn:
            ranked = ranks.select(F.col("_p").alias(f"_p{k}"), F.col(it).alias(f"_draw_{it}"))
            out = out.withColumn(f"_p{k}", pos).join(ranked, f"_p{k}", "left")
        draw = F.col(f"_draw_{it}") if it in drawn else F.lit(None)
        jit = (uniform(F.col(key), 200 + k, seed) * 2 - 1) * jitter
        clipped = F.least(F.greatest(F.col(it) + jit, F.lit(rng[f"_lo_{it}"])), F.lit(rng[f"_hi_{it}"]))
        out = out.withColumn(it, F.when(F.col(f"_c_{it}"), draw)
                             .when(F.col(f"_s_{it}") < min_sd, clipped).otherwise(F.col(it)))
    return out.select(*syn.columns)
