"""Disclosure-risk operators over the panel.

Distance metrics run on the exact grid kNN (``knn.py``); tuple metrics are
equi-joins on distinct tuples with counts, so a frequent tuple is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators.hamming import nearest_tuples
from fidelis.operators.knn import knn
from fidelis.operators.marginal import exact_quantiles
from fidelis.operators.pairs import PairDistances
from fidelis.session import materialise

REAL = "REAL"
DATASET = ["technique", "replicate"]


def _split(panel: DataFrame, real: str):
    is_real = F.col("technique") == real
    return panel.filter(is_real), panel.filter(~is_real)


def exact_match_rate(panel: DataFrame, columns: Sequence[str], real: str = REAL, by=DATASET) -> DataFrame:
    """Share of synthetic rows whose whole tuple occurs in REAL (duplicates count; nulls never match)."""
    r, s = _split(panel, real)
    tuples = r.select(*columns).distinct().withColumn("_hit", F.lit(1))
    counts = s.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(tuples, list(columns), "left").groupBy(*by).agg(
        (F.sum(F.when(F.col("_hit").isNotNull(), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("exact_match_rate"))


def nn_distances(panel: DataFrame, features: Sequence[str], k: int = 1, real: str = REAL, by=DATASET,
                 row_id: str = "row_id") -> DataFrame:
    """k nearest REAL rows of every synthetic row: (dataset, row_id, rank, dist, ref_id)."""
    r, s = _split(panel, real)
    return knn(s, r, features, k, query_id=row_id, ref_id=row_id, carry=list(by))


def nn_distance_mean(nn: DataFrame, by=DATASET) -> DataFrame:
    """Mean distance to the closest REAL row (the reference labels this 'NNDR'; no ratio is taken)."""
    return nn.filter(F.col("rank") == 1).groupBy(*by).agg(F.avg("dist").alias("nn_distance_mean"))


def dcr(nn: DataFrame, by=DATASET) -> DataFrame:
    """Distance to closest record: mean, min and exact 5th percentile per dataset."""
    # written: the mean and the percentile read it, and the search must not run for each
    d1 = materialise(nn.filter(F.col("rank") == 1).select(*by, "dist"), "dcr")
    base = d1.groupBy(*by).agg(F.avg("dist").alias("dcr_mean"), F.min("dist").alias("dcr_min"))
    p05 = exact_quantiles(d1, list(by), "dist", [0.05]).select(*by, F.col("quantile").alias("dcr_p05"))
    return base.join(p05, list(by), "left")


def k_distance(nn: DataFrame, k: int = 5, by=DATASET) -> DataFrame:
    kth = nn.filter(F.col("rank") == k)
    return kth.groupBy(*by).agg(F.avg("dist").alias("mean_k_distance"), F.min("dist").alias("min_k_distance"))


MEMBERSHIP_SHARE = 0.01  # fixed value: the radius is the first percentile of all distances


def membership_proxy(panel: DataFrame, nn: DataFrame, features: Sequence[str], real: str = REAL, by=DATASET,
                     row_id: str = "row_id", share: float = MEMBERSHIP_SHARE) -> DataFrame:
    """Share of synthetic rows nearer to a REAL row than the first percentile of all distances to REAL (strictly).

    ``nn`` are the dataset's ``nn_distances``.  The percentile is exact (``pairs.py``): it comes from counts of
    node pairs, no pair of rows is emitted.  Also: the radius, the pairs and how many of them were expanded."""
    r, s = _split(panel, real)
    found = PairDistances(s, r, features, by, row_id).quantile(share)
    schema = T.StructType([panel.schema[c] for c in by] + [
        T.StructField("radius", T.DoubleType()), T.StructField("pairs", T.LongType()), T.StructField("expanded", T.LongType())])
    radius = panel.sparkSession.createDataFrame([(*[x[c] for c in by], x["value"], x["pairs"], x["expanded"]) for x in found], schema)
    first = nn.filter(F.col("rank") == 1).join(radius, list(by))
    return first.groupBy(*by).agg(
        F.avg((F.col("dist") < F.col("radius")).cast("double")).alias("membership_inference"),
        *[F.first(c).alias(c) for c in ("radius", "pairs", "expanded")])


def attribute_disclosure(panel: DataFrame, qi: Sequence[str], sensitive: str, real: str = REAL, by=DATASET,
                         row_id: str = "row_id") -> DataFrame:
    """Nearest REAL row by one-hot QIs (= most equal QIs, first row on ties); share of synthetic
    rows whose sensitive value equals that row's.

    Works on distinct QI tuples (``hamming.py``), so a frequent tuple is looked up once."""
    qi = list(qi)
    r, s = _split(panel, real)
    best = nearest_tuples(s, r, qi, row_id)
    owner = r.select(F.col(row_id).alias("ref_id"), F.col(sensitive).alias("_sens_r"))
    best = best.join(owner, "ref_id", "left").select(*[F.col(c).alias(f"_q_{c}") for c in qi], "_sens_r")
    counts = s.groupBy(*by, *qi, sensitive).agg(F.count(F.lit(1)).alias("_n"))
    on = [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in qi]
    j = counts.join(best, on, "left")
    return j.groupBy(*by).agg((F.sum(F.when(F.col(sensitive) == F.col("_sens_r"), F.col("_n")).otherwise(0))
                               / F.sum("_n")).alias(f"attribute_disclosure_{sensitive}"))


def qi_linkability(panel: DataFrame, qi: Sequence[str], real: str = REAL, by=DATASET, k_risk: int = 5) -> DataFrame:
    """QI tuple match rate, unique-match rate, mean equivalence-class size of matches, share with class <= 5."""
    qi = list(qi)
    r, s = _split(panel, real)
    as_str = [F.coalesce(F.col(c).cast("string"), F.lit("__NA__")).alias(c) for c in qi]
    classes = r.select(*as_str).groupBy(*qi).agg(F.count(F.lit(1)).alias("_k"))
    st = s.select(*by, *as_str).groupBy(*by, *qi).agg(F.count(F.lit(1)).alias("_n"))
    j = st.join(classes, qi, "left")
    n = F.sum("_n")
    return j.groupBy(*by).agg(
        (F.sum(F.when(F.col("_k").isNotNull(), F.col("_n")).otherwise(0)) / n).alias("qi_match_rate"),
        (F.sum(F.when(F.col("_k") == 1, F.col("_n")).otherwise(0)) / n).alias("qi_unique_match_rate"),
        (F.sum(F.col("_k") * F.col("_n")) / F.sum(F.when(F.col("_k").isNotNull(), F.col("_n")))).alias("qi_avg_equiv_class_size"),
        (F.sum(F.when(F.col("_k") <= k_risk, F.col("_n")).otherwise(0)) / n).alias("qi_high_risk_rate"))


def common_columns(panel: DataFrame, features: Sequence[str], real: str = REAL, by=DATASET, min_filled: float = 0.9) -> list[tuple[dict, tuple[str, ...]]]:
    """Per synthetic dataset (one row each): its features that are at least ``min_filled`` filled there and in REAL."""
    share = panel.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"_f_{c}") for c in features]).collect()
    filled = {c for c in features if all(r[f"_f_{c}"] >= min_filled for r in share if r["technique"] == real)}
    return [({c: r[c] for c in by}, tuple(c for c in features if c in filled and r[f"_f_{c}"] >= min_filled)) for r in share if r["technique"] != real]


def dcr_standardized(panel: DataFrame, features: Sequence[str], real: str = REAL, by=DATASET,
                     row_id: str = "row_id", min_filled: float = 0.9) -> DataFrame:
    """Both directions on REAL-standardised columns (ddof 0, sd < 1e-8 -> 1), columns at least
    90 % filled on both sides, complete rows: mean, min, p01, p05, p50 of the NN distance.

    The columns are chosen per dataset; datasets with the same columns share one search."""
    groups: dict[tuple[str, ...], list[dict]] = {}
    for dataset, keep in common_columns(panel, features, real, by, min_filled):
        groups.setdefault(keep, []).append(dataset)
    out = None
    for keep, datasets in sorted(groups.items()):
        if not keep:
            continue  # no common column, no distance
        chosen = F.array(*[F.struct(*[F.lit(x[c]).alias(c) for c in by]) for x in datasets])
        mine = panel.filter((F.col("technique") == real) | F.array_contains(chosen, F.struct(*by)))
        part = _dcr_on(mine, list(keep), real, by, row_id)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no dataset shares a column with REAL")
    return out


def _dcr_on(panel: DataFrame, keep: list[str], real: str, by, row_id: str) -> DataFrame:
    r, s = _split(panel, real)
    rc = r.dropna(subset=keep)
    stats = rc.select(*[F.avg(c).alias(f"m_{c}") for c in keep], *[F.stddev_pop(c).alias(f"s_{c}") for c in keep]).first()
    z = []
    for c in keep:
        sd = stats[f"s_{c}"]
        sd = 1.0 if sd is None or sd < 1e-8 else sd
        z.append(((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(sd)).alias(c))
    rz = rc.select(*by, row_id, *z)
    sz = s.dropna(subset=keep).select(*by, row_id, *z)
    s2r = knn(sz, rz, keep, 1, query_id=row_id, ref_id=row_id, carry=list(by)).select(*by, "dist")
    s2r = materialise(s2r, "dcr")  # read more than once below, like r2s
    datasets = sz.select(*by).distinct()
    # REAL rows meet every synthetic dataset separately: queries keyed by dataset
    rq = _replicate(rz.drop(*by), datasets)
    r2s = knn(rq, sz, keep, 1, query_id=row_id, ref_id=row_id, keys=list(by)).select(*by, "dist")
    r2s = materialise(r2s, "dcr")
    out = None
    for name, d in (("dcr_r2s", r2s), ("dcr_s2r", s2r)):
        base = d.groupBy(*by).agg(F.avg("dist").alias(f"{name}_mean"), F.min("dist").alias(f"{name}_min"))
        q = exact_quantiles(d, list(by), "dist", [0.01, 0.05, 0.5]).groupBy(*by).agg(
            *[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(f"{name}_{lab}")
              for p, lab in ((0.01, "p01"), (0.05, "p05"), (0.5, "p50"))])
        part = base.join(q, list(by))
        out = part if out is None else out.join(part, list(by), "full_outer")
    return out.withColumn("dcr_common_features", F.lit(len(keep)))


def _replicate(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """Attach every dataset key to every row by one explode over the dataset list.

    The list is one row per replicate; work grows as rows x datasets, which the
    comparison needs anyway."""
    cols = datasets.columns
    listed = F.array(*[F.struct(*[F.lit(k[c]).alias(c) for c in cols]) for k in datasets.collect()])
    return rows.select(F.explode(listed).alias("_d"), *rows.columns).select("_d.*", *rows.columns)
