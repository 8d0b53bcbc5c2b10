"""Dependency operators from one moment table per dataset.

``moments`` is a single pass over rows: each partition emits centred partial
co-moments (one p x p block per dataset, Arrow/numpy) that are merged with Chan's
formula as ordinary aggregations; a p^2-wide aggregate expression list would
overflow whole-stage codegen.  Everything after that works on p x p rows per dataset.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators.order import ranked_rows

DATASET = ("technique", "replicate")


def pairs(variables: Sequence[str], diagonal: bool = False):
    vs = list(variables)
    out = list(itertools.combinations(vs, 2))
    if diagonal:
        out = [(v, v) for v in vs] + out
    return out


def _pair_partials(by: list[str], variables: list[str]):
    """mapInPandas body: per partition and dataset, pairwise-complete centred co-moments."""

    def run(batches):
        # per dataset: sums about the means of its first batch, added up batch by batch
        acc: dict = {}
        p = len(variables)
        for batch in batches:
            for key, g in batch.groupby(by, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                x = g[variables].to_numpy(dtype=np.float64)
                m = ~np.isnan(x)
                if key not in acc:
                    some = m.any(axis=0)
                    acc[key] = [np.where(some, np.where(m, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1), 0.0),
                                *[np.zeros((p, p)) for _ in range(4)], 0]
                a = acc[key]
                mf = m.astype(np.float64)
                x0 = np.where(m, x - a[0], 0.0)
                for k, part in enumerate((mf.T @ mf, x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0), start=1):
                    a[k] += part
                a[5] += len(x)
        out = []
        for key, (shift, n, s1, s2, sx, nrow) in acc.items():
            with np.errstate(invalid="ignore", divide="ignore"):
                for i in range(p):
                    for j in range(i + 1, p):
                        nij = n[i, j]
                        if nij == 0:
                            out.append((*key, variables[i], variables[j], 0, np.nan, np.nan, 0.0, 0.0, 0.0, nrow))
                            continue
                        mi, mj = s1[i, j] / nij, s1[j, i] / nij
                        out.append((*key, variables[i], variables[j], int(nij), shift[i] + mi, shift[j] + mj,
                                    s2[i, j] - s1[i, j] * mi, s2[j, i] - s1[j, i] * mj, sx[i, j] - s1[i, j] * mj, nrow))
        if out:
            yield pd.DataFrame(out, columns=[*by, "var_i", "var_j", "n", "mean_i", "mean_j", "m2_i", "m2_j", "c", "nrow"])

    return run


_PARTIAL = ("n", "mean_i", "mean_j", "m2_i", "m2_j", "c", "nrow")


def _partial_schema(df: DataFrame, by: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[b] for b in by] + [T.StructField("var_i", T.StringType()), T.StructField("var_j", T.StringType())] + [
        T.StructField(f, T.LongType() if f in ("n", "nrow") else T.DoubleType()) for f in _PARTIAL])


def moment_partials(df: DataFrame, variables: Sequence[str], by: Sequence[str] = DATASET) -> DataFrame:
    """Centred partial co-moments: one row per partition, dataset and pair i < j, from one pass over the rows."""
    by, variables = list(by), list(variables)
    schema = _partial_schema(df, by)
    src = df.select(*by, *[F.col(v).cast("double").alias(v) for v in variables])
    return src.mapInPandas(_pair_partials(by, variables), schema)


def combine_partials(partials: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Partials merged to one row per dataset and pair with Chan's formula; partials of other runs may be among them."""
    keys = [*by, "var_i", "var_j"]

    def merge(acc, x):
        n = acc["n"] + x["n"]
        di, dj = x["mean_i"] - acc["mean_i"], x["mean_j"] - acc["mean_j"]
        w = acc["n"] * x["n"] / n
        merged = F.struct(
            n.alias("n"), (acc["mean_i"] + di * x["n"] / n).alias("mean_i"), (acc["mean_j"] + dj * x["n"] / n).alias("mean_j"),
            (acc["m2_i"] + x["m2_i"] + di * di * w).alias("m2_i"), (acc["m2_j"] + x["m2_j"] + dj * dj * w).alias("m2_j"),
            (acc["c"] + x["c"] + di * dj * w).alias("c"), (acc["nrow"] + x["nrow"]).alias("nrow"))
        # a partial without complete rows has no means: only its rows count
        none = F.struct(*[(acc[f] + x["nrow"] if f == "nrow" else acc[f]).alias(f) for f in _PARTIAL])
        return F.when(x["n"] == 0, none).otherwise(merged)

    zero = F.struct(*[F.lit(0 if f in ("n", "nrow") else 0.0).cast("long" if f in ("n", "nrow") else "double").alias(f) for f in _PARTIAL])
    # one struct per partition and run: bounded by their number, not by rows
    parts = partials.groupBy(*keys).agg(F.collect_list(F.struct(*_PARTIAL)).alias("_p"))
    return parts.select(*keys, F.aggregate("_p", zero, merge).alias("_m")).select(*keys, "_m.*")


def moments_of(partials: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """The moment table of combined partials."""
    den = F.col("n") - 1
    m2i, m2j, c = F.col("m2_i"), F.col("m2_j"), F.col("c")
    some = lambda x: F.when(F.col("n") > 0, F.col(x))
    return partials.select(
        *by, "var_i", "var_j", "n", some("mean_i").alias("mean_i"), some("mean_j").alias("mean_j"),
        F.when(den > 0, F.sqrt(m2i / den)).alias("sd_i"),
        F.when(den > 0, F.sqrt(m2j / den)).alias("sd_j"),
        F.when(den > 0, c / den).alias("cov"),
        F.when((m2i > 0) & (m2j > 0), c / F.sqrt(m2i * m2j)).alias("corr"),
        F.col("nrow").alias("n_rows"))


def moments(df: DataFrame, variables: Sequence[str], by: Sequence[str] = DATASET) -> DataFrame:
    """Long moment table (by, var_i, var_j, n, mean_i, mean_j, sd_i, sd_j, cov, corr, n_rows) for
    i < j, pairwise-complete; ``n_rows`` counts all rows of the dataset.

    One pass over rows: every partition emits centred partial co-moments per dataset
    and pair (Arrow/numpy); one aggregation merges them with Chan's formula.  Shuffle
    volume is partitions x datasets x p^2 rows, independent of the row count, and a
    dataset holding most rows is still spread over all tasks."""
    return moments_of(combine_partials(moment_partials(df, variables, by), by), by)


def corr_pearson(df: DataFrame, variables: Sequence[str], by: Sequence[str] = DATASET,
                 min_periods: bool = True) -> DataFrame:
    """Pearson r per pair; null when the pair has fewer than max(10, int(0.2 n_rows)) complete rows."""
    m = moments(df, variables, by)
    need = F.greatest(F.lit(10), F.floor(F.col("n_rows") * 0.2).cast("long"))
    r = F.when(F.col("n") >= need, F.col("corr")) if min_periods else F.col("corr")
    return m.select(*by, "var_i", "var_j", "n", r.alias("r"))


def pair_ranks(df: DataFrame, variables: Sequence[str], by: Sequence[str], row_key: str) -> tuple[DataFrame, list[str]]:
    """Average-tie ranks of every value among the rows that are complete for a pair.

    Returns (by, row_key, _r) and the variables with nulls, ``dirty``; ``_r`` holds (v, ranks) per variable number v:
    ranks[0] among all values of the variable, ranks[1 + k] among the rows where dirty[k] is filled
    too.  The latter is the former less the rows below whose dirty[k] is null, so one order per variable serves all pairs."""
    by, variables = list(by), list(variables)
    nulls = df.select(*[F.count(F.when(F.col(v).isNull(), 1)).alias(v) for v in variables]).first().asDict()
    dirty = [v for v in variables if nulls[v]]
    absent = [F.col(v).isNull().cast("int").alias(f"_a{k}") for k, v in enumerate(dirty)]
    listed = F.array(*[F.struct(F.lit(i).alias("_v"), F.col(v).cast("double").alias("_x")) for i, v in enumerate(variables)])
    weights = ["_one", *[f"_a{k}" for k in range(len(dirty))]]
    long = df.select(*by, row_key, *absent, F.explode(listed).alias("_p")).select(*by, row_key, F.lit(1).alias("_one"), *weights[1:], "_p.*")
    ranked = ranked_rows(long.filter("_x IS NOT NULL"), [*by, "_v"], "_x", weights, row_key)
    rank = lambda less, same: less + (same + 1) / 2
    ranks = [rank(F.col("below__one"), F.col("at__one"))]
    ranks += [rank(F.col("below__one") - F.col(f"below_{w}"), F.col("at__one") - F.col(f"at_{w}")) for w in weights[1:]]
    return ranked.groupBy(*by, row_key).agg(F.collect_list(F.struct("_v", F.array(*ranks).alias("ranks"))).alias("_r")), dirty


def _rank_partials(by: list[str], variables: list[str], dirty: list[str]):
    """mapInPandas body: per partition and dataset, partial co-moments of each pair's own ranks."""
    slot = {v: dirty.index(v) + 1 if v in dirty else 0 for v in variables}

    def run(batches):
        for batch in batches:
            out = []
            for key, g in batch.groupby(by, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                r = np.full((len(g), len(variables), 1 + len(dirty)), np.nan)
                for row, items in enumerate(g["_r"]):
                    for item in items:
                        r[row, item["_v"]] = item["ranks"]
                for i, a in enumerate(variables):
                    for j in range(i + 1, len(variables)):
                        x, y = r[:, i, slot[variables[j]]], r[:, j, slot[a]]
                        ok = ~(np.isnan(x) | np.isnan(y))
                        n = int(ok.sum())
                        if not n:
                            out.append((*key, a, variables[j], 0, 0.0, 0.0, 0.0, 0.0, 0.0, len(g)))
                            continue
                        x, y = x[ok], y[ok]
                        mx, my = x.mean(), y.mean()
                        dx, dy = x - mx, y - my
                        out.append((*key, a, variables[j], n, mx, my, dx @ dx, dy @ dy, dx @ dy, len(g)))
            yield pd.DataFrame(out, columns=[*by, "var_i", "var_j", *_PARTIAL])

    return run


def corr_spearman(df: DataFrame, variables: Sequence[str], by: Sequence[str] = DATASET,
                  row_key: str = "row_id") -> DataFrame:
    """Spearman rho = Pearson of average-tie ranks taken within the pair's complete rows.

    Every value is ordered once per variable (``pair_ranks``), whatever the null patterns; rows are brought together
    once, and the co-moments of each pair's ranks are merged as in ``moments``."""
    by, variables = list(by), list(variables)
    ranks, dirty = pair_ranks(df, variables, by, row_key)
    partials = ranks.select(*by, "_r").mapInPandas(_rank_partials(by, variables, dirty), _partial_schema(df, by))
    # rows without any value have no rank: all rows are counted on their own
    n_rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    out = moments_of(combine_partials(partials, by), by).drop("n_rows").join(n_rows, by).select(*by, "var_i", "var_j", "n", "corr", "n_rows")
    need = F.greatest(F.lit(10), F.floor(F.col("n_rows") * 0.2).cast("long"))
    return out.select(*by, "var_i", "var_j", "n", F.when(F.col("n") >= need, F.col("corr")).alias("r"))


def _vs_real(corr: DataFrame, by: Sequence[str], real: str = "REAL") -> DataFrame:
    """Join each synthetic dataset's r with REAL's r of the same pair (REAL: p^2 rows, broadcast)."""
    by = list(by)
    r = corr.filter(F.col("technique") == real).select("var_i", "var_j", F.col("r").alias("r_real"))
    s = corr.filter(F.col("technique") != real)
    return s.join(F.broadcast(r), ["var_i", "var_j"], "left")


def corr_error(pearson: DataFrame, spearman: DataFrame, by: Sequence[str] = DATASET, real: str = "REAL") -> DataFrame:
    """Upper-triangle MAE, Frobenius norm of the full difference, flattened-matrix correlation."""
    by = list(by)
    p = _vs_real(pearson, by, real).withColumn("d", F.col("r") - F.col("r_real"))
    s = _vs_real(spearman, by, real).withColumn("d", F.col("r") - F.col("r_real"))
    pa = p.groupBy(*by).agg(
        F.avg(F.abs("d")).alias("pearson_mae"), F.sqrt(2 * F.sum(F.col("d") * F.col("d"))).alias("pearson_fro"),
        F.count("r").alias("_nr"), F.count("r_real").alias("_nrr"),
        F.corr(F.when(F.col("d").isNotNull(), F.col("r_real")), F.when(F.col("d").isNotNull(), F.col("r"))).alias("_mantel"))
    sa = s.groupBy(*by).agg(F.avg(F.abs("d")).alias("spearman_mae"),
                            F.sqrt(2 * F.sum(F.col("d") * F.col("d"))).alias("spearman_fro"))
    return pa.join(sa, by, "left").select(
        *by, "pearson_mae", "pearson_fro", "spearman_mae", "spearman_fro",
        F.when(F.least("_nr", "_nrr") > 10, F.col("_mantel")).alias("mantel_flat_corr"))


def topk_interactions(pearson: DataFrame, by: Sequence[str] = DATASET, k: int = 30, real: str = "REAL") -> DataFrame:
    """Overlap of REAL's top-k |r| pairs with the synthetic top-k; sign agreement on REAL's top-k."""
    by = list(by)
    valid = pearson.filter(F.col("r").isNotNull())
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("r")), "var_i", "var_j")
    ranked = valid.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    top_r = ranked.filter(F.col("technique") == real).select("var_i", "var_j", F.col("r").alias("r_real"))
    top_s = ranked.filter(F.col("technique") != real).select(*by, "var_i", "var_j", F.lit(1).alias("_in_s"))
    syn = pearson.filter(F.col("technique") != real).select(*by, "var_i", "var_j", "r")
    j = syn.join(F.broadcast(top_r), ["var_i", "var_j"]).join(top_s, [*by, "var_i", "var_j"], "left")
    n_top = top_r.agg(F.count(F.lit(1)).alias("n_top"))
    return j.groupBy(*by).agg(
        (F.count("_in_s") / F.count(F.lit(1))).alias("topk_overlap_rate"),
        F.avg((F.signum(F.coalesce(F.col("r"), F.lit(0.0))) == F.signum("r_real")).cast("double")).alias("topk_sign_agreement"),
        F.count(F.lit(1)).alias("topk_k"))


def eigen_spectrum(pearson: DataFrame, variables: Sequence[str], by: Sequence[str] = DATASET, real: str = "REAL") -> DataFrame:
    """Eigenvalues of R (nulls -> 0) per dataset, L2-normalised; L2 distance and cosine to REAL's.

    One group = one p x p matrix (p^2 rows), solved with numpy in ``applyInPandas``."""
    by = list(by)
    variables = list(variables)
    idx = {v: i for i, v in enumerate(variables)}

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        p = len(variables)
        m = np.eye(p)
        for a, b, r in zip(pdf["var_i"], pdf["var_j"], pdf["r"]):
            v = 0.0 if r is None or np.isnan(r) else float(r)
            m[idx[a], idx[b]] = m[idx[b], idx[a]] = v
        ev = np.sort(np.linalg.eigvalsh(m))[::-1]
        ev = ev / (np.linalg.norm(ev) + 1e-12)
        out = pdf[by].iloc[:1].copy()
        out["eigenvalues"] = [ev.tolist()]
        return out

    schema = T.StructType([pearson.schema[b] for b in by] + [T.StructField("eigenvalues", T.ArrayType(T.DoubleType()))])
    spec = pearson.groupBy(*by).applyInPandas(spectrum, schema)
    # REAL's spectrum is p numbers: it travels as a literal array
    real_row = spec.filter(F.col("technique") == real).select("eigenvalues").first()
    if real_row is None:
        raise ValueError("no REAL dataset")
    j = spec.filter(F.col("technique") != real).withColumn(
        "ev_real", F.array(*[F.lit(float(x)) for x in real_row["eigenvalues"]]))
    diff = F.zip_with("eigenvalues", "ev_real", lambda a, b: (a - b) * (a - b))
    dot = F.zip_with("eigenvalues", "ev_real", lambda a, b: a * b)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))  # noqa
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)  # noqa
    return j.select(*by, F.sqrt(total(diff)).alias("eig_l2"),
                    (total(dot) / (norm(F.col("eigenvalues")) * norm(F.col("ev_real")) + 1e-12)).alias("eig_cosine"))


def composites(df: DataFrame, model: dict[str, Sequence[str]]) -> DataFrame:
    """Construct composites = NaN-skipping mean of the construct's items."""
    from fidelis.operators.prep import row_mean

    return df.select(*[c for c in df.columns if c not in {i for items in model.values() for i in items}],
                     *[row_mean(items).alias(name) for name, items in model.items()])


def covariate_corr(df: DataFrame, model: dict[str, Sequence[str]], by: Sequence[str] = DATASET) -> DataFrame:
    """Pearson r of construct composites, lower triangle incl. diagonal (var_i >= var_j by model order)."""
    by = list(by)
    comp = composites(df.select(*by, *[i for items in model.values() for i in items]), model)
    m = moments(comp, list(model), by)
    names = list(model)
    diag = comp.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(n) for n in names])).alias("var_i")) \
        .withColumn("var_j", F.col("var_i")).withColumn("r", F.lit(1.0))
    low = m.select(*by, F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), F.col("corr").alias("r"))
    return low.unionByName(diag)


def pair_delta(corr: DataFrame, real: str = "REAL", keys=("var_i", "var_j"), value: str = "r") -> DataFrame:
    """Technique mean of r over replicates, compared with REAL: signed and absolute difference."""
    keys = list(keys)
    tm = corr.groupBy("technique", *keys).agg(F.avg(value).alias("r_syn"), F.min(value).alias("r_min"),
                                              F.max(value).alias("r_max"))
    r = tm.filter(F.col("technique") == real).select(*keys, F.col("r_syn").alias("r_real"))
    s = tm.filter(F.col("technique") != real)
    return s.join(F.broadcast(r), keys).select(
        "technique", *keys, "r_real", "r_syn", "r_min", "r_max",
        (F.col("r_syn") - F.col("r_real")).alias("delta"), F.abs(F.col("r_syn") - F.col("r_real")).alias("abs_delta"))


def covariate_summary(delta: DataFrame) -> DataFrame:
    off = delta.filter((F.col("var_i") != F.col("var_j")) & F.col("abs_delta").isNotNull())
    return off.groupBy("technique").agg(F.avg("abs_delta").alias("mean_abs_delta"),
                                        F.median("abs_delta").alias("median_abs_delta"),
                                        F.max("abs_delta").alias("max_abs_delta"))


def covariate_delta_matrix(delta: DataFrame) -> DataFrame:
    """Mean |dr| per construct (over its off-diagonal pairs) and technique."""
    off = delta.filter(F.col("var_i") != F.col("var_j"))
    both = off.select("technique", F.col("var_i").alias("variable"), "abs_delta").unionByName(
        off.select("technique", F.col("var_j").alias("variable"), "abs_delta"))
    return both.groupBy("variable", "technique").agg(F.avg("abs_delta").alias("mean_abs_delta"))


def covariate_range(delta: DataFrame) -> DataFrame:
    """Does the replicates' [min, max] of r contain REAL's r?"""
    off = delta.filter(F.col("var_i") != F.col("var_j"))
    return off.select("technique", "var_i", "var_j", "r_min", "r_max", "r_real",
                      F.col("r_real").between(F.col("r_min"), F.col("r_max")).alias("contains_real"))


def latent_stability(delta: DataFrame, label: str) -> DataFrame:
    off = delta.filter(F.col("var_i") != F.col("var_j"))
    return off.groupBy("technique").agg(F.avg("abs_delta").alias("mean_abs_delta"),
                                        F.median("abs_delta").alias("median_abs_delta"),
                                        F.max("abs_delta").alias("max_abs_delta")).withColumn("model", F.lit(label))


def corr_diff(df: DataFrame, variables: Sequence[str], real: str = "REAL") -> DataFrame:
    """REAL minus synthetic Pearson r per pair, replicates pooled per technique."""
    pooled = corr_pearson(df, variables, ["technique"], min_periods=False)
    r = pooled.filter(F.col("technique") == real).select("var_i", "var_j", F.col("r").alias("r_real"))
    return pooled.filter(F.col("technique") != real).join(F.broadcast(r), ["var_i", "var_j"]).select(
        "technique", "var_i", "var_j", (F.col("r_real") - F.col("r")).alias("diff"))
