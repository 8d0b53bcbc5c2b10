"""Measurement and latent-path operators as group algebra over moments.

Rows are touched once, by ``moments``; everything here works on the p x p
correlation/covariance rows of one dataset.  Alpha and HTMT are plain
aggregations of the moment table.  The PLS path model (composites, mode A, path
weighting) is solved per dataset in ``applyInPandas`` on its correlation matrix and
returns the long result table ``(technique, replicate, sheet, key1, key2, metric, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators.dependency import moments

DATASET = ["technique", "replicate"]
RESULT_SCHEMA = T.StructType([
    T.StructField("technique", T.StringType()), T.StructField("replicate", T.IntegerType()),
    T.StructField("sheet", T.StringType()), T.StructField("key1", T.StringType()),
    T.StructField("key2", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType())])


def cronbach_alpha(df: DataFrame, model: dict[str, Sequence[str]], by=DATASET) -> DataFrame:
    """alpha = k/(k-1) * (1 - sum s_ii / sum_ij s_ij) per construct: item variances over
    each item's non-null values, covariances pairwise-complete (pandas ``cov``)."""
    by = list(by)
    items = [i for c in model for i in model[c]]
    var = df.groupBy(*by).agg(*[F.var_samp(i).alias(f"_v_{i}") for i in items])
    mom = moments(df, items, by)
    out = None
    for name, its in model.items():
        k = len(its)
        if k < 2:
            continue
        covs = mom.filter(F.col("var_i").isin(its) & F.col("var_j").isin(its)).groupBy(*by).agg(
            F.sum("cov").alias("sum_cov"))
        sum_var = None
        for i in its:
            sum_var = F.col(f"_v_{i}") if sum_var is None else sum_var + F.col(f"_v_{i}")
        a = var.join(covs, by).select(
            *by, F.lit(name).alias("construct"),
            (F.lit(k / (k - 1.0)) * (F.lit(1.0) - sum_var / (sum_var + 2 * F.col("sum_cov")))).alias("alpha"))
        out = a if out is None else out.unionByName(a)
    return out


def htmt(mom: DataFrame, model: dict[str, Sequence[str]], by=DATASET) -> DataFrame:
    """Heterotrait-monotrait ratio per construct pair: mean |r| between the blocks over
    sqrt(mean |r| within a x mean |r| within b); a single-item block has monotrait 1."""
    by = list(by)
    names = list(model)
    owner = F.create_map(*[x for c, items in model.items() for i in items for x in (F.lit(i), F.lit(c))])
    m = mom.select(*by, owner[F.col("var_i")].alias("ci"), owner[F.col("var_j")].alias("cj"), F.abs("corr").alias("ar"))
    m = m.filter(F.col("ci").isNotNull() & F.col("cj").isNotNull())
    mono = m.filter(F.col("ci") == F.col("cj")).groupBy(*by, "ci").agg(F.avg("ar").alias("mono"))
    order = {c: i for i, c in enumerate(names)}
    rank = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    het = m.filter(F.col("ci") != F.col("cj")).select(
        *by, F.when(rank[F.col("ci")] < rank[F.col("cj")], F.col("ci")).otherwise(F.col("cj")).alias("a"),
        F.when(rank[F.col("ci")] < rank[F.col("cj")], F.col("cj")).otherwise(F.col("ci")).alias("b"), "ar")
    het = het.groupBy(*by, "a", "b").agg(F.avg("ar").alias("hetero"))
    single = [c for c, items in model.items() if len(items) == 1]
    ma = mono.select(*by, F.col("ci").alias("a"), F.col("mono").alias("mono_a"))
    mb = mono.select(*by, F.col("ci").alias("b"), F.col("mono").alias("mono_b"))
    j = het.join(ma, [*by, "a"], "left").join(mb, [*by, "b"], "left")
    one = lambda c, side: F.when(F.col(side).isin(single), F.lit(1.0)).otherwise(F.col(c)) if single else F.col(c)  # noqa
    return j.select(*by, F.col("a").alias("construct_a"), F.col("b").alias("construct_b"),
                    (F.col("hetero") / F.sqrt(one("mono_a", "a") * one("mono_b", "b"))).alias("htmt"))


# ------------------------------------------------------------------ PLS path model (group algebra)

def pls_solve(r: np.ndarray, blocks: list[list[int]], paths: list[tuple[int, int]], n: int,
              tol: float = 1e-7, max_iter: int = 300) -> dict:
    """PLS-PM on a correlation matrix: composites, mode A, path weighting.

    Returns weights (p,), loadings (p,), construct correlation C (c x c), path
    coefficients B (c x c, B[i, j] = effect i -> j), R2 and adjusted R2 per construct,
    rho_A per construct and the number of iterations."""
    p, c = r.shape[0], len(blocks)
    w = np.zeros((p, c))
    for j, b in enumerate(blocks):
        w[b, j] = 1.0
        w[:, j] /= np.sqrt(w[:, j] @ r @ w[:, j])
    preds = {j: [i for i, k in paths if k == j] for j in range(c)}
    succs = {j: [k for i, k in paths if i == j] for j in range(c)}
    it = 0
    for it in range(1, max_iter + 1):
        cmat = w.T @ r @ w
        e = np.zeros((c, c))
        for j in range(c):
            for k in succs[j]:
                e[j, k] = cmat[j, k]
            pr = preds[j]
            if pr:
                beta = np.linalg.solve(cmat[np.ix_(pr, pr)], cmat[pr, j])
                for i, bcoef in zip(pr, beta):
                    e[j, i] = bcoef
        new = np.zeros_like(w)
        for j, b in enumerate(blocks):
            z = r[np.ix_(b, range(p))] @ w @ e[j]  # cov(items of j, inner proxy of j)
            if not np.any(z):
                z = np.ones(len(b))
            new[b, j] = z
            new[:, j] /= np.sqrt(new[:, j] @ r @ new[:, j])
        delta = np.max(np.abs(new - w))
        w = new
        if delta < tol:
            break
    cmat = w.T @ r @ w
    load = np.zeros(p)
    for j, b in enumerate(blocks):
        lam = r[np.ix_(b, b)] @ w[b, j]
        if lam.sum() < 0:  # orient every construct so that its loadings sum positive
            w[:, j] = -w[:, j]
            lam = -lam
        load[b] = lam
    cmat = w.T @ r @ w
    bmat = np.zeros((c, c))
    r2 = np.full(c, np.nan)
    adj = np.full(c, np.nan)
    for j in range(c):
        pr = preds[j]
        if pr:
            beta = np.linalg.solve(cmat[np.ix_(pr, pr)], cmat[pr, j])
            bmat[pr, j] = beta
            r2[j] = float(cmat[pr, j] @ beta)
            adj[j] = 1 - (1 - r2[j]) * (n - 1) / (n - len(pr) - 1)
    rho_a = np.full(c, np.nan)
    for j, b in enumerate(blocks):
        wb = w[b, j]
        if len(b) > 1:
            s = r[np.ix_(b, b)]
            ww = np.outer(wb, wb)
            num = wb @ (s - np.diag(np.diag(s))) @ wb
            den = wb @ (ww - np.diag(np.diag(ww))) @ wb
            rho_a[j] = (wb @ wb) ** 2 * num / den
        else:
            rho_a[j] = 1.0
    return {"weights": w.sum(axis=1), "loadings": load, "C": cmat, "B": bmat, "r2": r2, "adj_r2": adj,
            "rho_a": rho_a, "iterations": it}


def _corr_matrix(pdf: pd.DataFrame, items: list[str]) -> np.ndarray:
    idx = {v: i for i, v in enumerate(items)}
    r = np.eye(len(items))
    for a, b, v in zip(pdf["var_i"], pdf["var_j"], pdf["corr"]):
        if a in idx and b in idx:
            # a constant item has no correlation: NaN, and the model does not converge
            r[idx[a], idx[b]] = r[idx[b], idx[a]] = np.nan if v is None else v
    return r


def pls_results(tech: str, rep: int, r: np.ndarray, n: int, model: dict[str, Sequence[str]],
                structure: Sequence[tuple[str, str]]) -> list[tuple]:
    names = list(model)
    items = [i for c in names for i in model[c]]
    pos = {v: k for k, v in enumerate(items)}
    blocks = [[pos[i] for i in model[c]] for c in names]
    cid = {c: k for k, c in enumerate(names)}
    paths = [(cid[a], cid[b]) for a, b in structure]
    try:
        if np.isnan(r).any():
            raise np.linalg.LinAlgError("an item has no correlations")
        fit = pls_solve(r, blocks, paths, n)
    except np.linalg.LinAlgError:
        p, c = len(items), len(names)
        fit = {"weights": np.full(p, np.nan), "loadings": np.full(p, np.nan), "C": np.full((c, c), np.nan), "B": np.full((c, c), np.nan),
               "r2": np.full(c, np.nan), "adj_r2": np.full(c, np.nan), "rho_a": np.full(c, np.nan), "iterations": np.nan}
    rows = []

    def add(sheet, k1, k2, metric, value):
        rows.append((tech, int(rep), sheet, k1, k2, metric, None if value is None or np.isnan(value) else float(value)))

    for j, c in enumerate(names):
        lam = fit["loadings"][blocks[j]]
        k = len(lam)
        for i, item in zip(blocks[j], model[c]):
            add("loadings", item, c, "loading", fit["loadings"][i])
            add("loadings", item, c, "indicator_r2", fit["loadings"][i] ** 2)
            add("weights", item, c, "weight", fit["weights"][i])
        sl = lam.sum()
        add("reliability", c, None, "rhoC", sl * sl / (sl * sl + np.sum(1 - lam * lam)))
        add("reliability", c, None, "AVE", float(np.sum(lam * lam) / k))
        add("reliability", c, None, "rhoA", fit["rho_a"][j])
        if k > 1:
            s = r[np.ix_(blocks[j], blocks[j])]
            add("reliability", c, None, "alpha_std", k / (k - 1) * (1 - k / s.sum()))
        for i2, c2 in enumerate(names):
            add("construct_corr", c, c2, "r", fit["C"][j, i2])
        if not np.isnan(fit["r2"][j]):
            add("rsquared", c, None, "R2", fit["r2"][j])
            add("rsquared", c, None, "Adj_R2", fit["adj_r2"][j])
    for a, b in structure:
        add("paths", a, b, "beta", fit["B"][cid[a], cid[b]])
    total = np.linalg.inv(np.eye(len(names)) - np.nan_to_num(fit["B"])) - np.eye(len(names))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i != j and abs(total[i, j]) > 0:
                add("total_effects", a, b, "total", total[i, j])
    add("fit", None, None, "iterations", fit["iterations"])
    add("fit", None, None, "converged", float(not np.isnan(fit["iterations"])))
    return rows


def pls_fit(df: DataFrame, model: dict[str, Sequence[str]], structure: Sequence[tuple[str, str]], by=DATASET) -> DataFrame:
    """Fit the PLS path model for every dataset; long result table."""
    by = list(by)
    items = [i for c in model for i in model[c]]
    mom = moments(df, items, by).select(*by, "var_i", "var_j", "corr", "n_rows")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tech, rep = pdf["technique"].iloc[0], pdf["replicate"].iloc[0]
        r = _corr_matrix(pdf, items)
        rows = pls_results(tech, rep, r, int(pdf["n_rows"].iloc[0]), model, structure)
        return pd.DataFrame(rows, columns=[f.name for f in RESULT_SCHEMA.fields])

    return mom.groupBy(*by).applyInPandas(fit, RESULT_SCHEMA)


# ------------------------------------------------------------------ the model each dataset can carry

def item_model(df: DataFrame, model: dict[str, Sequence[str]], by=DATASET, min_items: int = 2) -> DataFrame:
    """The measurement model as data, one row per dataset and item: construct, item, sd, var, constant, n_items (items of the
    construct that vary), kept.  A constant item is dropped, and a construct of which fewer than ``min_items`` items are left."""
    by = list(by)
    listed = F.array(*[F.struct(F.lit(c).alias("construct"), F.lit(i).alias("item"), F.col(i).cast("double").alias("value")) for c, its in model.items() for i in its])
    long = df.select(*by, F.explode(listed).alias("_i")).select(*by, "_i.*")
    sd = long.groupBy(*by, "construct", "item").agg(F.stddev_samp("value").alias("sd"), F.var_samp("value").alias("var"))
    sd = sd.withColumn("constant", F.col("sd").isNull() | (F.col("sd") == 0))
    vary = Window.partitionBy(*by, "construct")  # the items of one construct
    n = F.count(F.when(~F.col("constant"), 1)).over(vary)
    return sd.withColumn("n_items", n).withColumn("kept", ~F.col("constant") & (F.col("n_items") >= min_items))


def fit_rebuilt(df: DataFrame, model: dict[str, Sequence[str]], structure: Sequence[tuple[str, str]], by=DATASET) -> DataFrame:
    """Alpha, HTMT and the PLS path model of every dataset on the model that it can carry (``item_model``), as ``pls_fit``
    rows; sheets ``alpha`` and ``htmt`` beside those of ``pls_fit``.  Paths from or to a dropped construct are left out."""
    by = list(by)
    items = [i for c in model for i in model[c]]
    mom = moments(df, items, by).select(*by, "var_i", "var_j", "corr", "cov", "n_rows")
    rows = item_model(df, model, by).select(*by, "construct", "item", "var", "kept")

    def fit(m, parts):
        if m.empty or parts.empty:
            return pd.DataFrame(columns=[f.name for f in RESULT_SCHEMA.fields])
        tech, rep = m["technique"].iloc[0], int(m["replicate"].iloc[0])
        kept = set(parts.loc[parts["kept"], "item"])
        mine = {c: [i for i in its if i in kept] for c, its in model.items()}
        mine = {c: its for c, its in mine.items() if its}
        out = []
        if mine:
            var = dict(zip(parts["item"], parts["var"]))
            cov = {frozenset((a, b)): v for a, b, v in zip(m["var_i"], m["var_j"], m["cov"])}
            r = {frozenset((a, b)): abs(v) for a, b, v in zip(m["var_i"], m["var_j"], m["corr"])}
            mean = lambda left, right: float(np.mean([r[frozenset((a, b))] for a in left for b in right if a != b]))
            for c, its in mine.items():
                own = sum(var[i] for i in its)
                shared = 2 * sum(cov[frozenset((a, b))] for n, a in enumerate(its) for b in its[n + 1:])
                out.append((tech, rep, "alpha", c, None, "alpha", len(its) / (len(its) - 1) * (1 - own / (own + shared))))
            names = list(mine)
            for n, a in enumerate(names):
                for b in names[n + 1:]:
                    out.append((tech, rep, "htmt", a, b, "htmt", mean(mine[a], mine[b]) / float(np.sqrt(mean(mine[a], mine[a]) * mean(mine[b], mine[b])))))
            paths = [(a, b) for a, b in structure if a in mine and b in mine]
            out += pls_results(tech, rep, _corr_matrix(m, [i for its in mine.values() for i in its]), int(m["n_rows"].iloc[0]), mine, paths)
        return pd.DataFrame(out, columns=[f.name for f in RESULT_SCHEMA.fields])

    return mom.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(fit, RESULT_SCHEMA)


def sheet(results: DataFrame, name: str, metric: str | None = None) -> DataFrame:
    out = results.filter(F.col("sheet") == name)
    return out.filter(F.col("metric") == metric) if metric else out


def fornell_larcker(results: DataFrame) -> DataFrame:
    """sqrt(AVE) on the diagonal, construct correlations below it."""
    ave = sheet(results, "reliability", "AVE").select(*DATASET, F.col("key1").alias("construct_a"),
                                                      F.col("key1").alias("construct_b"), F.sqrt("value").alias("value"))
    cc = sheet(results, "construct_corr", "r").filter(F.col("key1") > F.col("key2")).select(
        *DATASET, F.col("key1").alias("construct_a"), F.col("key2").alias("construct_b"), "value")
    return ave.unionByName(cc)


def latent_scores(df: DataFrame, results: DataFrame, model: dict[str, Sequence[str]], by=DATASET) -> DataFrame:
    """Per-row construct scores: standardised items times the dataset's outer weights.

    Weights and item means/sds are one row per dataset (broadcast); scores are one
    Column expression per construct."""
    by = list(by)
    items = [i for c in model for i in model[c]]
    w = sheet(results, "weights", "weight").groupBy(*by).pivot("key1", items).agg(F.first("value"))
    w = w.select(*by, *[F.col(i).alias(f"_w_{i}") for i in items])
    st = df.groupBy(*by).agg(*[F.avg(i).alias(f"_m_{i}") for i in items], *[F.stddev_samp(i).alias(f"_s_{i}") for i in items])
    j = df.join(F.broadcast(st), by).join(F.broadcast(w), by)
    scores = []
    for c, its in model.items():
        e = None
        for i in its:
            t = (F.col(i) - F.col(f"_m_{i}")) / F.col(f"_s_{i}") * F.col(f"_w_{i}")
            e = t if e is None else e + t
        scores.append(e.alias(f"LV_{c}"))
    return j.select(*df.columns, *scores)


# ------------------------------------------------------------------ bootstrap (all draws in one pass over rows)

_POISSON1_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(20)])


ROW_BLOCK, DRAW_BLOCK = 512, 250  # a block of hashes is 1 MB, which stays in a core's cache
OPEN_DATASETS = 64  # datasets whose sums a task holds at a time
HEAD_BITS = 12


def _poisson_heads() -> np.ndarray:
    """Weight by the first ``HEAD_BITS`` bits of the hash; -1 where the remaining bits decide."""
    edges = np.arange(2 ** HEAD_BITS + 1) / 2.0 ** HEAD_BITS
    low = np.searchsorted(_POISSON1_CDF, edges[:-1], side="right")
    high = np.searchsorted(_POISSON1_CDF, np.nextafter(edges[1:], 0.0), side="right")
    return np.where(low == high, low, -1).astype(np.float64)


_POISSON1_HEADS = _poisson_heads()


class PoissonWeights:
    """Poisson(1) weight of every (row, draw), a pure function of (row id, draw, seed): splitmix64 of the three, as a
    uniform number, through the inverse CDF.  The first bits of a hash give the weight, but for the few hashes whose cell
    holds a step of the CDF.

    All work is done in three arrays that are kept between calls: fresh ones of this size would be mapped and
    cleared by the system on every call, which takes longer than the hashes when all cores do it."""

    def __init__(self, rows: int, draws: int):
        self._hash, self._shifted = (np.empty(rows * draws, np.uint64) for _ in range(2))
        self._weight = np.empty(rows * draws)

    def block(self, row_ids: np.ndarray, draws: int, seed: int, first: int = 0) -> np.ndarray:
        """Weights as (draw, row); they hold until the next call."""
        n = draws * len(row_ids)
        z, t, w = self._hash[:n], self._shifted[:n], self._weight[:n]
        with np.errstate(over="ignore"):
            key = row_ids.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(seed) + np.uint64(0x9E3779B97F4A7C15)
            draw = np.arange(first, first + draws, dtype=np.uint64) * np.uint64(0x9E3779B1)
            np.add.outer(draw, key, out=z.reshape(draws, len(row_ids)))
            np.right_shift(z, np.uint64(30), out=t)
            z ^= t
            z *= np.uint64(0xBF58476D1CE4E5B9)
            np.right_shift(z, np.uint64(27), out=t)
            z ^= t
            z *= np.uint64(0x94D049BB133111EB)
        # the last step, z ^ (z >> 31), leaves the first 31 bits as they are
        np.right_shift(z, np.uint64(64 - HEAD_BITS), out=t)
        np.take(_POISSON1_HEADS, t.view(np.int64), mode="clip", out=w)
        at = np.flatnonzero(w < 0)
        rest = z[at]
        rest ^= rest >> np.uint64(31)
        w[at] = np.searchsorted(_POISSON1_CDF, (rest >> np.uint64(11)).astype(np.float64) / float(2 ** 53), side="right")
        return w.reshape(draws, len(row_ids))


def poisson_weights(row_ids: np.ndarray, draws: int, seed: int, first: int = 0) -> np.ndarray:
    """The weights of all rows and draws at once, as (row, draw)."""
    return PoissonWeights(len(row_ids), draws).block(row_ids, draws, seed, first).T


def bootstrap_fit(df: DataFrame, model: dict[str, Sequence[str]], structure: Sequence[tuple[str, str]], draws: int = 2000,
                  seed: int = 123, by=DATASET, row_id: str = "row_id") -> DataFrame:
    """Path coefficients of ``draws`` Poisson-bootstrap resamples per dataset.

    One pass over rows: every partition adds up, per dataset and draw, the weighted sums
    (sum w, sum w x, upper triangle of sum w x x') of the centred items, in blocks of
    ``ROW_BLOCK`` rows by ``DRAW_BLOCK`` draws, so memory is draws x p^2 for the datasets of a
    partition and does not grow with its rows.  Partials are plain double columns that Spark
    sums per (dataset, draw) with map-side combine; each sum row is then solved on its own."""
    by = list(by)
    items = [i for c in model for i in model[c]]
    p = len(items)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = ["s0", *[f"s_{i}" for i in range(p)], *[f"s_{i}_{j}" for i, j in upper]]
    means = df.groupBy(*by).agg(*[F.avg(i).alias(f"_m_{i}") for i in items])
    cen = df.join(F.broadcast(means), by).select(*by, row_id, *[(F.col(i) - F.col(f"_m_{i}")).alias(i) for i in items])
    cen = cen.dropna(subset=items)
    part_schema = T.StructType([df.schema[b] for b in by] + [T.StructField("draw", T.IntegerType())]
                               + [T.StructField(c, T.DoubleType()) for c in sums])
    left, right = [i for i, _ in upper], [j for _, j in upper]

    def emit(acc):
        for key, s in acc.items():
            out = {b: [k] * draws for b, k in zip(by, key)} | {"draw": np.arange(draws, dtype=np.int32)}
            yield pd.DataFrame(out | {c: s[:, k] for k, c in enumerate(sums)})

    def partials(batches):
        acc: dict = {}
        weights, product = PoissonWeights(ROW_BLOCK, DRAW_BLOCK), np.empty((DRAW_BLOCK, len(sums)))
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                if key not in acc and len(acc) >= OPEN_DATASETS:
                    yield from emit(acc)
                    acc = {}
                total = acc.setdefault(key, np.zeros((draws, len(sums))))
                x, ids = g[items].to_numpy(dtype=np.float64), g[row_id].to_numpy()
                for a in range(0, len(x), ROW_BLOCK):
                    xa = x[a:a + ROW_BLOCK]
                    z = np.hstack([np.ones((len(xa), 1)), xa, xa[:, left] * xa[:, right]])
                    for d in range(0, draws, DRAW_BLOCK):
                        n = min(DRAW_BLOCK, draws - d)
                        total[d:d + n] += np.matmul(weights.block(ids[a:a + ROW_BLOCK], n, seed, d), z, out=product[:n])
        yield from emit(acc)

    merged = cen.mapInPandas(partials, part_schema).groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in sums])
    names = list(model)
    pos = {v: k for k, v in enumerate(items)}
    blocks = [[pos[i] for i in model[c]] for c in names]
    cid = {c: k for k, c in enumerate(names)}
    paths = [(cid[a], cid[b]) for a, b in structure]
    out_schema = T.StructType([df.schema[b] for b in by] + [
        T.StructField("draw", T.IntegerType()), T.StructField("iv", T.StringType()), T.StructField("dv", T.StringType()),
        T.StructField("effect", T.StringType()), T.StructField("value", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            rows = []
            for head, s in zip(pdf[[*by, "draw"]].itertuples(index=False, name=None), pdf[sums].to_numpy()):
                mu = s[1:p + 1] / s[0]
                second = np.zeros((p, p))
                second[left, right] = second[right, left] = s[p + 1:]
                cov = second / s[0] - np.outer(mu, mu)
                sd = np.sqrt(np.diag(cov))
                fit = pls_solve(cov / np.outer(sd, sd), blocks, paths, int(s[0]))
                total = np.linalg.inv(np.eye(len(names)) - fit["B"]) - np.eye(len(names))
                rows += [(*head, a, b, "direct", float(fit["B"][cid[a], cid[b]])) for a, b in structure]
                rows += [(*head, a, b, "total", float(total[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)
                         if i != j and abs(total[i, j]) > 0]
            yield pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    return merged.mapInPandas(solve, out_schema)


def bootstrap_summary(boot: DataFrame, estimates: DataFrame, by=DATASET) -> DataFrame:
    """Original estimate, bootstrap mean and SD, t, two-sided normal p and 95 % percentile CI."""
    from fidelis.functions.stats import two_sided_p

    by = list(by)
    s = boot.groupBy(*by, "iv", "dv", "effect").agg(
        F.avg("value").alias("boot_mean"), F.stddev_samp("value").alias("boot_sd"),
        F.percentile("value", 0.025).alias("ci_95l"), F.percentile("value", 0.975).alias("ci_95u"))
    j = estimates.join(s, [*by, "iv", "dv", "effect"])
    t = F.col("estimate") / F.col("boot_sd")
    return j.withColumn("t_stat", t).withColumn("p_value", two_sided_p(F.col("t_stat")))


def path_estimates(results: DataFrame, by=DATASET) -> DataFrame:
    direct = results.filter((F.col("sheet") == "paths") & (F.col("metric") == "beta")).select(
        *by, F.col("key1").alias("iv"), F.col("key2").alias("dv"), F.lit("direct").alias("effect"),
        F.col("value").alias("estimate"))
    total = results.filter(F.col("sheet") == "total_effects").select(
        *by, F.col("key1").alias("iv"), F.col("key2").alias("dv"), F.lit("total").alias("effect"),
        F.col("value").alias("estimate"))
    return direct.unionByName(total)


def indirect_effects(boot: DataFrame, estimates: DataFrame, mediations: Sequence[tuple[str, str, str]], by=DATASET) -> DataFrame:
    """a*b for IV -> M -> DV: estimate, bootstrap mean, SD, t, 95 % percentile CI, p."""
    from fidelis.functions.stats import two_sided_p

    by = list(by)
    parts = []
    for iv, med, dv in mediations:
        a = boot.filter((F.col("iv") == iv) & (F.col("dv") == med) & (F.col("effect") == "direct")).select(*by, "draw", F.col("value").alias("a"))
        b = boot.filter((F.col("iv") == med) & (F.col("dv") == dv) & (F.col("effect") == "direct")).select(*by, "draw", F.col("value").alias("b"))
        ab = a.join(b, [*by, "draw"]).select(*by, (F.col("a") * F.col("b")).alias("ab")).groupBy(*by).agg(
            F.avg("ab").alias("boot_mean"), F.stddev_samp("ab").alias("std_err"),
            F.percentile("ab", 0.025).alias("ci_95l"), F.percentile("ab", 0.975).alias("ci_95u"))
        ea = estimates.filter((F.col("iv") == iv) & (F.col("dv") == med) & (F.col("effect") == "direct")).select(*by, F.col("estimate").alias("ea"))
        eb = estimates.filter((F.col("iv") == med) & (F.col("dv") == dv) & (F.col("effect") == "direct")).select(*by, F.col("estimate").alias("eb"))
        e = ea.join(eb, by).select(*by, (F.col("ea") * F.col("eb")).alias("indirect_b"))
        parts.append(e.join(ab, by).select(*by, F.lit(iv).alias("iv"), F.lit(med).alias("mediator"), F.lit(dv).alias("dv"),
                                           "indirect_b", "boot_mean", "std_err", "ci_95l", "ci_95u"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    t = F.col("indirect_b") / F.col("std_err")
    return out.withColumn("t_stat", t).withColumn("p_value", two_sided_p(F.col("t_stat")))


def mediation_summary(results: DataFrame, mediations: Sequence[tuple[str, str, str]], by=DATASET) -> DataFrame:
    """a, b, c' (direct), a*b and total from the standardised paths, only when all exist."""
    by = list(by)
    beta = results.filter((F.col("sheet") == "paths") & (F.col("metric") == "beta"))
    parts = []
    for iv, med, dv in mediations:
        def one(x, y, name):
            return beta.filter((F.col("key1") == x) & (F.col("key2") == y)).select(*by, F.col("value").alias(name))
        m = one(iv, med, "a_std").join(one(med, dv, "b_std"), by).join(one(iv, dv, "cprime_std"), by)
        parts.append(m.select(*by, F.lit(iv).alias("iv"), F.lit(med).alias("mediator"), F.lit(dv).alias("dv"), "a_std", "b_std",
                              "cprime_std", (F.col("a_std") * F.col("b_std")).alias("indirect_ab_std"),
                              (F.col("cprime_std") + F.col("a_std") * F.col("b_std")).alias("total_std")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def plsc_adjust(results: DataFrame, structure: Sequence[tuple[str, str]], by=DATASET) -> DataFrame:
    """Construct correlations r / sqrt(rhoA_i rhoA_j) and the paths solved from them; a path that
    cannot be solved is 0."""
    by = list(by)
    names = list(dict.fromkeys(c for pair in structure for c in pair))
    cid = {c: k for k, c in enumerate(names)}
    long = sheet(results, "construct_corr", "r").select(*by, "key1", "key2", "metric", "value").unionByName(
        sheet(results, "reliability", "rhoA").select(*by, "key1", "key2", "metric", "value"))
    schema = T.StructType([results.schema[b] for b in by] + [
        T.StructField("iv", T.StringType()), T.StructField("dv", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, rho = np.eye(len(names)), np.ones(len(names))
        for x in pdf.itertuples():
            if x.metric == "rhoA":
                rho[cid[x.key1]] = x.value
            elif x.key1 != x.key2:
                r[cid[x.key1], cid[x.key2]] = x.value
        with np.errstate(invalid="ignore", divide="ignore"):
            adjusted = r / np.sqrt(np.outer(rho, rho))
        np.fill_diagonal(adjusted, 1.0)
        head = [pdf[b].iloc[0] for b in by]
        rows = [(*head, a, b, "r", float(adjusted[cid[a], cid[b]])) for a in names for b in names if cid[a] < cid[b]]
        for dv in dict.fromkeys(b for _, b in structure):
            pred = [a for a, b in structure if b == dv]
            at = [cid[a] for a in pred]
            try:
                beta = np.linalg.solve(adjusted[np.ix_(at, at)], adjusted[at, cid[dv]])
            except np.linalg.LinAlgError:
                beta = np.full(len(pred), np.nan)
            rows += [(*head, a, dv, "beta", 0.0 if np.isnan(v) else float(v)) for a, v in zip(pred, beta)]
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return long.groupBy(*by).applyInPandas(run, schema)
