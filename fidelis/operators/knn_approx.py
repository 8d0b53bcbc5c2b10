"""Approximate k nearest neighbours by random-projection hash tables, within a pair budget.

A table rounds ``PROJECTIONS`` random directions of a row, shifted at random, to cells; rows
that share a table's cell are compared exactly.  The cell width follows the data: ``WIDTH`` times
the 0.9 quantile of the k-th distances of a hash sample of query rows, which are also searched
exactly (``knn.py``).  That sample measures the recall that every result row carries.

Before anything is compared, the pairs of all cells are counted from their sizes, and the
search is refused above ``pair_budget``.  Cells meet in blocks of at most 2048 x 2048 rows, so a
hot cell is spread over many tasks.

A row travels to its cell of every table.  ``PASS_TABLES`` tables are met at a time and leave their k best
per query row in a written table, so the disk holds the shuffles of one pass, not of all tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators.knn import _Best, _meet, knn
from fidelis.session import materialise

TABLES = 24
PASS_TABLES = 3  # tables whose shuffles are on disk together
PROJECTIONS = 6
WIDTH = 2.5
Q_BLOCK = R_BLOCK = 2048  # rows of a block on either side
BUNDLE = 32_768  # rows of the cells that meet in one group
RECALL_ROWS = 600  # query rows that are searched exactly, about


class PairBudgetExceeded(ValueError):
    """The hash tables would compare more pairs than allowed."""


def _cells(df: DataFrame, features: Sequence[str], width: float, tables: int, seed: int, only: range | None = None) -> DataFrame:
    """One row per row and table (of ``only``, or of all): _table, _key."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((len(features), tables * PROJECTIONS)) / width
    shifts = rng.uniform(0, 1, tables * PROJECTIONS)
    mix = rng.integers(1, 2 ** 62, PROJECTIONS, dtype=np.int64) * 2 + 1
    only = range(tables) if only is None else only
    mine = slice(only.start * PROJECTIONS, only.stop * PROJECTIONS)

    def keys(x: pd.DataFrame) -> pd.Series:
        # one product over all tables, whichever are wanted: a row has the same cells in every call
        at = np.floor(x.to_numpy(dtype=np.float64) @ directions + shifts)[:, mine].astype(np.int64).reshape(len(x), len(only), PROJECTIONS)
        with np.errstate(over="ignore"):
            h = np.zeros((len(x), len(only)), np.int64)
            for i in range(PROJECTIONS):
                h = (h ^ at[:, :, i]) * mix[i]
                h ^= h >> 29
        return pd.Series(list(h))

    of = F.pandas_udf(keys, T.ArrayType(T.LongType()))
    return df.select("*", F.posexplode(of(F.struct(*features))).alias("_table", "_key")).withColumn("_table", F.col("_table") + only.start)


def _kernel(ident: list[str], features: list[str], k: int):
    """cogroup body: the query rows of each cell against its reference rows; k best per query row of the block and cell."""
    qf, rf = [f"q_{f}" for f in features], [f"r_{f}" for f in features]

    def run(qdf, rdf):
        cell = ["_table", "_key"]
        if qdf.empty or rdf.empty:
            return pd.DataFrame({c: qdf[c].to_numpy()[:0] for c in ident} | {"dist": np.zeros(0), "_rid": np.zeros(0, np.int64)})
        qdf, rdf = qdf.sort_values(cell, kind="stable"), rdf.sort_values(cell, kind="stable")
        q, r, ids = qdf[qf].to_numpy(dtype=np.float64), rdf[rf].to_numpy(dtype=np.float64), rdf["_rid"].to_numpy()
        best = _Best(np.full(len(q), np.inf), k)
        where = rdf.groupby(cell, sort=False).indices
        for key, at in qdf.groupby(cell, sort=False).indices.items():
            if key in where:
                _meet(best, q, at, r[where[key]], ids[where[key]])
        rows, d, rid = best.result()
        return pd.DataFrame({c: qdf[c].to_numpy()[rows] for c in ident} | {"dist": d, "_rid": rid})

    return run


def _met(q: DataFrame, r: DataFrame, sizes: DataFrame, ident: list[str], features: list[str], k: int, schema: T.StructType, cells, only: range, placed: int) -> DataFrame:
    """Candidates (ident, dist, _rid) of the tables ``only``: their ``placed`` rows meet in blocks."""
    cell = ["_table", "_key"]
    # small cells meet in bundles of about BUNDLE rows, a large one in blocks of its own
    bundles = max(1, placed // BUNDLE)
    sq, sr = F.ceil(F.col("_nq") / Q_BLOCK).cast("int"), F.ceil(F.col("_nr") / R_BLOCK).cast("int")
    # the large ones are at most a row per 2,048 placed rows; the others need no table, so their rows are shuffled once
    large = sizes.filter(F.col("_table").between(only.start, only.stop - 1)).select(*cell, sq.alias("_sq"), sr.alias("_sr")).filter("_sq > 1 OR _sr > 1")
    bundle = F.when(F.col("_sq").isNull(), F.pmod(F.xxhash64(*cell), F.lit(bundles))).otherwise(F.xxhash64(*cell)).alias("_bundle")
    one = F.lit(1)

    def blocked(rows: DataFrame, prefix: str, row: list[str], own: str, own_salt: str, other: str, other_salt: str) -> DataFrame:
        return cells(rows).join(F.broadcast(large), cell, "left").select(
            *row, *cell, bundle, *[F.col(f).alias(f"{prefix}{f}") for f in features],
            F.pmod(F.xxhash64(*row), F.coalesce(own, one)).cast("int").alias(own_salt),
            F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)).alias(other_salt))

    qb = blocked(q, "q_", ident, "_sq", "_qs", "_sr", "_rs")
    rb = blocked(r, "r_", ["_rid"], "_sr", "_rs", "_sq", "_qs")
    by = ["_bundle", "_qs", "_rs"]
    return qb.groupBy(*by).cogroup(rb.groupBy(*by)).applyInPandas(_kernel(ident, features, k), schema)


def knn_approx(query: DataFrame, ref: DataFrame, features: Sequence[str], k: int = 1, *, query_id: str, ref_id: str, carry: Sequence[str] = (),
               pair_budget: float, tables: int = TABLES, seed: int = 17) -> DataFrame:
    """As ``knn``, approximately: (carry, query_id, rank, dist, ref_id, recall); recall is that of the row's ``carry`` group
    on the sampled query rows.  Query rows that share no cell with a reference row have no result rows."""
    features, carry = list(features), list(carry)
    ident = [*carry, "_qid"]
    cols = [F.col(f).cast("double").alias(f) for f in features]
    q = materialise(query.select(*carry, F.col(query_id).alias("_qid"), *cols).dropna(subset=features), "approx-query")
    r = materialise(ref.select(F.col(ref_id).alias("_rid"), *cols).dropna(subset=features), "approx-ref")
    n_query, n_ref = q.count(), r.count()
    chosen = F.pmod(F.xxhash64(F.lit("recall"), *ident), F.lit(1 << 30)) < int(min(1.0, RECALL_ROWS / max(n_query, 1)) * (1 << 30))
    exact = materialise(knn(q.filter(chosen), r, features, k, query_id="_qid", ref_id="_rid", carry=carry), "approx-exact")
    reach = exact.filter(F.col("rank") == k).agg(F.percentile("dist", 0.9)).first()[0]
    if reach is None:
        raise ValueError(f"no sampled query row has {k} neighbours")
    width = WIDTH * max(float(reach), 1e-12)
    qc = _cells(q, features, width, tables, seed)
    rc = _cells(r, features, width, tables, seed)
    cell = ["_table", "_key"]
    sizes = qc.groupBy(*cell).agg(F.count(F.lit(1)).alias("_nq")).join(rc.groupBy(*cell).agg(F.count(F.lit(1)).alias("_nr")), cell)
    sizes = materialise(sizes, "approx-cells")
    pairs = sizes.agg(F.sum(F.col("_nq") * F.col("_nr"))).first()[0] or 0
    if pairs > pair_budget:
        raise PairBudgetExceeded(f"{pairs} pairs to compare, {pair_budget:.0f} allowed; the exact search compares about 3 % of {n_query * n_ref}")
    w = Window.partitionBy(*ident).orderBy("dist", "_rid")
    schema = T.StructType([q.schema[c] for c in ident] + [T.StructField("dist", T.DoubleType()), T.StructField("_rid", r.schema["_rid"].dataType)])

    def nearest(found: DataFrame) -> DataFrame:
        # a pair may share cells of several tables
        once = found.groupBy(*ident, "_rid").agg(F.min("dist").alias("dist"))
        return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    passes = []
    for start in range(0, tables, PASS_TABLES):
        only = range(start, min(start + PASS_TABLES, tables))
        met = _met(q, r, sizes, ident, features, k, schema, lambda rows, only=only: _cells(rows, features, width, tables, seed, only), only, (n_query + n_ref) * len(only))
        passes.append(materialise(nearest(met).drop("rank"), "approx-pass"))
    best = passes[0]
    for part in passes[1:]:
        best = best.unionByName(part)
    best = materialise(nearest(best), "approx-best")
    known = exact.select(*carry, F.col("_qid"), F.col("ref_id").alias("_rid"))
    hit = known.join(best.select(*ident, "_rid", F.lit(1.0).alias("_hit")), [*ident, "_rid"], "left")
    recall = hit.groupBy(*carry).agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))
    out = best.join(recall, carry, "left") if carry else best.withColumn("recall", F.lit(recall.first()["recall"]))
    return out.select(*carry, F.col("_qid").alias(query_id), "rank", "dist", F.col("_rid").alias("ref_id"), "recall")
