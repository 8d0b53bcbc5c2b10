"""Order statistics of all distances between two row sets, by dual-tree pair counting.

Both sides lie in the leaves of one kd-tree (``kdtree.py``).  Node pairs are walked down
together by joins on the parents.  A pair of nodes whose boxes are wholly nearer than the
bracket is counted by the product of its sizes, one that is wholly further is left out, and
only straddling pairs go down.  Straddling blocks of at most ``BLOCK`` x ``BLOCK`` rows meet
in a cogroup, where their leaves are treated the same way and only straddling leaf pairs are
expanded in numpy.  Pairs of rows are counted, never emitted.

The bracket starts at a quantile of a bounded hash sample and is checked by counting; every
pass counts ``BINS`` sub-intervals at once and keeps those that hold the wanted ranks.  When
at most ``LISTED`` distances lie in the bracket, the last pass returns them.  The result is
exact; the sample decides only the number of passes.

A straddling leaf pair costs its rows' product in every pass, so the work grows with both
sides; ``expanded`` reports it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators import kdtree
from fidelis.operators.knn import few_true
from fidelis.session import materialise

LEAF_ROWS = 144
BLOCK = 65_536  # rows of a block on either side; a row travels once per block that it meets
BINS = 4_096
LISTED = 262_144
START_ROWS = 4_096  # sampled rows of each side that give the first bracket
START_SPREAD = 0.08  # the first bracket reaches so far below and above the wanted share
TILE = 524_288  # pairs measured at once
TILE_COLUMNS = 4_096
STEP = 2  # levels that both sides go down by one join
MAX_PASSES = 40
TASKS = 4  # of a pass for every shuffle partition, at most


def _leaf_groups(df: pd.DataFrame, cols: list[str]):
    df = df.sort_values("_leaf", kind="stable")
    x, leaf = df[cols].to_numpy(dtype=np.float64), df["_leaf"].to_numpy()
    first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    return x, first, np.r_[first[1:], len(x)], np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)


def count_block(a: pd.DataFrame, b: pd.DataFrame, af: list[str], bf: list[str], edges: np.ndarray):
    """Distances of two blocks: below edges[0], counts between the edges, expanded pairs, those between two edges."""
    x, a_from, a_to, a_lo, a_hi = _leaf_groups(a, af)
    y, b_from, b_to, b_lo, b_hi = _leaf_groups(b, bf)
    low, high = edges[0], edges[-1]
    gap, reach = np.zeros((len(a_from), len(b_from))), np.zeros((len(a_from), len(b_from)))
    for i in range(x.shape[1]):
        apart = np.maximum(np.maximum(a_lo[:, None, i] - b_hi[None, :, i], b_lo[None, :, i] - a_hi[:, None, i]), 0.0)
        far = np.maximum(a_hi[:, None, i] - b_lo[None, :, i], b_hi[None, :, i] - a_lo[:, None, i])
        gap += apart * apart
        reach += far * far
    safe = 1e-9
    inside = reach < low * low * (1 - safe)
    straddling = ~inside & (gap <= high * high * (1 + safe))
    sizes = (a_to - a_from)[:, None] * (b_to - b_from)[None, :]
    below, expanded = int(sizes[inside].sum()), int(sizes[straddling].sum())
    counts, values = np.zeros(len(edges) - 1, np.int64), []
    # screen: all squared distances of a tile by one single-precision product of (-2x, |x|^2, 1) and (y, 1, |y|^2)
    centre = y.mean(axis=0)
    xc, yc = x - centre, y - centre
    xn, yn = np.einsum("ij,ij->i", xc, xc), np.einsum("ij,ij->i", yc, yc)
    one = lambda v: np.ones((len(v), 1))
    left = np.hstack([-2.0 * xc, xn[:, None], one(xc)]).astype(np.float32)
    right = np.hstack([yc, one(yc), yn[:, None]]).astype(np.float32)
    for j in np.flatnonzero(straddling.any(axis=1)):
        all_ = np.concatenate([np.arange(b_from[k], b_to[k]) for k in np.flatnonzero(straddling[j])])
        for c in range(0, len(all_), TILE_COLUMNS):
            at = all_[c:c + TILE_COLUMNS]
            turned, farthest = np.ascontiguousarray(right[at].T), yn[at].max()
            step = max(1, TILE // len(at))
            for s in range(a_from[j], a_to[j], step):
                e = min(s + step, a_to[j])
                d2 = left[s:e] @ turned
                # its rounding error is below tol; what lies within it is measured in double precision
                tol = 4e-7 * (x.shape[1] + 4) * (xn[s:e].max() + farthest) + 1e-12
                found = few_true(d2 <= np.float32(high * high + tol))
                open_ = d2.reshape(-1)[found] >= np.float32(low * low - tol)
                below += len(found) - int(np.count_nonzero(open_))
                rows, cols = np.divmod(found[open_], d2.shape[1])
                diff = x[s + rows] - y[at[cols]]
                d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                below += int((d < low).sum())
                d = d[(d >= low) & (d < high)]
                counts += np.bincount(np.searchsorted(edges, d, "right") - 1, minlength=len(counts))[:len(counts)]
                if len(edges) == 2:  # the last pass lists them, at most LISTED
                    values.append(d)
    return below, counts, expanded, np.concatenate(values) if values else np.zeros(0)


def _kernel(by: list[str], features: list[str], listed: bool):
    af, bf = [f"a_{f}" for f in features], [f"b_{f}" for f in features]

    def run(a, b):
        if not len(a) or not len(b):
            none = {c: a[c].to_numpy()[:0] for c in by}
            return pd.DataFrame(none | {"below": [], "counts": [], "expanded": [], "found": []})
        edges = np.linspace(a["_low"].iloc[0], a["_high"].iloc[0], 2 if listed else BINS + 1)
        below, counts, expanded, values = count_block(a, b, af, bf, edges)
        return pd.DataFrame({c: [a[c].iloc[0]] for c in by} | {
            "below": [below], "counts": [counts], "expanded": [expanded], "found": [values if listed else np.zeros(0)]})

    return run


def _start(by: list[str], features: list[str], share: float):
    """First bracket of one dataset from sampled rows of both sides."""

    def run(a, b):
        keys = {c: [a[c].iloc[0]] for c in by}
        x, y = (df[features].to_numpy(dtype=np.float64) for df in (a, b))
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0))
        low, high = np.quantile(d, [max(0.0, share * (1 - START_SPREAD)), min(1.0, share * (1 + START_SPREAD))])
        return pd.DataFrame(keys | {"_low": [float(low)], "_high": [float(max(high, np.nextafter(low, np.inf)))]})

    return run


class PairDistances:
    """Distances between each dataset of ``rows`` and all of ``ref``; rows with a null feature are left out."""

    def __init__(self, rows: DataFrame, ref: DataFrame, features: Sequence[str], by: Sequence[str], row_id: str, leaf_rows: int = LEAF_ROWS,
                 block: int = BLOCK):
        self.features, self.by, self.p = list(features), list(by), len(features)
        cols = [F.col(f).cast("double").alias(f) for f in features]
        a = rows.select(*by, F.col(row_id).alias("_id"), *cols).dropna(subset=self.features)
        b = ref.select(F.col(row_id).alias("_id"), *cols).dropna(subset=self.features)
        self.n_ref = b.count()
        self.tree = kdtree.build(b, self.features, "_id", kdtree.depth_for(self.n_ref, leaf_rows))
        a = materialise(self.tree.place(a), "pairs-rows")
        b = materialise(self.tree.place(b), "pairs-ref")
        self.sizes = materialise(a.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).coalesce(1), "pairs-sizes")
        typical = self.sizes.agg(F.avg("_rows")).first()[0] or 1
        # blocks: nodes of about BLOCK rows; more rows than that in one node (equal rows) are salted
        self.a_level = min(self.tree.depth, kdtree.depth_for(typical, block))
        self.b_level = min(self.tree.depth, kdtree.depth_for(self.n_ref, block))
        self.block = block
        self.a, self.a_nodes = self._blocked(a, "a", self.a_level, self.by)
        self.b, self.b_nodes = self._blocked(b, "b", self.b_level, [])

    def _blocked(self, rows: DataFrame, side: str, level: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        node = F.shiftright("_leaf", self.tree.depth - level)
        nodes = materialise(kdtree.boxes(rows, self.features, node, keys), f"pairs-nodes-{side}")
        salts = nodes.select(*keys, F.col("_node").alias(f"_{side}"), F.ceil(F.col("_n") / self.block).cast("int").alias(f"_s{side}"))
        named = rows.select(*keys, "_leaf", "_id", node.alias(f"_{side}"), *[F.col(f).alias(f"{side}_{f}") for f in self.features])
        salted = named.join(salts, [*keys, f"_{side}"]).withColumn(f"_{side}k", F.pmod(F.xxhash64("_id"), F.col(f"_s{side}")).cast("int"))
        return materialise(salted.drop("_id", f"_s{side}"), f"pairs-blocks-{side}"), nodes

    def first_bracket(self, share: float) -> DataFrame:
        by, f = self.by, self.features
        # hash samples of about START_ROWS rows a side
        u = lambda cols: F.pmod(F.xxhash64(F.lit("pairs"), *cols), F.lit(1 << 30)) / float(1 << 30)
        a = self.a.select(*by, *[F.col(f"a_{c}").alias(c) for c in f]).join(F.broadcast(self.sizes), by)  # one row a dataset
        a = a.filter(u(f) * F.col("_rows") <= START_ROWS).drop("_rows")
        b = self.b.select(*[F.col(f"b_{c}").alias(c) for c in f]).filter(u(f) * self.n_ref <= START_ROWS)
        listed = F.array(*[F.struct(*[F.lit(k[c]).alias(c) for c in by]) for k in self.sizes.select(*by).collect()])  # one row a dataset
        b = b.select(F.explode(listed).alias("_d"), *f).select("_d.*", *f)
        schema = T.StructType([self.sizes.schema[c] for c in by] + [T.StructField(c, T.DoubleType()) for c in ("_low", "_high")])
        return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(_start(by, f, share), schema)

    def _straddling(self, bracket: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(block pairs to expand, node pairs wholly below the bracket) of both trees walked down together."""
        by, p = self.by, self.p
        front = bracket.select(*by, "_low", "_high", F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"))
        sure = None
        la = lb = 0
        while True:
            na, nb = min(self.a_level, la + STEP), min(self.b_level, lb + STEP)
            a = kdtree.parents(self.a_nodes, p, self.a_level - na, by)
            b = kdtree.parents(self.b_nodes, p, self.b_level - nb)
            a = a.select(*by, F.shiftright("_node", na - la).alias("_a"), F.col("_node").alias("_an"), F.col("_n").alias("_na"), F.col("_lo").alias("_alo"), F.col("_hi").alias("_ahi"))
            b = b.select(F.shiftright("_node", nb - lb).alias("_b"), F.col("_node").alias("_bn"), F.col("_n").alias("_nb"), F.col("_lo").alias("_blo"), F.col("_hi").alias("_bhi"))
            met = front.join(a, [*by, "_a"]).join(b, "_b")
            reach = kdtree.box_reach2(p, "_alo", "_ahi", "_blo", "_bhi") < F.col("_low") * F.col("_low") * (1 - 1e-9)
            gap = kdtree.box_distance2(p, "_alo", "_ahi", "_blo", "_bhi") <= F.col("_high") * F.col("_high") * (1 + 1e-9)
            met = materialise(met.filter(gap).select(*by, "_low", "_high", F.col("_an").alias("_a"), F.col("_bn").alias("_b"), "_na", "_nb", reach.alias("_sure")), "pairs-front")
            part = met.filter("_sure").groupBy(*by).agg(F.sum(F.col("_na") * F.col("_nb")).alias("_sure"))
            sure = part if sure is None else sure.unionByName(part)
            front = met.filter("NOT _sure")
            la, lb = na, nb
            if (la, lb) == (self.a_level, self.b_level):
                return front, sure.groupBy(*by).agg(F.sum("_sure").alias("_sure"))
            front = front.drop("_na", "_nb", "_sure")

    def count(self, bracket: DataFrame, listed: bool = False) -> DataFrame:
        """Per dataset: below (distances under _low), counts (array over the bracket's bins), expanded, found."""
        by = self.by
        front, sure = self._straddling(bracket)
        salts = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / self.block).cast("int") - 1))
        blocks = front.select("*", salts("_na").alias("_ak")).select(*by, "_low", "_high", "_a", "_ak", "_b", salts("_nb").alias("_bk"))
        blocks = materialise(blocks, "pairs-met")
        left = self.a.join(blocks, [*by, "_a", "_ak"])
        right = self.b.join(blocks.drop("_low", "_high"), ["_b", "_bk"])
        key = [*by, "_a", "_ak", "_b", "_bk"]
        schema = T.StructType([self.sizes.schema[c] for c in by] + [
            T.StructField("below", T.LongType()), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("expanded", T.LongType()),
            T.StructField("found", T.ArrayType(T.DoubleType()))])
        # a block pair is much work on few bytes: so many partitions, not as many as their bytes fill
        tasks = max(1, min(blocks.count(), TASKS * int(self.sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        left, right = left.repartition(tasks, *key), right.repartition(tasks, *key)
        done = materialise(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_kernel(by, self.features, listed), schema), "pairs-counted")
        bins = 1 if listed else BINS
        sums = done.groupBy(*by).agg(F.sum("below").alias("below"), F.sum("expanded").alias("expanded"), F.flatten(F.collect_list("found")).alias("found"))
        by_bin = done.select(*by, F.posexplode("counts").alias("_bin", "_held")).groupBy(*by, "_bin").agg(F.sum("_held").alias("_held"))
        listed_bins = by_bin.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_bin", "_held"))).alias("_bins"))  # BINS a dataset
        sums = sums.join(listed_bins.select(*by, F.col("_bins._held").alias("counts")), by)
        zeros = F.array_repeat(F.lit(0).cast("long"), bins)
        return bracket.select(*by).join(sums, by, "left").join(sure, by, "left").select(
            *by, (F.coalesce("below", F.lit(0)) + F.coalesce("_sure", F.lit(0))).alias("below"), F.coalesce("counts", zeros).alias("counts"),
            F.coalesce("expanded", F.lit(0)).alias("expanded"), F.coalesce("found", F.array().cast("array<double>")).alias("found"))

    def quantile(self, share: float) -> list[dict]:
        """Per dataset: value (the quantile of all distances, linear between ranks), pairs, expanded (pairs of rows in the
        dearest pass), passes.  One row a dataset passes the driver each pass."""
        by = self.by
        spark = self.sizes.sparkSession
        state = {}
        for r in self.first_bracket(share).join(self.sizes, by).collect():
            pairs = r["_rows"] * self.n_ref
            place = share * (pairs - 1)
            state[tuple(r[c] for c in by)] = {"low": r["_low"], "high": r["_high"], "pairs": pairs, "at": math.floor(place), "part": place - math.floor(place),
                                              "passes": 0, "expanded": 0, "held": None}
        key_schema = [self.sizes.schema[c] for c in by]
        schema = T.StructType(key_schema + [T.StructField("_low", T.DoubleType()), T.StructField("_high", T.DoubleType())])
        for _ in range(MAX_PASSES):
            open_ = {k: s for k, s in state.items() if "value" not in s}
            if not open_:
                break
            for listed in (False, True):
                now = {k: s for k, s in open_.items() if (s["held"] is not None and s["held"] <= LISTED) == listed}
                if not now:
                    continue
                bracket = spark.createDataFrame([(*k, s["low"], s["high"]) for k, s in now.items()], schema)
                for r in self.count(bracket, listed).collect():
                    s = state[tuple(r[c] for c in by)]
                    s["passes"] += 1
                    s["expanded"] = max(s["expanded"], r["expanded"])
                    _narrow(s, r, listed)
        if any("value" not in s for s in state.values()):
            raise RuntimeError("the bracket did not close")
        return [dict(zip(by, k)) | {c: s[c] for c in ("value", "pairs", "expanded", "passes")} for k, s in state.items()]


def _narrow(s: dict, r, listed: bool) -> None:
    """Take one pass's counts into a dataset's bracket."""
    at, after = s["at"], min(s["at"] + 1, s["pairs"] - 1)
    upto = r["below"] + np.cumsum(r["counts"])
    if r["below"] > at:  # too high
        s["low"], s["high"], s["held"] = 0.0, s["low"], None
    elif upto[-1] <= after:  # too low
        s["low"], s["high"], s["held"] = (s["high"] if upto[-1] <= at else s["low"]), 2 * s["high"], None
    elif listed:
        found = np.sort(r["found"])
        a, b = found[at - r["below"]], found[after - r["below"]]
        s["value"] = float(a + (b - a) * s["part"])
    else:
        edges = np.linspace(s["low"], s["high"], BINS + 1)
        i, j = int(np.searchsorted(upto, at, "right")), int(np.searchsorted(upto, after, "right"))
        held = int(upto[j] - (upto[i - 1] if i else r["below"]))
        if edges[i] >= edges[j + 1] or (edges[i], edges[j + 1]) == (s["low"], s["high"]) or np.nextafter(edges[i], np.inf) >= edges[j + 1]:
            s["value"] = float(edges[i])  # equal distances: the bracket is as narrow as doubles go
        s["low"], s["high"], s["held"] = float(edges[i]), float(edges[j + 1]), held
