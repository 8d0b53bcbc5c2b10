"""A kd-tree over many rows, kept as tables: splits, leaves of rows, boxes of nodes.

Splits are medians of a hash sample of ``SAMPLE`` rows a leaf, along the feature of the
greatest spread, ``LEVELS`` levels a round: each node of a round is built in one group of a
bounded number of sampled rows, and its splits are one row of a table.  The sample decides
only how even the leaves are.  Rows are routed by column expressions.  A leaf's number read
in binary is its path, so an ancestor is a shift, and the box of a node is the least and
greatest value of every feature among its own rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.session import materialise

LEVELS = 10  # levels built in one round: 1,024 leaves
SAMPLE = 48  # sampled rows a leaf


def _build(levels: int, p: int):
    """applyInPandas body: heap-ordered median splits of one node's sampled rows."""

    def run(key, rows):
        x = np.stack(rows["_x"].to_numpy()) if len(rows) else np.zeros((0, p))
        dims, cuts = np.zeros(2 ** levels - 1, np.int32), np.full(2 ** levels - 1, np.inf)
        parts = {0: np.arange(len(x))}
        for node in range(2 ** levels - 1):
            at = parts.pop(node, None)
            if at is None or len(at) < 2:
                continue  # all its rows go left
            mine = x[at]
            d = int(mine.std(axis=0).argmax())
            cut = float(np.median(mine[:, d]))
            if cut == mine[:, d].min():  # many equal values: cut above them, if anything is
                above = mine[:, d][mine[:, d] > cut]
                if not len(above):
                    continue
                cut = float(above.min())
            dims[node], cuts[node] = d, cut
            right = mine[:, d] >= cut
            parts[2 * node + 1], parts[2 * node + 2] = at[~right], at[right]
        return pd.DataFrame({"_at": [key[0]], "_dims": [dims], "_cuts": [cuts]})

    return run


@dataclass
class Tree:
    """Splits of a kd-tree of ``depth`` levels; leaves are numbered 0 .. 2**depth - 1."""

    features: list[str]
    depth: int
    rounds: list[tuple[int, DataFrame]] = field(default_factory=list)

    def place(self, rows: DataFrame, name: str = "_leaf") -> DataFrame:
        """``rows`` with the number of the leaf that each row falls into (features without nulls)."""
        out = rows.withColumn(name, F.lit(0).cast("long"))
        x = F.array(*[F.col(f).cast("double") for f in self.features])
        out = out.withColumn("_x", x)
        for levels, splits in self.rounds:
            out = _route(out, splits, levels, name)
        return out.drop("_x")


def _route(rows: DataFrame, splits: DataFrame, levels: int, name: str) -> DataFrame:
    step = lambda node, _: 2 * node + 1 + (F.get("_x", F.get("_dims", node)) >= F.get("_cuts", node)).cast("int")
    went = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step) - F.lit(2 ** levels - 1)
    joined = rows.join(splits, F.col(name) == F.col("_at"), "left")
    # a node without splits (no sampled row): its rows go to its first leaf
    return joined.withColumn(name, F.shiftleft(name, levels) + F.coalesce(went, F.lit(0)).cast("long")).drop("_at", "_dims", "_cuts")


def depth_for(rows: int | float, leaf_rows: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / leaf_rows)))


def build(ref: DataFrame, features: Sequence[str], row_id: str, depth: int) -> Tree:
    """Tree of ``depth`` levels over ``ref`` (features without nulls)."""
    tree = Tree(list(features), 0)
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = ref.select(F.xxhash64(F.lit("kd"), F.col(row_id)).alias("_u"), x.alias("_x"), F.lit(0).cast("long").alias("_node"))
    total = ref.count()
    while tree.depth < depth:
        levels = min(LEVELS, depth - tree.depth)
        share = min(1.0, SAMPLE * 2.0 ** (tree.depth + levels) / max(total, 1))
        sampled = rows.filter(F.pmod("_u", F.lit(1 << 30)) < int(share * (1 << 30)))
        splits = materialise(
            sampled.select("_node", "_x").groupBy("_node").applyInPandas(_build(levels, len(features)), "_at long, _dims array<int>, _cuts array<double>"),
            "kd-splits")
        if not tree.rounds:
            splits = F.broadcast(splits)  # one row of 2**LEVELS splits
        tree.rounds.append((levels, splits))
        tree.depth += levels
        if tree.depth < depth:
            rows = materialise(_route(rows, splits, levels, "_node"), "kd-rows")
    return tree


def boxes(placed: DataFrame, features: Sequence[str], node: Column, keys: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """(keys, _node, _n, _lo, _hi) of the nodes that ``node`` names for each row."""
    lo = F.array(*[F.min(f"{prefix}{f}") for f in features])
    hi = F.array(*[F.max(f"{prefix}{f}") for f in features])
    return placed.groupBy(*keys, node.alias("_node")).agg(F.count(F.lit(1)).alias("_n"), lo.alias("_lo"), hi.alias("_hi"))


def parents(nodes: DataFrame, p: int, shift: int, keys: Sequence[str] = ()) -> DataFrame:
    """Boxes ``shift`` levels above ``nodes``."""
    lo = F.array(*[F.min(F.get("_lo", F.lit(i))) for i in range(p)])
    hi = F.array(*[F.max(F.get("_hi", F.lit(i))) for i in range(p)])
    return nodes.groupBy(*keys, F.shiftright("_node", shift).alias("_node")).agg(F.sum("_n").alias("_n"), lo.alias("_lo"), hi.alias("_hi"))


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def box_distance2(p: int, lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared least distance of two boxes (arrays of p bounds); a point is a box with equal bounds."""
    out = []
    for i in range(p):
        gap = F.greatest(F.lit(0.0), F.get(lo_a, F.lit(i)) - F.get(hi_b, F.lit(i)), F.get(lo_b, F.lit(i)) - F.get(hi_a, F.lit(i)))
        out.append(gap * gap)
    return _sum(out)


def box_reach2(p: int, lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared greatest distance of two boxes."""
    out = []
    for i in range(p):
        gap = F.greatest(F.get(hi_a, F.lit(i)) - F.get(lo_b, F.lit(i)), F.get(hi_b, F.lit(i)) - F.get(lo_a, F.lit(i)))
        out.append(gap * gap)
    return _sum(out)
