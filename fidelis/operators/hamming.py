"""Nearest tuple in Hamming distance by a multi-index over parts of the tuple.

Two tuples of q columns that differ in at most r of them agree on at least one of any r + 1
parts that their columns are dealt to.  Round r deals the columns to r + 1 parts and joins the
tuples that are still open to the reference tuples that agree on a part; the least distance
found that is at most r is the least of all.  So q rounds of one join each replace the joins
over all 2^q subsets of columns, and most tuples are settled while parts are still wide.

Tuples that agree on a part meet in a cogroup keyed by (part, value, query salt, reference
salt) of at most ``BLOCK`` x ``BLOCK`` tuples; a block returns one candidate per query tuple.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.session import materialise

BLOCK = 2048


def _codes(columns: Sequence[str], side: str) -> Column:
    """64-bit codes of the columns; a null equals nothing (it has a code of its own on each side)."""
    return F.array(*[F.when(F.col(c).isNull(), F.xxhash64(F.lit(f"null of {side}"), F.lit(i))).otherwise(F.xxhash64(F.col(c), F.lit(i)))
                     for i, c in enumerate(columns)])


def _parts(q: int, parts: int) -> Column:
    """One struct (part, value) per part; column i belongs to part i % parts."""
    return F.array(*[F.struct(F.lit(k).alias("_part"), F.xxhash64(*[F.get("_codes", F.lit(i)) for i in range(k, q, parts)]).alias("_value"))
                     for k in range(parts)])


def _kernel(radius: int):
    """cogroup body: per query tuple the best reference tuple of the block, within the radius."""

    def run(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"_t": np.zeros(0, np.int64), "_equal": np.zeros(0, np.int32), "_rid": np.zeros(0, np.int64)})
        x, y, rid = np.stack(a["_codes"].to_numpy()), np.stack(b["_codes"].to_numpy()), b["_rid"].to_numpy()
        order = np.argsort(rid, kind="stable")
        y, rid = y[order], rid[order]
        equal = np.zeros((len(x), len(y)), np.int16)
        for i in range(x.shape[1]):
            equal += x[:, i, None] == y[None, :, i]
        best = equal.argmax(axis=1)  # the first of the best: the smallest id
        most = equal[np.arange(len(x)), best]
        good = most >= x.shape[1] - radius
        return pd.DataFrame({"_t": a["_t"].to_numpy()[good], "_equal": most[good].astype(np.int32), "_rid": rid[best[good]]})

    return run


def nearest_tuples(query: DataFrame, ref: DataFrame, columns: Sequence[str], ref_id: str) -> DataFrame:
    """Per distinct tuple of ``columns`` in ``query``: ``equal`` (columns equal to the nearest reference tuple) and
    ``ref_id`` (a long) of the nearest reference row, the smallest on ties.  Tuples without any equal column are
    returned with equal 0 and the smallest id of all; a null equals nothing."""
    columns = list(columns)
    q = len(columns)
    # numbered while written, so a number keeps to its tuple
    asked = query.select(*columns).distinct().select(*columns, F.monotonically_increasing_id().alias("_t"), _codes(columns, "query").alias("_codes"))
    asked = materialise(asked, "hamming-asked")
    known = ref.groupBy(*columns).agg(F.min(F.col(ref_id)).alias("_rid")).select("_rid", _codes(columns, "ref").alias("_codes"))
    known = materialise(known, "hamming-known")
    pending, found = asked.select("_t", "_codes"), None
    for radius in range(q):
        split = _parts(q, radius + 1)
        a = pending.select("_t", "_codes", F.explode(split).alias("_p")).select("_t", "_codes", "_p.*")
        b = known.select("_rid", "_codes", F.explode(split).alias("_p")).select("_rid", "_codes", "_p.*")
        key = ["_part", "_value"]
        sizes = a.groupBy(*key).agg(F.count(F.lit(1)).alias("_na")).join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("_nb")), key)
        sizes = materialise(sizes.select(*key, F.ceil(F.col("_na") / BLOCK).cast("int").alias("_sa"), F.ceil(F.col("_nb") / BLOCK).cast("int").alias("_sb")), "hamming-blocks")
        qa = a.join(sizes, key).select(*key, "_t", "_codes", F.pmod(F.xxhash64("_t"), F.col("_sa")).cast("int").alias("_ka"), F.explode(F.sequence(F.lit(0), F.col("_sb") - 1)).alias("_kb"))
        rb = b.join(sizes, key).select(*key, "_rid", "_codes", F.pmod(F.xxhash64("_rid"), F.col("_sb")).cast("int").alias("_kb"), F.explode(F.sequence(F.lit(0), F.col("_sa") - 1)).alias("_ka"))
        by = [*key, "_ka", "_kb"]
        met = qa.groupBy(*by).cogroup(rb.groupBy(*by)).applyInPandas(_kernel(radius), "_t long, _equal int, _rid long")
        best = F.min(F.struct((-F.col("_equal")).alias("e"), F.col("_rid").alias("r"))).alias("_b")
        settled = materialise(met.groupBy("_t").agg(best).select("_t", (-F.col("_b.e")).alias("equal"), F.col("_b.r").alias("_rid")), "hamming-found")
        found = settled if found is None else found.unionByName(settled)
        pending = materialise(pending.join(settled.select("_t"), "_t", "left_anti"), "hamming-open")
        if pending.isEmpty():
            break
    anyone = known.agg(F.min("_rid")).first()[0]
    rest = pending.select("_t", F.lit(0).alias("equal"), F.lit(anyone).cast("long").alias("_rid"))
    return asked.drop("_codes").join(found.unionByName(rest), "_t").select(*columns, "equal", F.col("_rid").alias("ref_id"))
