"""Order-dependent primitives that stay distributed.

``with_row_index`` numbers rows 1..n in a total order without a single-partition
window: range-partition + local sort, per-partition sizes (one row per partition),
prefix offsets over that tiny table, broadcast back.

``cumulative_counts`` gives, for every distinct (key, x), the weight of values
<= x within its key (a CDF) the same way: range slices on (key, x), running sums
inside each slice and key, per-(slice, key) totals -> offsets.

``ranked_rows`` gives every row the weight below its value and at its value; the row
travels with its slice, so ranks are not joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.session import materialise


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)


def with_row_index(df: DataFrame, order_cols: Sequence[str], name: str = "row_id",
                   num_partitions: int | None = None) -> DataFrame:
    """Append ``name`` = 1-based position of the row in ``order_cols`` order (must be a unique key)."""
    n = _num_partitions(df, num_partitions)
    pid = F.spark_partition_id()
    ranged = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", pid)
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33))
    )
    # written once, so positions and partition sizes come from the same rows; Parquet is smaller than a checkpoint
    ranged = materialise(ranged, "ranged")
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # offsets has one row per partition: bounded by configuration, not by data
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_pos") + 1).cast("long"))
        .drop("_pid", "_pos", "_off")
    )


def cumulative_counts(df: DataFrame, keys: Sequence[str], x: str, weights: Sequence[str],
                      num_partitions: int | None = None) -> DataFrame:
    """For distinct (keys, x) rows with integer weight columns, append per weight ``w``:
    ``cum_w`` = sum of w over values <= x in the key, ``tot_w`` = key total, and
    ``pos`` = dense 1-based position of x within its key; ``x_next`` = the key's next x.

    The range slice of a row is stored with the row, in a written table, and both the
    running sums and the offsets read that table: nothing depends on two evaluations of
    one range exchange agreeing.  A hot key is spread over its slices."""
    keys, weights = list(keys), list(weights)
    n = _num_partitions(df, num_partitions)
    sliced = materialise(
        df.select(*keys, x, *weights).repartitionByRange(n, *keys, x).withColumn("_slice", F.spark_partition_id()), "slices")
    # one row per slice and key in it: at most slices + keys rows
    sums = sliced.groupBy("_slice", *keys).agg(
        *[F.sum(w).alias(f"_t_{w}") for w in weights], F.count(F.lit(1)).alias("_t_pos"), F.min(x).alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        F.col("_slice").alias("_at"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_t_{w}").over(whole).alias(f"tot_{w}") for w in weights],
        F.coalesce(F.sum("_t_pos").over(before), F.lit(0)).alias("_o_pos"),
        F.lead("_low").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_next_low"))
    ordered = Window.partitionBy("_slice", *keys).orderBy(x)
    local = ordered.rowsBetween(Window.unboundedPreceding, 0)
    running = sliced.select(
        *keys, x, *weights, "_slice", *[F.sum(w).over(local).alias(f"_c_{w}") for w in weights],
        F.count(F.lit(1)).over(local).alias("_c_pos"), F.lead(x).over(ordered).alias("_next"))
    same = F.col("_slice") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = running.join(offsets, same)
    sel = [*keys, x]
    for w in weights:
        sel += [F.col(w), (F.col(f"_c_{w}") + F.col(f"_o_{w}")).alias(f"cum_{w}"), F.col(f"tot_{w}")]
    return out.select(*sel, (F.col("_c_pos") + F.col("_o_pos")).alias("pos"), F.coalesce("_next", "_next_low").alias("x_next"))


def ranked_rows(df: DataFrame, keys: Sequence[str], x: str, weights: Sequence[str], spread: str, num_partitions: int | None = None) -> DataFrame:
    """``df`` with, per weight ``w``: ``below_w`` and ``at_w``, the sums of ``w`` over rows of the key with a smaller
    and with an equal ``x``.

    Rows are sliced by (keys, x, ``spread``), so a value that many rows share spreads over slices; ``spread``
    is any column that tells rows apart.  What a slice lacks about its first and last value is
    a table of at most two rows per slice and key."""
    keys, weights = list(keys), list(weights)
    n = _num_partitions(df, num_partitions)
    sliced = materialise(df.repartitionByRange(n, *keys, x, spread).withColumn("_slice", F.spark_partition_id()), "ranked")
    place = ["_slice", *keys]
    ties = Window.partitionBy(*place, x)
    upto = Window.partitionBy(*place).orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(w).over(upto).alias(f"_c_{w}") for w in weights], *[F.sum(w).over(ties).alias(f"_e_{w}") for w in weights])
    totals = sliced.groupBy(*place).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights], F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(totals.select(*place, "_lo", "_hi", *[f"_t_{w}" for w in weights], *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights]), "ranked-offsets")
    # first and last value of each slice and key: their sums over all slices, and what lies below; only their rows
    # are added up, since below a slice's first value nothing of it lies, and below its last all but that value's rows
    near = sliced.join(F.broadcast(offsets), place).filter((F.col(x) == F.col("_lo")) | (F.col(x) == F.col("_hi")))
    mine = near.groupBy(*place, x, "_lo", *[f"_{m}_{w}" for w in weights for m in "ot"]).agg(*[F.sum(w).alias(f"_e_{w}") for w in weights])
    less = {w: F.when(F.col(x) == F.col("_lo"), 0).otherwise(F.col(f"_t_{w}") - F.col(f"_e_{w}")) for w in weights}
    whole = mine.groupBy(*keys, x).agg(
        *[F.sum(f"_e_{w}").alias(f"_we_{w}") for w in weights], *[F.min(F.col(f"_o_{w}") + less[w]).alias(f"_wb_{w}") for w in weights],
        F.count(F.lit(1)).alias("_over")).filter("_over > 1").drop("_over")
    # both tables are bounded by slices and keys, so the rows stay where they are
    out = local.join(F.broadcast(offsets.select(*place, *[f"_o_{w}" for w in weights])), place).join(F.broadcast(whole), [*keys, x], "left")
    sel = [F.col(c) for c in df.columns]
    for w in weights:
        sel.append(F.coalesce(f"_wb_{w}", F.col(f"_o_{w}") + F.col(f"_c_{w}") - F.col(f"_e_{w}")).alias(f"below_{w}"))
        sel.append(F.coalesce(f"_we_{w}", f"_e_{w}").alias(f"at_{w}"))
    return out.select(*sel)
