"""Two-level joins, vertical splits and small table operators.

Joins are plain equi-joins: Spark broadcasts a side only below its own size threshold and
otherwise shuffles on the keys, with adaptive execution splitting hot ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATASET = ["technique", "replicate"]


def scan_table_filter(table: DataFrame, condition: Column | str, columns: Sequence[str] = ()) -> DataFrame:
    """Rows of a table that meet ``condition`` (pushed to the scan), optionally fewer columns."""
    out = table.filter(condition)
    return out.select(*columns) if columns else out


def join_two_level(lower: DataFrame, upper: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Lower-level rows with the columns of their upper-level unit; ``how`` is inner or left."""
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    condition = None
    for a, b in on:
        eq = lower[a] == upper[b]
        condition = eq if condition is None else condition & eq
    keys = {b for _, b in on}
    return lower.join(upper, condition, how).select(*[lower[c] for c in lower.columns], *[upper[c] for c in upper.columns if c not in keys])


def join_left_chain(parent: DataFrame, children: Sequence[DataFrame], key: str) -> DataFrame:
    """Parent with the columns of every child block, matched on ``key``."""
    out = parent
    for child in children:
        out = out.join(child, key, "left")
    return out


def split_parent_child(df: DataFrame, key: str, parent: Sequence[str], blocks: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Vertical split: a parent table and one table per block, all with ``key``."""
    return {"parent": df.select(key, *parent)} | {name: df.select(key, *cols) for name, cols in blocks.items()}


def concat_columns(left: DataFrame, right: DataFrame, row: str = "row_id") -> DataFrame:
    """Side by side by row number; a row without a partner gets nulls."""
    return left.join(right, row, "full_outer")


def semi_exact_match(panel: DataFrame, columns: Sequence[str], real: str = "REAL") -> DataFrame:
    """Synthetic rows whose whole tuple occurs in REAL (null and NaN never match)."""
    is_real = F.col("technique") == real
    tuples = panel.filter(is_real).select(*columns).distinct()
    for c in columns:
        tuples = tuples.filter(F.col(c).isNotNull())
        if panel.schema[c].dataType.typeName() in ("double", "float"):
            tuples = tuples.filter(~F.isnan(c))
    return panel.filter(~is_real).join(tuples, list(columns), "left_semi")


def join_compare_left(est: DataFrame, keys: Sequence[str], value: str, real: str = "REAL") -> DataFrame:
    """REAL's sheet with every technique's value beside it; a key that a technique lacks gives null.

    Only the list of technique names reaches the driver."""
    keys = list(keys)
    r = est.filter(F.col("technique") == real).select(*keys, F.col(value).alias("real"))
    s = est.filter(F.col("technique") != real)
    names = sorted(t[0] for t in s.select("technique").distinct().collect())
    listed = r.select(*keys, "real", F.explode(F.array(*[F.lit(t) for t in names])).alias("technique"))
    return listed.join(s.select("technique", *keys, F.col(value).alias("synthetic")), ["technique", *keys], "left")


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of ``a`` that ``b`` has too, in the order of ``a``."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def schema_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same columns in the same order."""
    return a.columns == b.columns


def profile(df: DataFrame, by: Sequence[str], means: dict[str, str], categories: dict[str, dict[str, Column]]) -> DataFrame:
    """Profile table in long form: N, share of named categories (percent) and mean, sd, min, max and
    percent missing of numeric columns, all in one aggregation."""
    aggs = [F.count(F.lit(1)).cast("double").alias("n|count")]
    for label, column in means.items():
        c = F.col(column)
        aggs += [F.avg(c).alias(f"{label}|mean"), F.stddev_samp(c).alias(f"{label}|sd"), F.min(c).cast("double").alias(f"{label}|min"),
                 F.max(c).cast("double").alias(f"{label}|max"), (F.avg(c.isNull().cast("double")) * 100).alias(f"{label}|missing_pct")]
    for label, tests in categories.items():
        aggs += [(F.avg(test.cast("double")) * 100).alias(f"{label}|{name}") for name, test in tests.items()]
    wide = df.groupBy(*by).agg(*aggs)
    cells = [c for c in wide.columns if c not in by]
    long = wide.unpivot(list(by), [F.col(f"`{c}`") for c in cells], "cell", "value")
    return long.select(*by, F.substring_index("cell", "|", 1).alias("variable"), F.substring_index("cell", "|", -1).alias("statistic"), "value")
