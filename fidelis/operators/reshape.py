"""Long/wide reshaping used by every evaluator (long is the working form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], variables: Sequence[str], *, var: str = "variable",
         val: str = "value", dtype: str = "double", drop_nulls: bool = False) -> DataFrame:
    """Wide -> long (``unpivot``); a narrow Expand, no shuffle."""
    ids = list(ids)
    src = df.select(*ids, *[F.col(v).cast(dtype).alias(v) for v in variables])
    out = src.unpivot(ids, list(variables), var, val)
    return out.filter(F.col(val).isNotNull()) if drop_nulls else out


def pivot_wide(long: DataFrame, keys: Sequence[str], pivot_col: str, values: Sequence, value_col: str,
               agg=F.first) -> DataFrame:
    """Long -> wide with an explicit value list (no extra job to discover the values)."""
    return long.groupBy(*keys).pivot(pivot_col, list(values)).agg(agg(value_col))


def unpivot_long(df: DataFrame, keys: Sequence[str], sep: str = "__") -> DataFrame:
    """Wide comparison sheet with ``TECH__metric`` columns -> (keys, technique, metric, value)."""
    measure = [c for c in df.columns if c not in keys and sep in c]
    long = melt(df, keys, measure, var="_col", val="value")
    return long.select(
        *keys,
        F.substring_index("_col", sep, 1).alias("technique"),
        F.expr(f"substring(_col, length(substring_index(_col, '{sep}', 1)) + {len(sep) + 1})").alias("metric"),
        "value",
    )


def sort_real_first(df: DataFrame, var: str = "variable", real: str = "REAL") -> DataFrame:
    return df.orderBy(F.col(var), (F.col("technique") != real), F.col("technique"))


def tech_to_col(c):
    """``"X (Y)"`` -> ``X_Y``."""
    return F.regexp_replace(F.regexp_replace(c, r"\s*\(", "_"), r"\)", "")


def minmax_normalize(df: DataFrame, value: str, out: str, partition: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min) over the partition; a constant metric maps to 0."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi - lo == 0, F.lit(0.0)).otherwise((F.col(value) - lo) / (hi - lo)))
