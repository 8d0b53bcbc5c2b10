"""Preparation operators: filters, recodes, imputers, scalers, name cleaning.

Per-dataset statistics (one row per technique x replicate x variable) are joined
back by broadcast: their size is bounded by the number of datasets and variables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.operators.marginal import exact_quantiles
from fidelis.operators.order import cumulative_counts
from fidelis.operators.reshape import melt

DATASET = ("technique", "replicate")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL for float columns (pandas/R treat NaN as missing, Spark as a value)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def filter_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """``CNT == x`` / ``isin(list)``."""
    return df.filter(F.col(column).isin(list(values)))


def complete_case_steps(df: DataFrame, groups: dict[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """Sequential complete-case filtering: rows removed at each step, in one pass.

    Step k removes the rows that are complete for groups 1..k-1 but not for group k.
    """
    names = list(groups)
    complete = {g: F.lit(True) for g in names}
    for g in names:
        cond = F.lit(True)
        for c in groups[g]:
            cond = cond & F.col(c).isNotNull()
            if df.schema[c].dataType.typeName() in ("double", "float"):
                cond = cond & ~F.isnan(c)
        complete[g] = cond
    aggs = [F.count(F.lit(1)).alias("_n0")]
    prefix = F.lit(True)
    for i, g in enumerate(names):
        aggs.append(F.count(F.when(prefix & ~complete[g], 1)).alias(f"_r{i}"))
        prefix = prefix & complete[g]
    wide = df.groupBy(*by).agg(*aggs)
    rows = []
    for i, g in enumerate(names):
        before = F.col("_n0")
        for j in range(i):
            before = before - F.col(f"_r{j}")
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(g).alias("item_group"), before.alias("n_before"),
                             F.col(f"_r{i}").alias("n_removed"), (before - F.col(f"_r{i}")).alias("n_after")))
    return wide.select(*by, F.explode(F.array(*rows)).alias("s")).select(*by, "s.*")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def mode_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = DATASET) -> DataFrame:
    """Most frequent non-null value per (dataset, variable); ties -> smallest value."""
    long = melt(df, list(by), columns, drop_nulls=True)
    return long.groupBy(*by, "variable").agg(F.mode("value", deterministic=True).alias("fill_value"))


def median_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = DATASET) -> DataFrame:
    """Exact median per (dataset, variable) via the distributed CDF."""
    long = melt(df, list(by), columns, drop_nulls=True)
    q = exact_quantiles(long, [*by, "variable"], "value", [0.5])
    return q.select(*by, "variable", F.col("quantile").alias("fill_value"))


def impute(df: DataFrame, fills: DataFrame, columns: Sequence[str], by: Sequence[str] = DATASET) -> DataFrame:
    """coalesce(column, fill) with fills in long form (dataset, variable, fill_value)."""
    wide = fills.groupBy(*by).pivot("variable", list(columns)).agg(F.first("fill_value"))
    wide = wide.select(*by, *[F.col(c).alias(f"_fill_{c}") for c in columns])
    # one row per dataset: bounded by the number of replicates
    j = df.join(F.broadcast(wide), list(by), "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"_fill_{c}")).alias(c) if c in columns else F.col(c)
                      for c in df.columns])


def imputation_report(df: DataFrame, fills: DataFrame, columns: Sequence[str], by: Sequence[str] = DATASET) -> DataFrame:
    """Per (dataset, variable): fill value, number of filled cells, mean after filling."""
    long = melt(df, list(by), columns)
    return long.join(F.broadcast(fills), [*by, "variable"], "left").groupBy(*by, "variable").agg(
        F.first("fill_value").alias("fill_value"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_filled"),
        F.avg(F.coalesce("value", "fill_value")).alias("mean_after"))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """try_cast to double; unparseable -> null."""
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])


def parse_rates(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Share of non-null values that parse as numbers; accepted when above ``threshold``."""
    long = melt(df, [], columns, dtype="string", drop_nulls=True)
    return long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("value").try_cast("double").isNotNull().cast("double")).alias("parse_rate"),
    ).withColumn("accepted", F.col("parse_rate") > threshold)


def recode_to_null(df: DataFrame, columns: Sequence[str], codes: Sequence = (7, 8, 9)) -> DataFrame:
    return df.select(*[F.when(F.col(c).isin(list(codes)), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in columns else F.col(c) for c in df.columns])


def recode_binary(column: str | Column, value=1) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (c == value).cast("int")


def zscore(df: DataFrame, columns: Sequence[str], by: Sequence[str] = DATASET, ddof: int = 1,
           suffix: str = "_z") -> DataFrame:
    """(x - mean) / sd within each dataset; ddof 1 (pandas) or 0 (numpy/StandardScaler)."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                                *[sd(c).alias(f"_s_{c}") for c in columns])
    j = df.join(F.broadcast(stats), list(by))
    return j.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"{c}{suffix}")
                                   for c in columns])


def scaler_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """StandardScaler parameters (ddof 0) in long form: (variable, mean, scale)."""
    long = melt(df, [], columns, drop_nulls=True)
    return long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))


def scaler_apply(df: DataFrame, params: DataFrame | dict, columns: Sequence[str], *, inverse: bool = False,
                 decimals: int | None = None) -> DataFrame:
    """Transform with fitted (variable, mean, scale); ``inverse`` maps scaled values back.

    The parameters (two numbers per variable) become literals of one projection."""
    if isinstance(params, DataFrame):
        params = {r["variable"]: (r["mean"], r["scale"]) for r in params.collect()}
    out = []
    for c in df.columns:
        if c in columns:
            m, s = (F.lit(float(v)) for v in params[c])
            v = F.col(c) * s + m if inverse else (F.col(c) - m) / s
            out.append((F.bround(v, decimals) if decimals is not None else v).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def drop_prefixed(df: DataFrame, prefixes: Sequence[str] = ("lv_", "latent_")) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower().startswith(tuple(prefixes))])


def drop_identifiers(df: DataFrame, ids: Sequence[str] = (), suffixes: Sequence[str] = ("_comp",)) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in ids or c.endswith(tuple(suffixes))])


def canonical_name(c: Column) -> Column:
    """lower -> every non [a-z0-9] char to '_' -> squeeze -> strip '_' -> 'col' if empty."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_|_$", "")
    return F.when(s == "", F.lit("col")).otherwise(s)


def first_label_per_code(df: DataFrame, code: str, label: str, order: str) -> DataFrame:
    """Mapping table (code, full_name, canonical_name): first label of each code by ``order``."""
    g = df.groupBy(code).agg(F.min_by(label, order).alias("full_name"))
    return g.select(F.col(code).alias("code"), "full_name", canonical_name(F.col("full_name")).alias("canonical_name"))


def unique_short_names(df: DataFrame, label: str, order: str) -> DataFrame:
    """Text before ':' with separators replaced; the 2nd, 3rd... use of a base get ``_2``, ``_3``.

    The occurrence number is the dense position of ``order`` within the base, from the
    distributed CDF (no single-task window for a frequent base)."""
    base = F.regexp_replace(F.trim(F.substring_index(F.col(label), ":", 1)), r"[\s/\-\.]+", "_")
    b = df.select(F.col(order), base.alias("base"))
    cnt = b.groupBy("base", order).agg(F.count(F.lit(1)).alias("w"))
    ranks = cumulative_counts(cnt, ["base"], order, ["w"])
    return ranks.select(F.col(order), "base", F.when(F.col("pos") == 1, F.col("base"))
                        .otherwise(F.concat(F.col("base"), F.lit("_"), F.col("pos").cast("string"))).alias("short_name"))


# fixed values: prefix rules of the variable-type heuristic, in order
TYPE_RULES = [
    ("startswith", "PV", "Continuous (Plausible Value)"),
    ("startswith", "ST", "Ordinal / Likert"),
    ("startswith", "SC", "Ordinal / Likert"),
    ("contains", "ESCS", "Continuous (Index)"),
    ("contains", "MISCED", "Ordinal (Education level)"),
    ("contains", "ST004D01T", "Binary (Gender: 1=Female, 2=Male)"),
    ("contains", "SCHSIZE", "Continuous (School size)"),
]
TYPE_DEFAULT = "Other / Mixed"


def infer_variable_type(c: Column) -> Column:
    out = None
    for kind, pat, label in TYPE_RULES:
        cond = c.startswith(pat) if kind == "startswith" else c.contains(pat)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(TYPE_DEFAULT))


def row_mean(columns: Sequence[str]) -> Column:
    """NaN-skipping mean across columns (null when all are null)."""
    total = None
    count = None
    for c in columns:
        v = F.coalesce(F.col(c), F.lit(0.0))
        k = F.col(c).isNotNull().cast("int")
        total = v if total is None else total + v
        count = k if count is None else count + k
    return F.when(count > 0, total / count)


def row_to_text(columns: Sequence[str], sep: str = " | ") -> Column:
    """``c1=v1 | c2=v2``; a null value becomes an empty string."""
    return F.concat_ws(sep, *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def univariate_outlier_flags(df: DataFrame, columns: Sequence[str], by: Sequence[str] = DATASET,
                             z: float = 3.0) -> DataFrame:
    """Adds ``_outlier`` = any |z| > 3 (ddof 0) within the dataset."""
    zs = zscore(df, columns, by, ddof=0)
    cond = F.lit(False)
    for c in columns:
        cond = cond | (F.abs(F.col(f"{c}_z")) > z)
    return zs.withColumn("_outlier", F.coalesce(cond, F.lit(False))).drop(*[f"{c}_z" for c in columns])
