"""Rule-based correction of synthetic replicates.

Rules run in order and a row leaves at the first rule it breaks, so one column
``failed_rule`` (a ``coalesce`` of the rule tests) reproduces the sequential
drops in a single pass.  The share logged for rule k is its drops over the rows
still present before rule k; those denominators come from per-dataset counts
(rules x datasets rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators.order import cumulative_counts

DATASET = ["technique", "replicate"]


def number(column: str) -> Column:
    """The column as a number; text that is none and NaN (which Spark ranks above every number) are null."""
    v = F.col(column).try_cast("double")
    return F.when(~F.isnan(v), v)


# fixed values: the action names of the correction log
ACTIONS = {
    "likert": "drop_rows_invalid_likert",
    "proportion": "drop_rows_invalid_prop",
    "category": "drop_rows_invalid_category",
    "ordinal": "drop_rows_invalid_ordinal",
    "continuous": "drop_rows_invalid_continuous_codebook_real_1sd",
}


@dataclass(frozen=True)
class Rule:
    """One check: ``kind`` in {likert, proportion, category, ordinal, continuous}."""

    column: str
    kind: str
    lo: float | None = None
    hi: float | None = None
    valid: tuple = field(default_factory=tuple)

    @property
    def action(self) -> str:
        return ACTIONS[self.kind]

    def fails(self, bounds: dict[str, tuple[float, float]] | None = None, null_fails: bool = False) -> Column:
        v = number(self.column)
        if self.kind in ("likert", "category", "ordinal"):
            v = F.bround(v, 0)  # half-even, as pandas
        if self.kind == "category":
            bad = ~F.coalesce(v.isin([float(x) for x in self.valid]), F.lit(False))
            return bad
        lo, hi = (bounds[self.column] if self.kind == "continuous" else (self.lo, self.hi))
        bad = (v < F.lit(float(lo))) | (v > F.lit(float(hi)))
        if null_fails:
            return F.coalesce(bad, F.lit(True))
        return F.coalesce(bad, F.lit(False))  # missing: kept


def continuous_bounds(real: DataFrame, codebook: dict[str, tuple[float, float]]) -> DataFrame:
    """[max(codebook lo, min - sd), min(codebook hi, max + sd)] from REAL, sd with ddof 1."""
    from fidelis.operators.reshape import melt

    long = melt(real, [], list(codebook), drop_nulls=True)
    st = long.groupBy("variable").agg(F.min("value").alias("real_min"), F.max("value").alias("real_max"),
                                      F.stddev_samp("value").alias("real_std"))
    cb = real.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in codebook.items()],
                                           "variable string, cb_min double, cb_max double")
    return st.join(F.broadcast(cb), "variable").select(
        "variable", F.greatest(F.col("cb_min"), F.col("real_min") - F.col("real_std")).alias("lo"),
        F.least(F.col("cb_max"), F.col("real_max") + F.col("real_std")).alias("hi"),
        "real_min", "real_max", "real_std", "cb_min", "cb_max")


def flag_rules(df: DataFrame, rules: Sequence[Rule], bounds: dict[str, tuple[float, float]] | None = None,
               null_fails: bool = False, drop_na: bool = True) -> DataFrame:
    """Adds ``failed_rule`` (index of the first broken rule, 0 = dropna, null = kept)."""
    checks = []
    if drop_na:
        cols = [c for c in df.columns if c not in DATASET and c != "row_id" and not c.lower().startswith("lv_")]
        anynull = F.lit(False)
        for c in cols:
            anynull = anynull | F.col(c).isNull()
            if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
                anynull = anynull | F.isnan(c)
        checks.append(F.when(anynull, F.lit(0)))
    for i, r in enumerate(rules, start=1):
        checks.append(F.when(r.fails(bounds, null_fails), F.lit(i)))
    return df.withColumn("failed_rule", F.coalesce(*checks) if len(checks) > 1 else checks[0])


def rule_counts(flagged: DataFrame, rules: Sequence[Rule], by: Sequence[str] = DATASET) -> DataFrame:
    """Per dataset and rule: rows before the rule, rows dropped by it, share of remaining rows."""
    by = list(by)
    names = ["dropna"] + [r.column for r in rules]
    actions = ["drop_rows_missing"] + [r.action for r in rules]
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.when(F.col("failed_rule") == i, 1)).alias(f"_d{i}")
                                              for i in range(len(names))]
    g = flagged.groupBy(*by).agg(*aggs)
    rows = []
    for i, (n, a) in enumerate(zip(names, actions)):
        before = F.col("_n")
        for j in range(i):
            before = before - F.col(f"_d{j}")
        rows.append(F.struct(F.lit(i).alias("step"), F.lit(n).alias("variable"), F.lit(a).alias("action"),
                             before.alias("n_before"), F.col(f"_d{i}").alias("n_dropped")))
    out = g.select(*by, F.explode(F.array(*rows)).alias("s")).select(*by, "s.*")
    return out.withColumn("pct_dropped", F.when(F.col("n_before") > 0, 100.0 * F.col("n_dropped") / F.col("n_before")))


def correction_log(counts: DataFrame) -> DataFrame:
    """Only rules that dropped something, percent of the remaining rows (as logged)."""
    return counts.filter(F.col("n_dropped") > 0).select(
        "technique", "replicate", "variable", "action", F.col("pct_dropped").alias("percent_rows_affected"))


def cap_rows(kept: DataFrame, max_rows: int, by: Sequence[str] = DATASET, order: str = "row_id") -> DataFrame:
    """Keep at most ``max_rows`` rows per dataset in file order (distributed position, no
    single-task window over a large dataset)."""
    by = list(by)
    pos = cumulative_counts(kept.groupBy(*by, order).agg(F.count(F.lit(1)).alias("w")), by, order, ["w"])
    first = pos.filter(F.col("cum_w") <= max_rows).select(*by, order)
    return kept.join(first, [*by, order], "left_semi")


def drop_summary(per_run: DataFrame) -> DataFrame:
    """Per technique: runs, mean rows before / after / dropped, mean percent dropped."""
    return per_run.groupBy("technique").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("rows_before").alias("mean_rows_before"),
        F.avg("rows_after").alias("mean_rows_after"), F.avg("rows_dropped").alias("mean_rows_dropped"),
        F.avg("pct_dropped").alias("mean_pct_dropped"))


def correct(panel: DataFrame, rules: Sequence[Rule], codebook: dict[str, tuple[float, float]], real: str = "REAL",
            null_fails: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Correct every synthetic dataset: returns (corrected rows, per-rule counts, per-run summary)."""
    is_real = F.col("technique") == real
    bounds_df = continuous_bounds(panel.filter(is_real), codebook)
    bounds = {r["variable"]: (r["lo"], r["hi"]) for r in bounds_df.collect()}  # two numbers per variable
    n_real = panel.filter(is_real).count()
    syn = panel.filter(~is_real)
    flagged = flag_rules(syn, rules, bounds, null_fails)
    counts = rule_counts(flagged, rules)
    kept = cap_rows(flagged.filter(F.col("failed_rule").isNull()).drop("failed_rule"), n_real)
    before = syn.groupBy(*DATASET).agg(F.count(F.lit(1)).alias("rows_before"))
    after = kept.groupBy(*DATASET).agg(F.count(F.lit(1)).alias("rows_after"))
    per_run = before.join(after, DATASET, "left").fillna(0, ["rows_after"]).select(
        *DATASET, "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"),
        (100.0 * (F.col("rows_before") - F.col("rows_after")) / F.col("rows_before")).alias("pct_dropped"))
    return kept, counts, per_run
