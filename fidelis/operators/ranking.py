"""Ranking of techniques.

Input: one row per technique with the component inputs.  A part is the mean of the inputs
that the table has; a part without any input is left out, the weights of the others are
scaled to sum 1 again, and ``parts_used`` says which parts made the score.  Min-max windows
run over the technique table (one row per technique: bounded by the number of techniques).
``compat=True`` keeps the reference behaviour (structural composite divided by 4);
``compat=False`` divides by the number of its parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: overall weights of the component scores
OVERALL_WEIGHTS = {
    "distribution_score": 0.13, "path_score": 0.14, "latentcorr_score": 0.08, "covariate_score": 0.08,
    "loading_score": 0.12, "reliability_score": 0.10, "htmt_score": 0.12, "fit_score": 0.09, "privacy_score": 0.14,
}
# fixed values: weights of the first version, which sums the parts as they are
V1_WEIGHTS = {
    "distribution_score": 0.13, "path_score": 0.13, "latentcorr_score": 0.08, "covariate_score": 0.08,
    "loading_score": 0.12, "reliability_score": 0.10, "htmt_score": 0.12, "fit_score": 0.09, "privacy_score": 0.15,
}
# parts used on their raw scale in the overall sum; the others are min-max normalised first
RAW_PARTS = {"distribution_score", "path_score", "fit_score", "privacy_score"}

# inputs of each part: (column, sign of what is good, offset)
NORMED = {
    "distribution_score": [("e_mu", -1, 0), ("e_sig", -1, 0), ("cont_adherence", 1, -1), ("cat_adherence", 1, -1)],
    "path_score": [("direction", 1, 0), ("rank_rho", 1, 0)],
    "fit_score": [("cfi", 1, 0), ("tli", 1, 0), ("rmsea", -1, 0), ("srmr", -1, 0)],
    "privacy_score": [("exact_match_rate", -1, 0), ("membership_inference", -1, 0), ("nn_distance_mean", 1, 0), ("dcr_p05", 1, 0)],
}
NEGATED = {"latentcorr_score": "latent_err", "covariate_score": "covariate_err", "loading_score": "loading_err",
           "reliability_score": "reliability_err", "htmt_score": "htmt_rmse"}
SECTIONS = {
    "structural_composite": ["path_score", "latentcorr_score", "covariate_score"],
    "validity_composite": ["htmt_score", "fit_score"],
}
INPUTS = [*[c for part in ("distribution_score", "path_score") for c, _, _ in NORMED[part]], *NEGATED.values(),
          *[c for part in ("fit_score", "privacy_score") for c, _, _ in NORMED[part]]]


def mm(c: Column) -> Column:
    """Min-max over all techniques; a constant column maps to 0."""
    everything = Window.partitionBy()
    lo, hi = F.min(c).over(everything), F.max(c).over(everything)
    return F.when(hi == lo, F.lit(0.0)).otherwise((c - lo) / (hi - lo))


def _sum(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def component_scores(t: DataFrame) -> DataFrame:
    """One column per part that has an input, and distribution_error_raw."""
    out = [F.col("technique")]
    for part, inputs in NORMED.items():
        have = [sign * (F.col(c) + offset) for c, sign, offset in inputs if c in t.columns]
        if have:
            out.append((_sum([mm(c) for c in have]) / len(have)).alias(part))
            if part == "distribution_score":
                out.append((-_sum(have)).alias("distribution_error_raw"))
    out += [(-F.col(c)).alias(part) for part, c in NEGATED.items() if c in t.columns]
    return t.select(*out)


def section_composites(s: DataFrame, compat: bool = True) -> DataFrame:
    out = {}
    if "distribution_score" in s.columns:
        out["distribution_composite"] = mm(F.col("distribution_score"))
    for name, parts in SECTIONS.items():
        have = [mm(F.col(p)) for p in parts if p in s.columns]
        if have:
            divisor = len(have) + 1 if compat and name == "structural_composite" and len(have) == len(parts) else len(have)
            out[name] = _sum(have) / divisor
    errors = [mm(F.abs(F.col(p))) for p in ("loading_score", "reliability_score") if p in s.columns]
    if errors:
        out["measurement_composite"] = 1 - _sum(errors) / len(errors)
    if "privacy_score" in s.columns:
        out["privacy_composite"] = mm(F.col("privacy_score"))
    return s.select("*", *[c.alias(k) for k, c in out.items()])


def component_ranks(s: DataFrame, parts: Sequence[str] = tuple(OVERALL_WEIGHTS)) -> DataFrame:
    """Adds ``<part>_rank`` (ties share the lowest rank) for every part that ``s`` has."""
    for p in parts:
        if p in s.columns:
            s = s.withColumn(p.replace("_score", "_rank"), F.rank().over(Window.orderBy(F.col(p).desc())))
    return s


def rank_overall(inputs: DataFrame, compat: bool = True, weights: dict[str, float] | None = None, normalise: bool = True) -> DataFrame:
    """Component scores, section composites, weighted overall score, per-part ranks (min ties)."""
    weights = weights or OVERALL_WEIGHTS
    s = section_composites(component_scores(inputs), compat)
    used = {k: w for k, w in weights.items() if k in s.columns}
    scale = sum(weights.values()) / sum(used.values())
    terms = [F.lit(w * scale) * (F.col(k) if k in RAW_PARTS or not normalise else mm(F.col(k))) for k, w in used.items()]
    s = s.withColumn("overall_score", _sum(terms)).withColumn("composite_score", mm(F.col("overall_score")))
    s = component_ranks(s, tuple(used)).withColumn("parts_used", F.lit(",".join(k.removesuffix("_score") for k in used)))
    # overall rank: row order of the overall score (no shared ranks)
    return s.withColumn("overall_rank", F.row_number().over(Window.orderBy(F.col("overall_score").desc(), "technique")))


def rank_overall_v1(inputs: DataFrame) -> DataFrame:
    """First version: own weights, parts summed as they are."""
    return rank_overall(inputs, weights=V1_WEIGHTS, normalise=False)


def detailed_breakdown(inputs: DataFrame, best_high: Sequence[str] = ("cont_adherence", "cat_adherence", "direction", "rank_rho", "cfi", "tli",
                                                                       "nn_distance_mean", "dcr_p05")) -> DataFrame:
    """Metric x technique in long form, the best value of each metric marked."""
    have = [c for c in INPUTS if c in inputs.columns]
    long = inputs.select("technique", *[F.col(c).cast("double") for c in have]).unpivot(["technique"], have, "metric", "value")
    good = F.when(F.col("metric").isin(list(best_high)), F.col("value")).otherwise(-F.col("value"))
    return long.withColumn("best", F.coalesce(good == F.max(good).over(Window.partitionBy("metric")), F.lit(False)))
