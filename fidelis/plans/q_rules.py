"""Registered queries: rule-based correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import rules as R
from fidelis.plans.registry import rd, register
from fidelis.sources.panel import load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]

# fixed values: the panel's rule set (our codebook for the derived indicators)
RULES = [
    R.Rule("o1", "likert", 1, 5),
    R.Rule("l_linenumber", "category", valid=(1, 2, 3, 4, 5, 6)),
    R.Rule("sens", "ordinal", -3, 2),
    *[R.Rule(v, "continuous") for v in V],
]
RULES_V2 = [
    R.Rule("o1", "ordinal", 0, 6),
    R.Rule("l_linenumber", "category", valid=(1, 2, 3, 4, 5, 6, 7)),
    *[R.Rule(v, "continuous") for v in V],
]
CODEBOOK = {v: (-3.5, 3.5) for v in V}
DATA_COLS = [*V, "l_returnflag", "l_linestatus", "l_linenumber", "o1", "sens"]


def _px(spark, d):
    return load_panel(spark, d, extended=True, with_row_id=True)


def _fail_sql(r: R.Rule, null_fails: bool) -> str:
    v = f"CAST({r.column} AS DOUBLE)"
    if r.kind in ("likert", "category", "ordinal"):
        v = f"round_even({v}, 0)"
    if r.kind == "category":
        return f"NOT coalesce({v} IN ({', '.join(repr(float(x)) for x in r.valid)}), FALSE)"
    lo, hi = (f"b.lo_{r.column}", f"b.hi_{r.column}") if r.kind == "continuous" else (repr(float(r.lo)), repr(float(r.hi)))
    return f"coalesce({v} < {lo} OR {v} > {hi}, {'TRUE' if null_fails else 'FALSE'})"


def _bounds_ctes():
    cb = " UNION ALL ".join(f"SELECT '{k}' AS variable, {a!r} AS cb_min, {b!r} AS cb_max" for k, (a, b) in CODEBOOK.items())
    stats = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, min({v}) AS real_min, max({v}) AS real_max, stddev_samp({v}) AS real_std "
        f"FROM panel WHERE technique = 'REAL'" for v in CODEBOOK)
    wide = ", ".join(f"max(CASE WHEN variable = '{v}' THEN lo END) AS lo_{v}, max(CASE WHEN variable = '{v}' THEN hi END) AS hi_{v}"
                     for v in CODEBOOK)
    return [("cb", cb), ("rs", stats),
            ("bnd", "SELECT rs.variable, greatest(cb_min, real_min - real_std) AS lo, least(cb_max, real_max + real_std) AS hi, "
                    "real_min, real_max, real_std, cb_min, cb_max FROM rs JOIN cb USING (variable)"),
            ("bw", f"SELECT {wide} FROM bnd")]


def _counts_ctes(rules, null_fails, drop_na):
    checks = []
    if drop_na:
        checks.append("CASE WHEN " + " OR ".join(f"{c} IS NULL" for c in DATA_COLS) + " THEN 0 END")
    for i, r in enumerate(rules, start=1):
        checks.append(f"CASE WHEN {_fail_sql(r, null_fails)} THEN {i} END")
    names = (["dropna"] if drop_na else []) + [r.column for r in rules]
    actions = (["drop_rows_missing"] if drop_na else []) + [r.action for r in rules]
    start = 0 if drop_na else 1
    idx = list(range(start, start + len(names)))
    flag = f"SELECT technique, replicate, row_id, coalesce({', '.join(checks)}) AS failed_rule FROM panel p, bw b " \
           "WHERE technique <> 'REAL'"
    agg = "SELECT technique, replicate, count(*) AS n, " + ", ".join(
        f"count(CASE WHEN failed_rule = {i} THEN 1 END) AS d{i}" for i in idx) + " FROM fl GROUP BY technique, replicate"
    steps = []
    for pos, (i, n, a) in enumerate(zip(idx, names, actions)):
        before = "n" + "".join(f" - d{j}" for j in idx[:pos])
        steps.append(f"SELECT technique, replicate, {i} AS step, '{n}' AS variable, '{a}' AS action, "
                     f"{before} AS n_before, d{i} AS n_dropped FROM g")
    return [*_bounds_ctes(), ("fl", flag), ("g", agg), ("cnt", " UNION ALL ".join(steps))]


_COUNT_SEL = ("SELECT technique, replicate, step, variable, action, n_before, n_dropped, "
              + rd("CASE WHEN n_before > 0 THEN 100.0 * n_dropped / n_before END", "pct_dropped") + " FROM cnt")


def _counts(spark, d, rules=RULES, null_fails=False, drop_na=True):
    px = _px(spark, d).drop("row_id")
    real = px.filter(F.col("technique") == "REAL")
    bounds = {r["variable"]: (r["lo"], r["hi"]) for r in R.continuous_bounds(real, CODEBOOK).collect()}
    flagged = R.flag_rules(px.filter(F.col("technique") != "REAL"), rules, bounds, null_fails, drop_na)
    c = R.rule_counts(flagged, rules)
    if not drop_na:
        c = c.filter(F.col("step") > 0)
    return c


register("fix_rules", with_panel(_COUNT_SEL, _counts_ctes(RULES, False, True), extended=True, with_row_id=True))(
    lambda spark, d: _counts(spark, d))

register("fix_rules_v2", with_panel(_COUNT_SEL, _counts_ctes(RULES_V2, True, False), extended=True, with_row_id=True))(
    lambda spark, d: _counts_v2(spark, d))


def _counts_v2(spark, d):
    px = _px(spark, d).drop("row_id")
    real = px.filter(F.col("technique") == "REAL")
    bounds = {r["variable"]: (r["lo"], r["hi"]) for r in R.continuous_bounds(real, CODEBOOK).collect()}
    flagged = R.flag_rules(px.filter(F.col("technique") != "REAL"), RULES_V2, bounds, True, drop_na=False)
    # without the dropna step, rule i keeps its index: shift to the same numbering as the SQL twin
    c = R.rule_counts(flagged.withColumn("failed_rule", F.col("failed_rule") - 1), RULES_V2)
    c = c.filter(F.col("step") < len(RULES_V2)).withColumn("step", F.col("step") + 1)
    names = F.array(*[F.lit(r.column) for r in RULES_V2])
    acts = F.array(*[F.lit(r.action) for r in RULES_V2])
    return c.withColumn("variable", names[F.col("step") - 1]).withColumn("action", acts[F.col("step") - 1]) \
        .select("technique", "replicate", "step", "variable", "action", "n_before", "n_dropped", "pct_dropped")


register("fix_bounds", with_panel(
    "SELECT variable, " + ", ".join(rd(c) for c in ["lo", "hi", "real_min", "real_max", "real_std", "cb_min", "cb_max"])
    + " FROM bnd", _bounds_ctes(), extended=True))(
    lambda spark, d: R.continuous_bounds(load_panel(spark, d, extended=True).filter("technique = 'REAL'"), CODEBOOK))

register("fix_log", with_panel(
    "SELECT technique, replicate, variable, action, " + rd("100.0 * n_dropped / n_before", "percent_rows_affected")
    + " FROM cnt WHERE n_dropped > 0", _counts_ctes(RULES, False, True), extended=True, with_row_id=True))(
    lambda spark, d: R.correction_log(_counts(spark, d)))


def _corrected(spark, d):
    return R.correct(_px(spark, d), RULES, CODEBOOK)


_CAP_CTES = _counts_ctes(RULES, False, True) + [
    ("nreal", "SELECT count(*) AS n_real FROM panel WHERE technique = 'REAL'"),
    ("kept", "SELECT technique, replicate, row_id FROM (SELECT technique, replicate, row_id, row_number() OVER "
             "(PARTITION BY technique, replicate ORDER BY row_id) AS k FROM fl WHERE failed_rule IS NULL), nreal "
             "WHERE k <= n_real"),
    ("before", "SELECT technique, replicate, count(*) AS rows_before FROM panel WHERE technique <> 'REAL' GROUP BY ALL"),
    ("after", "SELECT technique, replicate, count(*) AS rows_after FROM kept GROUP BY ALL"),
    ("per_run", "SELECT technique, replicate, rows_before, coalesce(rows_after, 0) AS rows_after, "
                "rows_before - coalesce(rows_after, 0) AS rows_dropped, "
                "100.0 * (rows_before - coalesce(rows_after, 0)) / rows_before AS pct_dropped "
                "FROM before LEFT JOIN after USING (technique, replicate)"),
]
register("fix_cap_rows", with_panel(
    "SELECT technique, replicate, count(*) AS n_kept, CAST(sum(row_id) AS BIGINT) AS sum_row_id FROM kept GROUP BY ALL",
    _CAP_CTES, extended=True, with_row_id=True))(
    lambda spark, d: _corrected(spark, d)[0].groupBy(*DS).agg(F.count(F.lit(1)).alias("n_kept"),
                                                             F.sum("row_id").alias("sum_row_id")))

register("fix_drop_summary", with_panel(
    "SELECT technique, count(*) AS runs, " + ", ".join(rd(f"avg({c})", f"mean_{c}") for c in
                                                       ["rows_before", "rows_after", "rows_dropped", "pct_dropped"])
    + " FROM per_run GROUP BY technique", _CAP_CTES, extended=True, with_row_id=True))(
    lambda spark, d: R.drop_summary(_corrected(spark, d)[2]))
