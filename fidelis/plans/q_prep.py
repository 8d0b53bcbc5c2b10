"""Registered queries: scans and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import prep as P
from fidelis.operators.reshape import melt, tech_to_col
from fidelis.plans.registry import rd, register
from fidelis.plans.sqlgen import melt_sql
from fidelis.sources import files as S
from fidelis.sources.panel import MEASUREMENT, load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ scan_panel (row ids)
_PX_COLS = ["technique", "replicate", "row_id", *V, "l_returnflag", "l_linestatus", "l_linenumber", "o1", "sens"]
register("scan_panel", with_panel(
    "SELECT technique, replicate, row_id, " + ", ".join(rd(v) for v in V)
    + ", l_returnflag, l_linestatus, l_linenumber, o1, sens FROM panel", extended=True, with_row_id=True))(
    lambda spark, d: load_panel(spark, d, extended=True, with_row_id=True).select(*_PX_COLS))

# ------------------------------------------------------------------ scan_select_columns
register("scan_select_columns",
         "SELECT l_orderkey, l_linenumber, " + rd("l_quantity") + ", " + rd("l_discount")
         + " FROM lineitem WHERE l_returnflag = 'R'")(
    lambda spark, d: S.select_columns(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"],
                                      F.col("l_returnflag") == "R"))

# ------------------------------------------------------------------ split_wide_table
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_GROUPS = {"measures": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
           "flags": ["l_returnflag", "l_linestatus"], "dates": ["l_shipdate"]}
register("split_wide_table",
         "SELECT 'measures' AS part, count(*) AS n_rows, " + rd("sum(l_quantity)", "sum_first")
         + " FROM lineitem UNION ALL SELECT 'flags', count(*), CAST(NULL AS DOUBLE) FROM lineitem"
         " UNION ALL SELECT 'dates', count(*), CAST(NULL AS DOUBLE) FROM lineitem"
         " UNION ALL SELECT 'keys', count(*), CAST(NULL AS DOUBLE) FROM lineitem")(
    lambda spark, d: S.split_summary(S.split_wide_table(_t(spark, d, "lineitem"), _KEYS, _GROUPS)))

# ------------------------------------------------------------------ pool_replicates
register("pool_replicates", with_panel(
    "SELECT technique, count(*) AS n_rows, count(DISTINCT replicate) AS n_replicates, "
    + ", ".join(rd(f"avg({v})", f"mean_{v}") for v in V) + " FROM panel GROUP BY technique"))(
    lambda spark, d: S.pool_replicates(load_panel(spark, d), V))

# ------------------------------------------------------------------ column_audit
_REQ = V + ["o1"]
register("column_audit", with_panel(
    "SELECT technique, replicate, count(*) AS n_rows, "
    + " + ".join(f"CAST(count({c}) > 0 AS INTEGER)" for c in _REQ) + " AS n_present, "
    + "concat_ws(',', " + ", ".join(f"CASE WHEN count({c}) = 0 THEN '{c}' END" for c in _REQ) + ") AS missing_required"
    + " FROM panel GROUP BY technique, replicate", extended=True))(
    lambda spark, d: S.column_audit(load_panel(spark, d, extended=True), DS, _REQ))

# ------------------------------------------------------------------ distinct_first_column
register("distinct_first_column",
         "SELECT DISTINCT trim(v) AS value FROM (SELECT c_mktsegment AS v FROM customer UNION ALL "
         "SELECT o_orderpriority FROM orders UNION ALL SELECT p_type FROM part) WHERE trim(v) <> ''")(
    lambda spark, d: S.distinct_union_sorted([
        _t(spark, d, "customer").select("c_mktsegment"), _t(spark, d, "orders").select("o_orderpriority"),
        _t(spark, d, "part").select("p_type")]))

# ------------------------------------------------------------------ table_metadata
_META = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}


def _meta_sql():
    parts = []
    for t, cols in _META.items():
        for c in cols:
            typ = P.TYPE_DEFAULT
            for kind, pat, label in P.TYPE_RULES:
                hit = c.startswith(pat) if kind == "startswith" else pat in c
                if hit:
                    typ = label
                    break
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
                         f"count(*) - count({c}) AS n_null, '{typ}' AS inferred_type FROM {t}")
    return "\nUNION ALL\n".join(parts)


register("table_metadata", _meta_sql())(
    lambda spark, d: S.table_metadata({t: _t(spark, d, t).select(*cols) for t, cols in _META.items()}))

# ------------------------------------------------------------------ filter_country / two-level joins
register("filter_country",
         "SELECT n_name, count(*) AS n_customers, " + rd("avg(c_acctbal)", "mean_acctbal")
         + " FROM customer JOIN nation ON c_nationkey = n_nationkey "
         "WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_11') GROUP BY n_name")(
    lambda spark, d: P.filter_values(
        _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")),
        "n_name", ["NATION_3", "NATION_7", "NATION_11"]).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n_customers"), F.avg("c_acctbal").alias("mean_acctbal")))

# ------------------------------------------------------------------ complete_cases
_GROUPS_CC = dict(MEASUREMENT)


def _cc_sql():
    names = list(_GROUPS_CC)
    comp = {g: "(" + " AND ".join(f"{c} IS NOT NULL" for c in _GROUPS_CC[g]) + ")" for g in names}
    aggs, prefix = ["count(*) AS n0"], "TRUE"
    for i, g in enumerate(names):
        aggs.append(f"count(CASE WHEN {prefix} AND NOT {comp[g]} THEN 1 END) AS r{i}")
        prefix = f"{prefix} AND {comp[g]}"
    sel = []
    for i, g in enumerate(names):
        before = "n0" + "".join(f" - r{j}" for j in range(i))
        sel.append(f"SELECT technique, {i + 1} AS step, '{g}' AS item_group, {before} AS n_before, r{i} AS n_removed, "
                   f"{before} - r{i} AS n_after FROM w")
    return with_panel("\nUNION ALL\n".join(sel),
                      [("w", f"SELECT technique, {', '.join(aggs)} FROM panel GROUP BY technique")], extended=True)


register("complete_cases", _cc_sql())(
    lambda spark, d: P.complete_case_steps(load_panel(spark, d, extended=True), _GROUPS_CC, ["technique"]))


# ------------------------------------------------------------------ impute_mode / impute_median
def _with_o2(df):
    return df.withColumn("o2", F.floor(F.col("a2") + 3).cast("int"))


def _impute_report_sql(fill_cte, column):
    return with_panel(
        "SELECT l.technique, l.replicate, l.variable, " + rd("f.fill_value", "fill_value")
        + ", count(CASE WHEN l.value IS NULL THEN 1 END) AS n_filled, "
        + rd("avg(coalesce(l.value, f.fill_value))", "mean_after")
        + " FROM long l LEFT JOIN fills f ON l.technique = f.technique AND l.replicate = f.replicate "
          "AND l.variable = f.variable GROUP BY l.technique, l.replicate, l.variable, f.fill_value",
        [("p2", "SELECT *, CAST(floor(a2 + 3) AS INTEGER) AS o2 FROM panel"),
         ("long", melt_sql("p2", DS, [column], drop_nulls=False)),
         ("fills", fill_cte)], extended=True)


_MODE_FILL = ("SELECT technique, replicate, variable, value AS fill_value FROM (SELECT technique, replicate, variable, "
              "value, row_number() OVER (PARTITION BY technique, replicate, variable ORDER BY count(*) DESC, value) AS rk "
              "FROM long WHERE value IS NOT NULL GROUP BY technique, replicate, variable, value) WHERE rk = 1")
_MEDIAN_FILL = ("SELECT technique, replicate, variable, quantile_cont(value, 0.5) AS fill_value FROM long "
                "WHERE value IS NOT NULL GROUP BY technique, replicate, variable")


def _impute_mode(spark, d):
    df = _with_o2(load_panel(spark, d, extended=True))
    return P.imputation_report(df, P.mode_values(df, ["o2"]), ["o2"])


def _impute_median(spark, d):
    df = load_panel(spark, d, extended=True)
    return P.imputation_report(df, P.median_values(df, ["a2"]), ["a2"])


register("impute_mode", _impute_report_sql(_MODE_FILL, "o2"))(_impute_mode)
register("impute_median", _impute_report_sql(_MEDIAN_FILL, "a2"))(_impute_median)

# ------------------------------------------------------------------ coerce_numeric
_COERCE = ["l_returnflag", "l_linestatus", "l_quantity_txt", "l_linenumber_txt"]
register("coerce_numeric",
         "SELECT variable, count(*) AS n, " + rd("avg(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END)", "parse_rate")
         + ", avg(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.95 AS accepted FROM ("
         + melt_sql("(SELECT l_returnflag, l_linestatus, CAST(l_quantity AS VARCHAR) AS l_quantity_txt, "
                    "CAST(l_linenumber AS VARCHAR) AS l_linenumber_txt FROM lineitem) s", [], _COERCE, dtype="VARCHAR")
          + ") GROUP BY variable")(
    lambda spark, d: P.parse_rates(_t(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").cast("string").alias("l_quantity_txt"),
        F.col("l_linenumber").cast("string").alias("l_linenumber_txt")), _COERCE))

# ------------------------------------------------------------------ recode_codes_to_null / recode_binary
register("recode_codes_to_null", with_panel(
    "SELECT technique, variable, count(*) AS n_rows, count(*) - count(value) AS n_null FROM ("
    + melt_sql("(SELECT technique, CASE WHEN o1 IN (7, 8, 9) THEN NULL ELSE o1 END AS o1, "
               "CASE WHEN l_linenumber IN (7, 8, 9) THEN NULL ELSE l_linenumber END AS l_linenumber FROM panel) s",
               ["technique"], ["o1", "l_linenumber"], drop_nulls=False)
    + ") GROUP BY technique, variable", extended=True))(
    lambda spark, d: _recode_counts(load_panel(spark, d, extended=True)))


def _recode_counts(df):
    r = P.recode_to_null(df.select("technique", "o1", "l_linenumber"), ["o1", "l_linenumber"])
    long = melt(r, ["technique"], ["o1", "l_linenumber"])
    return long.groupBy("technique", "variable").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count("value")).alias("n_null"))


register("recode_binary", with_panel(
    "SELECT technique, count(*) AS n_rows, sum(CAST(l_linenumber = 1 AS INTEGER)) AS n_flag, "
    + rd("avg(CAST(l_linenumber = 1 AS INTEGER))", "share_flag") + " FROM panel GROUP BY technique", extended=True))(
    lambda spark, d: load_panel(spark, d, extended=True).withColumn("flag", P.recode_binary("l_linenumber", 1))
    .groupBy("technique").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("flag").alias("n_flag"),
                              F.avg("flag").alias("share_flag")))

# ------------------------------------------------------------------ zscore_columns (ddof 1, per dataset)
_ZC = list(V)
register("zscore_columns", with_panel(
    "SELECT technique, replicate, row_id, " + ", ".join(
        rd(f"({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w", f"{c}_z") for c in _ZC)
    + " FROM panel WINDOW w AS (PARTITION BY technique, replicate)", with_row_id=True))(
    lambda spark, d: P.zscore(load_panel(spark, d, with_row_id=True).select(*DS, "row_id", *_ZC), _ZC)
    .select(*DS, "row_id", *[f"{c}_z" for c in _ZC]))


# ------------------------------------------------------------------ standard_scale / inverse_scale
def _scaled(spark, d):
    df = load_panel(spark, d, with_row_id=True).select(*DS, "row_id", *_ZC)
    params = P.scaler_fit(df.filter(F.col("technique") == "REAL"), _ZC)
    return df, params, P.scaler_apply(df, params, _ZC, decimals=3)


_SCALE_CTE = [("prm", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _ZC)
               + " FROM panel WHERE technique = 'REAL'"),
              ("sc", "SELECT technique, replicate, row_id, " + ", ".join(
                  f"round_even(({c} - m_{c}) / s_{c}, 3) AS {c}" for c in _ZC) + " FROM panel, prm")]
register("standard_scale", with_panel(
    "SELECT technique, replicate, row_id, " + ", ".join(rd(c) for c in _ZC) + " FROM sc",
    _SCALE_CTE, with_row_id=True))(lambda spark, d: _scaled(spark, d)[2])
register("inverse_scale", with_panel(
    "SELECT technique, replicate, row_id, " + ", ".join(rd(f"{c} * s_{c} + m_{c}", c) for c in _ZC) + " FROM sc, prm",
    _SCALE_CTE, with_row_id=True))(
    lambda spark, d: (lambda t: P.scaler_apply(t[2], t[1], _ZC, inverse=True))(_scaled(spark, d)))

# ------------------------------------------------------------------ row_mean / row_to_text
_RM = {"fa_mean": ["a1", "a2", "a3"], "fb_mean": ["b1", "b2", "b3"], "fc_mean": ["c1", "c2", "c3"]}


def _rm_sql(cols):
    tot = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    cnt = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)
    return f"CASE WHEN {cnt} > 0 THEN ({tot}) / ({cnt}) END"


register("row_mean", with_panel(
    "SELECT technique, replicate, row_id, " + ", ".join(rd(_rm_sql(c), k) for k, c in _RM.items()) + " FROM panel",
    extended=True, with_row_id=True))(
    lambda spark, d: load_panel(spark, d, extended=True, with_row_id=True).select(
        *DS, "row_id", *[P.row_mean(c).alias(k) for k, c in _RM.items()]))

_TXT = ["l_returnflag", "l_linestatus", "l_linenumber", "o1"]
register("row_to_text", with_panel(
    "SELECT technique, replicate, row_id, concat_ws(' | ', " + ", ".join(
        f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '')" for c in _TXT) + ") AS text FROM panel",
    extended=True, with_row_id=True))(
    lambda spark, d: load_panel(spark, d, extended=True, with_row_id=True).select(
        *DS, "row_id", P.row_to_text(_TXT).alias("text")))

# ------------------------------------------------------------------ univariate_outliers
register("univariate_outliers", with_panel(
    "SELECT technique, replicate, count(*) AS n_before, count(*) - count(CASE WHEN outl THEN 1 END) AS n_after FROM ("
    "SELECT technique, replicate, coalesce(" + " OR ".join(
        f"abs(({v} - avg({v}) OVER w) / stddev_pop({v}) OVER w) > 3" for v in V)
    + ", FALSE) AS outl FROM panel WINDOW w AS (PARTITION BY technique, replicate)) GROUP BY technique, replicate"))(
    lambda spark, d: P.univariate_outlier_flags(load_panel(spark, d), V).groupBy(*DS).agg(
        F.count(F.lit(1)).alias("n_before"), F.count(F.when(~F.col("_outlier"), 1)).alias("n_after")))

# ------------------------------------------------------------------ canonical_names / unique_short_names
_LABEL = "concat(p_type, ' / ', p_name, ' #', CAST(p_size AS VARCHAR))"


def _canon_sql(x):
    s = f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g')"
    s = f"regexp_replace({s}, '^_|_$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN 'col' ELSE {s} END"


register("canonical_names",
         f"SELECT p_brand AS code, full_name, {_canon_sql('full_name')} AS canonical_name FROM ("
         f"SELECT p_brand, arg_min({_LABEL}, p_partkey) AS full_name FROM part GROUP BY p_brand)")(
    lambda spark, d: P.first_label_per_code(
        _t(spark, d, "part").select("p_brand", "p_partkey", F.concat(
            F.col("p_type"), F.lit(" / "), F.col("p_name"), F.lit(" #"), F.col("p_size").cast("string")).alias("label")),
        "p_brand", "label", "p_partkey"))

_BASE = r"regexp_replace(trim(split_part(p_name, ':', 1)), '[\s/\-\.]+', '_', 'g')"
register("unique_short_names",
         f"SELECT p_partkey, base, CASE WHEN rk = 1 THEN base ELSE base || '_' || CAST(rk AS VARCHAR) END AS short_name "
         f"FROM (SELECT p_partkey, {_BASE} AS base, row_number() OVER (PARTITION BY {_BASE} ORDER BY p_partkey) AS rk FROM part)")(
    lambda spark, d: P.unique_short_names(_t(spark, d, "part"), "p_name", "p_partkey"))

# ------------------------------------------------------------------ tech_to_col
register("tech_to_col", with_panel(
    "SELECT DISTINCT label, regexp_replace(regexp_replace(label, '\\s*\\(', '_', 'g'), '\\)', '', 'g') AS col_name FROM ("
    "SELECT technique || ' (rep' || CAST(replicate AS VARCHAR) || ')' AS label FROM panel)"))(
    lambda spark, d: load_panel(spark, d).select(F.concat(F.col("technique"), F.lit(" (rep"), F.col("replicate").cast("string"),
                                                          F.lit(")")).alias("label")).distinct()
    .select("label", tech_to_col(F.col("label")).alias("col_name")))
