"""Registered queries: two-level joins and small table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.operators import dependency as D
from fidelis.operators import joins as J
from fidelis.operators import marginal as M
from fidelis.operators import measurement as MS
from fidelis.operators import prep as P
from fidelis.operators.reshape import unpivot_long
from fidelis.plans import q_dependency as QD
from fidelis.plans.registry import rd, register
from fidelis.session import shared_path
from fidelis.sources import files as S
from fidelis.sources.panel import MEASUREMENT, STRUCTURE, TECHNIQUES, load_panel, with_panel
from fidelis.sources.panel import VARIABLES as V

DS = ["technique", "replicate"]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ scans
register("scan_table_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10")(
    lambda spark, d: J.scan_table_filter(_t(spark, d, "customer"), "c_mktsegment = 'BUILDING' AND c_nationkey < 10", ["c_custkey", "c_acctbal"]))

# ------------------------------------------------------------------ joins
register("join_inner_two_level",
         "SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderstatus, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")(
    lambda spark, d: J.join_two_level(
        _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
        _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), [("l_orderkey", "o_orderkey")]))

register("join_left_two_level",
         "SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")(
    lambda spark, d: J.join_two_level(
        _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        _t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment", "c_nationkey"), [("o_custkey", "c_custkey")], "left"))

_BLOCKS = {"A": ["p_brand"], "B": ["p_size", "p_retailprice"], "C": ["p_type"]}


def _parts(spark, d):
    return J.split_parent_child(_t(spark, d, "part"), "p_partkey", ["p_name"], _BLOCKS)


def _chain(spark, d):
    parts = _parts(spark, d)
    return J.join_left_chain(parts["parent"], [parts["A"], parts["B"].filter("p_size > 10"), parts["C"].filter("p_partkey % 3 > 0")], "p_partkey")


register("join_left_chain",
         "SELECT p_partkey, p.p_name, a.p_brand, b.p_size, b.p_retailprice, c.p_type FROM part p LEFT JOIN (SELECT p_partkey, p_brand FROM part) a USING (p_partkey) "
         "LEFT JOIN (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 10) b USING (p_partkey) "
         "LEFT JOIN (SELECT p_partkey, p_type FROM part WHERE p_partkey % 3 > 0) c USING (p_partkey)")(_chain)


def _split(spark, d):
    out = None
    for name, df in _parts(spark, d).items():
        row = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("p_partkey").alias("n_keys"),
                     F.lit(",".join(df.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


register("split_parent_child", " UNION ALL ".join(
    f"SELECT '{n}' AS part, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_keys, '{','.join(['p_partkey', *c])}' AS columns FROM part"
    for n, c in {"parent": ["p_name"], **_BLOCKS}.items()))(_split)

register("concat_columns", with_panel(
    "SELECT row_id, " + rd("x.a1", "a1") + ", " + rd("y.b1", "b1") + " FROM (SELECT row_id, a1 FROM panel WHERE replicate <= 1) x "
    "FULL OUTER JOIN (SELECT row_id, b1 FROM panel WHERE replicate >= 1) y USING (row_id)", with_row_id=True))(
    lambda spark, d: J.concat_columns(load_panel(spark, d, with_row_id=True).filter("replicate <= 1").select("row_id", "a1"),
                                      load_panel(spark, d, with_row_id=True).filter("replicate >= 1").select("row_id", "b1")))

register("semi_exact_match", with_panel(
    f"SELECT technique, replicate, count(*) AS n_rows FROM panel p WHERE technique <> 'REAL' AND EXISTS (SELECT 1 FROM panel r WHERE r.technique = 'REAL' AND "
    + " AND ".join(f"r.{v} = p.{v}" for v in V) + ") GROUP BY technique, replicate", extended=True))(
    lambda spark, d: J.semi_exact_match(load_panel(spark, d, extended=True), V).groupBy(*DS).agg(F.count(F.lit(1)).alias("n_rows")))

_MEANS = ("long", " UNION ALL ".join(f"SELECT technique, '{v}' AS variable, avg({v}) AS value FROM panel GROUP BY technique" for v in V))


def _means(spark, d):
    return M.continuous_summary(load_panel(spark, d), V).select("technique", "variable", F.col("mean").alias("value"))


register("join_compare_left", with_panel(
    "SELECT t.technique, r.variable, " + rd("r.value", "real") + ", " + rd("s.value", "synthetic") + " FROM (SELECT * FROM long WHERE technique = 'REAL') r "
    "JOIN (SELECT DISTINCT technique FROM long WHERE technique <> 'REAL') t ON TRUE "
    "LEFT JOIN (SELECT * FROM long WHERE NOT (technique = 'SYN_NOISY' AND variable = 'b2')) s ON s.technique = t.technique AND s.variable = r.variable", [_MEANS]))(
    lambda spark, d: J.join_compare_left(_means(spark, d).filter("NOT (technique = 'SYN_NOISY' AND variable = 'b2')"), ["variable"], "value"))

register("join_pairs_inner", with_panel(
    "SELECT s.technique, s.variable, " + rd("r.value", "value_real") + ", " + rd("s.value", "value_synthetic")
    + " FROM long s JOIN long r ON r.technique = 'REAL' AND r.variable = s.variable WHERE s.technique <> 'REAL'", [_MEANS]))(
    lambda spark, d: _means(spark, d).filter("technique <> 'REAL'").withColumnRenamed("value", "value_synthetic").join(
        _means(spark, d).filter("technique = 'REAL'").select("variable", F.col("value").alias("value_real")), "variable"))

# ------------------------------------------------------------------ columns
_LV = "a1 AS lv_a, b1 AS latent_b, c1 AS c_comp, a2, a3"
register("drop_prefixed", with_panel("SELECT row_id, " + ", ".join([rd("c1", "c_comp"), rd("a2"), rd("a3")]) + " FROM panel", with_row_id=True))(
    lambda spark, d: P.drop_prefixed(load_panel(spark, d, with_row_id=True).selectExpr("row_id", *_LV.split(", "))))
register("drop_identifiers", with_panel("SELECT " + ", ".join([rd("a1", "lv_a"), rd("b1", "latent_b"), rd("a2"), rd("a3")]) + " FROM panel", with_row_id=True))(
    lambda spark, d: P.drop_identifiers(load_panel(spark, d, with_row_id=True).selectExpr("row_id", *_LV.split(", ")), ["row_id"]))

_CODES = "CASE p_size % 8 WHEN 0 THEN 'PV' WHEN 1 THEN 'ST' WHEN 2 THEN 'SC' WHEN 3 THEN 'XESCS' WHEN 4 THEN 'MISCED' WHEN 5 THEN 'SCHSIZE' WHEN 6 THEN 'ZSCHSIZE' ELSE 'W' END || p_partkey"
register("infer_variable_type",
         f"SELECT code, CASE WHEN starts_with(code, 'PV') THEN '{P.TYPE_RULES[0][2]}' WHEN starts_with(code, 'ST') THEN '{P.TYPE_RULES[1][2]}' "
         f"WHEN starts_with(code, 'SC') THEN '{P.TYPE_RULES[2][2]}' WHEN contains(code, 'ESCS') THEN '{P.TYPE_RULES[3][2]}' "
         f"WHEN contains(code, 'MISCED') THEN '{P.TYPE_RULES[4][2]}' WHEN contains(code, 'SCHSIZE') THEN '{P.TYPE_RULES[6][2]}' ELSE '{P.TYPE_DEFAULT}' END AS inferred_type "
         f"FROM (SELECT {_CODES} AS code FROM part)")(
    lambda spark, d: _t(spark, d, "part").selectExpr(f"{_CODES} AS code").withColumn("inferred_type", P.infer_variable_type(F.col("code"))))


def _wide_sheet(spark, d):
    g = load_panel(spark, d).groupBy("replicate")
    cells = [F.avg(F.when(F.col("technique") == t, F.col(v))).alias(f"{t}__{v}") for t in TECHNIQUES for v in V]
    return g.agg(*cells)


register("unpivot_long", with_panel(
    " UNION ALL ".join(f"SELECT replicate, '{t}' AS technique, '{v}' AS metric, " + rd(f"avg(CASE WHEN technique = '{t}' THEN {v} END)", "value")
                       + " FROM panel GROUP BY replicate" for t in TECHNIQUES for v in V)))(
    lambda spark, d: unpivot_long(_wide_sheet(spark, d), ["replicate"]))


def _schemas(spark, d):
    names = ["customer", "supplier", "part", "orders"]
    tables = {n: _t(spark, d, n) for n in names}
    plain = {n: df.toDF(*[c.split("_", 1)[1] for c in df.columns]) for n, df in tables.items()}
    out = None
    for a in names:
        for b in names:
            row = plain[a].agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(",".join(J.common_columns(plain[a], plain[b]))).alias("common"),
                               F.lit(J.schema_equal(plain[a], plain[b])).alias("equal"), F.count(F.lit(1)).alias("n_rows_a"))
            out = row if out is None else out.unionByName(row)
    return out


_COLS = {"customer": "custkey name nationkey acctbal mktsegment", "supplier": "suppkey name nationkey acctbal",
         "part": "partkey name brand type size retailprice", "orders": "orderkey custkey orderstatus totalprice orderdate orderpriority"}
register("common_columns", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, '{','.join(c for c in x.split() if c in y.split())}' AS common, {str(x == y).upper()} AS equal, count(*) AS n_rows_a FROM {a}"
    for a, x in _COLS.items() for b, y in _COLS.items()))(_schemas)

# ------------------------------------------------------------------ summaries
register("boundary_table", with_panel(
    " UNION ALL ".join(f"SELECT technique, '{v}' AS variable, count({v}) AS n, " + ", ".join([rd(f"avg({v})", "mean"), rd(f"stddev_samp({v})", "sd"), rd(f"min({v})", "min"), rd(f"max({v})", "max")])
                       + " FROM panel GROUP BY technique" for v in V), extended=True))(
    lambda spark, d: M.continuous_summary(load_panel(spark, d, extended=True), V))

_PROFILE = {"quantity": "l_quantity", "discount": "l_discount"}
_SHARES = {"returnflag": ("l_returnflag", ["A", "N", "R"]), "linestatus": ("l_linestatus", ["F", "O"])}


def _profile_sql():
    parts = ["SELECT l_linenumber, 'n' AS variable, 'count' AS statistic, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1"]
    for label, c in _PROFILE.items():
        for stat, e in (("mean", f"avg({c})"), ("sd", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"),
                        ("missing_pct", f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100")):
            parts.append(f"SELECT l_linenumber, '{label}' AS variable, '{stat}' AS statistic, CAST({e} AS DOUBLE) AS value FROM lineitem GROUP BY 1")
    for label, (c, values) in _SHARES.items():
        for v in values:
            parts.append(f"SELECT l_linenumber, '{label}' AS variable, '{v}' AS statistic, avg(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END) * 100 AS value FROM lineitem GROUP BY 1")
    return "SELECT l_linenumber, variable, statistic, " + rd("value") + " FROM (" + " UNION ALL ".join(parts) + ")"


register("distribution_stats", _profile_sql())(lambda spark, d: J.profile(
    _t(spark, d, "lineitem"), ["l_linenumber"], _PROFILE, {k: {v: F.col(c) == v for v in vs} for k, (c, vs) in _SHARES.items()}))

# ------------------------------------------------------------------ construct correlations of the path model
def _latent_pairs(spark, d):
    pls = MS.pls_fit(load_panel(spark, d), MEASUREMENT, STRUCTURE)
    return MS.sheet(pls, "construct_corr", "r").filter("key1 > key2").select(
        "technique", "replicate", F.col("key1").alias("var_i"), F.col("key2").alias("var_j"), F.col("value").alias("r"))


register("latent_delta")(lambda spark, d: D.pair_delta(_latent_pairs(spark, d)))
register("latent_stability")(lambda spark, d: D.latent_stability(D.pair_delta(_latent_pairs(spark, d)), "pls"))
# equal-weight composites stand in for latent scores, so that SQL can rebuild them
register("latent_delta_composites", with_panel(
    "SELECT technique, var_i, var_j, " + ", ".join(rd(c) for c in ["r_real", "r_syn", "r_min", "r_max", "delta", "abs_delta"])
    + " FROM dl WHERE var_i <> var_j", QD._COV_CTES, extended=True))(
    lambda spark, d: QD._cov_delta(spark, d).filter(F.col("var_i") != F.col("var_j")))
register("latent_stability_composites", with_panel(
    "SELECT technique, " + rd("avg(abs_delta)", "mean_abs_delta") + ", " + rd("median(abs_delta)", "median_abs_delta") + ", " + rd("max(abs_delta)", "max_abs_delta")
    + ", 'composite' AS model FROM dl WHERE var_i <> var_j GROUP BY technique", QD._COV_CTES, extended=True))(
    lambda spark, d: D.latent_stability(QD._cov_delta(spark, d), "composite"))


# ------------------------------------------------------------------ sinks: written, then read back
def _written(spark, d):
    path = shared_path(spark, "sheet")
    S.write_table(load_panel(spark, d).groupBy("technique").agg(*[F.avg(v).alias(v) for v in V]), path, "csv", decimals=3)
    return spark.read.option("header", True).schema("technique string, " + ", ".join(f"{v} double" for v in V)).csv(path)


register("write_table", with_panel("SELECT technique, " + ", ".join(f"round(avg({v}), 3) AS {v}" for v in V) + " FROM panel GROUP BY technique"))(_written)


def _headerless(spark, d):
    path = shared_path(spark, "headerless")
    rows = _t(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS a", "CAST(p_size AS STRING) AS b", "p_brand AS c", "1 AS o")
    bogus = _t(spark, d, "part").agg(F.lit("0").alias("a"), F.lit("1").alias("b"), F.lit("2").alias("c"), F.lit(0).alias("o"))
    # four replicate files, each led by the bogus row
    file = F.explode(F.when(F.col("o") == 0, F.array(*[F.lit(k) for k in range(4)])).otherwise(F.array(F.pmod(F.xxhash64("a"), F.lit(4)).cast("int"))))
    files = rows.unionByName(bogus).withColumn("f", file).repartition("f").sortWithinPartitions("f", "o", "a")
    files.drop("o").write.partitionBy("f").csv(path)
    return S.drop_index_row_set_headers(S.read_headerless_csv(spark, path), ["partkey", "size", "brand"])


register("drop_index_row_set_headers", "SELECT CAST(p_partkey AS VARCHAR) AS partkey, CAST(p_size AS VARCHAR) AS size, p_brand AS brand FROM part")(_headerless)


def _panel_files(spark, d):
    path = shared_path(spark, "panel-files")
    p = load_panel(spark, d).select("technique", "replicate", *V)
    p.filter("technique = 'REAL'").drop("technique", "replicate").coalesce(1).write.option("header", True).csv(f"{path}/real")  # REAL is one file by contract
    # one file per replicate, as generators leave them
    syn = p.filter("technique <> 'REAL'").withColumns({"t": F.col("technique"), "k": F.col("replicate")}).drop("technique", "replicate")
    syn.repartition("t", "k").write.partitionBy("t", "k").option("header", True).csv(f"{path}/syn")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(v, T.DoubleType()) for v in V])
    names = [t for t in TECHNIQUES if t != "REAL"]
    files = S.scan_panel_files(spark, {"REAL": f"{path}/real"} | {t: f"{path}/syn/t={t}/k=*" for t in names}, schema)
    return files.groupBy(*DS).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(v).alias(f"mean_{v}") for v in V])


register("scan_panel_files", with_panel(
    "SELECT technique, replicate, count(*) AS n_rows, " + ", ".join(rd(f"avg({v})", f"mean_{v}") for v in V)
    + " FROM panel GROUP BY technique, replicate"))(_panel_files)
