"""Registered queries: streaming jobs over the events table and over the panel's rows as they arrive.

The panel stream reads lineitem's files; event time is l_shipdate, and a2 is missing as in the extended panel.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fidelis.plans import q_dependency as QD
from fidelis.plans.registry import rd, register
from fidelis.session import shared_path
from fidelis.sources import panel as PN
from fidelis.sources.panel import VARIABLES as V
from fidelis.sources.panel import panel_from_lineitem
from fidelis.streaming.incremental import load_new_files, stored_moments
from fidelis.streaming.moments import stream_adherence, stream_comoments, stream_moments

WINDOW_DAYS = 90
WINDOW, WATERMARK = f"{WINDOW_DAYS} days", "30 days"

register("stream_moments", f"SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, event_type AS technique, count(value) AS n, "
         f"{rd('avg(value)', 'mean')}, {rd('var_samp(value)', 'var')}, {rd('min(value)', 'min')}, {rd('max(value)', 'max')} FROM events GROUP BY ALL")(
    lambda spark, d: stream_moments(spark, d))


def panel_rows(lineitem):
    """(ts, technique, replicate, indicators) of lineitem rows; no shuffle, so it runs on a stream."""
    p = panel_from_lineitem(lineitem, keep=["l_orderkey", "l_shipdate"])
    a2 = F.when(F.col("l_orderkey") % PN.MISSING_MOD != PN.MISSING_REM, F.col("a2"))
    return p.withColumn("a2", a2).withColumnRenamed("l_shipdate", "ts").drop("l_orderkey")


def bounds(spark, d):
    """REAL's least and greatest value of each indicator: one row per variable."""
    real = panel_rows(spark.read.parquet(f"{d}/lineitem.parquet")).filter("technique = 'REAL'")
    r = real.agg(*[F.struct(F.lit(v).alias("variable"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(v) for v in V])
    return r.select(F.explode(F.array(*V)).alias("b")).select("b.*")


def _panel_sql():
    base = PN.panel_sql().replace("\nFROM lineitem", f",\n  CAST(floor(epoch(l_shipdate) / {86400 * WINDOW_DAYS}) * {86400 * WINDOW_DAYS} AS BIGINT) AS window_start, l_orderkey\nFROM lineitem")
    cols = ", ".join(v if v != "a2" else f"CASE WHEN l_orderkey % {PN.MISSING_MOD} <> {PN.MISSING_REM} THEN a2 END AS a2" for v in V)
    return f"SELECT window_start, technique, replicate, {cols} FROM ({base})"


_CTE = f"WITH panel AS MATERIALIZED ({_panel_sql()})"
_STATS = ["mean_i", "mean_j", "sd_i", "sd_j", "cov", "corr"]
register("stream_comoments", f"{_CTE} SELECT window_start, technique, var_i, var_j, n, {', '.join(rd(c) for c in _STATS)} FROM ("
         + QD._pairs_sql("panel", ["window_start", "technique"], V, ("full",)) + ") WHERE n > 0")(
    lambda spark, d: stream_comoments(spark, d, "lineitem.parquet", panel_rows, V, WINDOW, WATERMARK, "l_shipdate"))

_LONG = " UNION ALL ".join(f"SELECT window_start, technique, '{v}' AS variable, {v} AS value FROM panel WHERE {v} IS NOT NULL" for v in V)
register("stream_boundary_adherence", f"{_CTE}, long AS MATERIALIZED ({_LONG}), b AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM long WHERE technique = 'REAL' GROUP BY variable) "
         f"SELECT window_start, technique, variable, count(*) AS n, {rd('avg(CASE WHEN value BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)', 'boundary_adherence')}, "
         "CAST(0 AS BIGINT) AS late FROM long JOIN b USING (variable) WHERE technique <> 'REAL' GROUP BY ALL")(
    lambda spark, d: stream_adherence(spark, d, "lineitem.parquet", panel_rows, bounds(spark, d), V, WINDOW, WATERMARK, "l_shipdate")
    .filter("technique <> 'REAL'"))


def _incremental(spark, d):
    store = shared_path(spark, "panel-store")
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    load_new_files(spark, os.path.join(d, ""), schema, store, panel_rows, V, pattern="lineitem.parquet")
    return stored_moments(spark, store)


register("incremental_panel", f"{_CTE} SELECT technique, replicate, var_i, var_j, n, {', '.join(rd(c) for c in _STATS)}, n_rows FROM ("
         + QD._pairs_sql("panel", ["technique", "replicate"], V, ("full",)) + ")")(_incremental)
