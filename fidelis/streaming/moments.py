"""Streaming moments: mergeable per-window statistics of arriving rows.

Rows arrive as files; a watermark on event time bounds lateness; every tumbling window x
technique keeps its aggregates in the state store.  Counts, min/max and centred
(co-)moments merge across micro-batches, so the streamed result equals the batch result on
the rows that were not late.

``replay`` runs a streaming aggregation over a folder (available-now trigger) in append
mode: a window is written once, when the watermark has passed its end, and its state is
dropped then.  Windows still open at the end are closed by a last file with one row far
in the future, whose own window is not returned.  Beside it a second query keeps a ledger of
arrivals per window, one folder a micro-batch (a repeated batch overwrites its own), so
that late rows are counted: arrivals less the rows in the written windows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.operators.dependency import pairs
from fidelis.session import checkpoint_dir

Build = Callable[[DataFrame], DataFrame]


def replay(spark: SparkSession, source_dir: str, pattern: str, ts: str, watermark: str, build: Build,
           files_per_trigger: int = 1, ledger: Build | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(closed windows, arrivals) of the files under ``source_dir`` matching ``pattern``.

    ``build`` turns the rows (with a watermark on the timestamp ``ts``) into the windowed aggregate; ``ledger`` turns
    a micro-batch into counts to add up.  A filter on columns of the rows belongs after the aggregate: before it, the optimiser
    moves it below the watermark, where it would drop the closing row."""
    schema = spark.read.parquet(os.path.join(source_dir, pattern)).schema
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    last = spark.read.schema(schema).parquet(os.path.join(source_dir, pattern)).agg(F.max(ts).alias("t"))
    end = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != ts]
    closing = last.filter("t IS NOT NULL").select(*end, (F.col("t") + F.expr("INTERVAL 3650 DAYS")).cast(schema[ts].dataType).alias(ts))
    closing.select(*schema.fieldNames()).write.parquet(f"{base}/closing")

    def source(path: str, glob: str) -> DataFrame:
        read = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
        return read.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need TIMESTAMP, not TIMESTAMP_NTZ

    # one query over both folders, so the closing row moves the same watermark; a first run reads
    # the data, a second run over the same checkpoint the closing file
    for k in range(2):
        stream = source(source_dir, pattern).unionByName(source(f"{base}/closing", "*.parquet" if k else "no-file-yet"))
        agg = build(stream.withWatermark(ts, watermark))
        q = (agg.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    out = spark.read.schema(agg.schema).parquet(f"{base}/out")
    if ledger is None:
        return out, None

    def note(batch: DataFrame, batch_id: int) -> None:
        ledger(batch).write.mode("overwrite").parquet(f"{base}/arrived/batch={batch_id}")

    q = (source(source_dir, pattern).writeStream.foreachBatch(note).option("checkpointLocation", f"{base}/ledger")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out, spark.read.parquet(f"{base}/arrived").drop("batch")


def _window_start(ts: str, window: str) -> Column:
    return F.window(ts, window).alias("w")


# ------------------------------------------------------------------ moments of one value

def _aggregate(df: DataFrame, window: str, technique: str, value: str, ts: str) -> DataFrame:
    return df.groupBy(_window_start(ts, window), F.col(technique).alias("technique")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def _shape(df: DataFrame) -> DataFrame:
    return df.select(F.unix_timestamp(F.col("w.start")).alias("window_start"), "technique", "n", "mean", "var", "min", "max")


def batch_moments(df: DataFrame, window: str = "1 hour", technique: str = "event_type", value: str = "value",
                  ts: str = "ts") -> DataFrame:
    return _shape(_aggregate(df.withColumn(ts, F.col(ts).cast("timestamp")), window, technique, value, ts))


def stream_moments(spark: SparkSession, source_dir: str, pattern: str = "events.parquet", window: str = "1 hour",
                   watermark: str = "2 hours", technique: str = "event_type", value: str = "value", ts: str = "ts",
                   files_per_trigger: int = 1) -> DataFrame:
    """Per window and technique: count, mean, variance, min and max of ``value``, in append mode."""
    return replay(spark, source_dir, pattern, ts, watermark, lambda s: _shape(_aggregate(s, window, technique, value, ts)), files_per_trigger)[0]


# ------------------------------------------------------------------ pairwise co-moments

def comoments(rows: DataFrame, variables: Sequence[str], window: str, ts: str = "ts") -> DataFrame:
    """Per window, technique and pair i < j: pairwise-complete n, means, standard deviations, covariance, correlation.

    ``rows`` (ts, technique, variables) may be a stream or a table.  A row becomes one struct per pair; partial
    aggregation merges them before the shuffle, and the state holds one centred co-moment per window, technique and pair."""
    listed = F.array(*[F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                       for a, b in pairs(variables)])
    long = rows.select(ts, "technique", F.explode(listed).alias("_p")).select(ts, "technique", "_p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    done = long.groupBy(_window_start(ts, window), "technique", "var_i", "var_j").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_i"), F.avg("y").alias("mean_j"), F.stddev_samp("x").alias("sd_i"),
        F.stddev_samp("y").alias("sd_j"), F.covar_samp("x", "y").alias("cov"), F.corr("x", "y").alias("corr"))
    return done.select(F.unix_timestamp("w.start").alias("window_start"), "technique", "var_i", "var_j", "n", "mean_i", "mean_j", "sd_i", "sd_j", "cov", "corr")


def stream_comoments(spark: SparkSession, source_dir: str, pattern: str, rows: Build, variables: Sequence[str], window: str, watermark: str,
                     source_ts: str, files_per_trigger: int = 1) -> DataFrame:
    """``comoments`` of a stream of files; ``rows`` turns file rows into (ts, technique, variables), ts from ``source_ts``."""
    return replay(spark, source_dir, pattern, source_ts, watermark, lambda s: comoments(rows(s), variables, window), files_per_trigger)[0]


# ------------------------------------------------------------------ boundary adherence

def adherence(rows: DataFrame, bounds: DataFrame, variables: Sequence[str], window: str, ts: str = "ts") -> DataFrame:
    """Per window, technique and variable: n values and the share inside REAL's ``bounds`` (variable, lo, hi).

    A stream-static join: bounds has one row per variable."""
    listed = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    long = rows.select(ts, "technique", F.explode(listed).alias("_v")).select(ts, "technique", "_v.*").filter("value IS NOT NULL")
    inside = F.col("value").between(F.col("lo"), F.col("hi")).cast("double")
    done = long.join(F.broadcast(bounds), "variable").groupBy(_window_start(ts, window), "technique", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside).alias("boundary_adherence"))
    return done.select(F.unix_timestamp("w.start").alias("window_start"), "technique", "variable", "n", "boundary_adherence")


def stream_adherence(spark: SparkSession, source_dir: str, pattern: str, rows: Build, bounds: DataFrame, variables: Sequence[str], window: str,
                     watermark: str, source_ts: str, files_per_trigger: int = 1) -> DataFrame:
    """``adherence`` of a stream of files, and ``late``: values that came after their window was written."""
    out, arrived = replay(spark, source_dir, pattern, source_ts, watermark, lambda s: adherence(rows(s), bounds, variables, window), files_per_trigger,
                          lambda batch: adherence(rows(batch), bounds, variables, window).select("window_start", "technique", "variable", "n"))
    keys = ["window_start", "technique", "variable"]
    all_ = arrived.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return all_.join(out, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n"), "boundary_adherence", (F.col("_all") - F.coalesce("n", F.lit(0))).alias("late"))
