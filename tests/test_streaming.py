"""Streamed statistics equal the batch statistics on the same rows; late rows are counted; repeated batches change nothing."""

import os
import time

import pytest
from pyspark.sql import functions as F

from fidelis.operators.dependency import moments
from fidelis.streaming import incremental
from fidelis.streaming.moments import adherence, batch_moments, comoments, stream_adherence, stream_comoments, stream_moments

from .conftest import SF_SMALL

ROWS = "ts timestamp, technique string, replicate int, x double, y double, z double"


def _same(a, b, keys):
    a, b = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (a, b))
    assert len(a) == len(b) > 0
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs().fillna(0) < 1e-9).all() and (a[c].isna() == b[c].isna()).all(), c
        else:
            assert (a[c] == b[c]).all(), c


def test_stream_equals_batch(spark):
    _same(stream_moments(spark, SF_SMALL), batch_moments(spark.read.parquet(f"{SF_SMALL}/events.parquet")), ["window_start", "technique"])


def _files(spark, tmp_path, groups):
    """One Parquet file per group of (hour, technique) cells, named and timed in order; 40 rows a cell, some values missing."""
    out = str(tmp_path / "in")
    os.makedirs(out)
    all_ = None
    for k, cells in enumerate(groups):
        rows = [(f"2024-01-01 {h:02d}:{i % 60:02d}:00", t, k + 1, h * 100.0 + (i * 7919 % 101) / 10, None if i % 9 == 0 else (i * 104729 % 89) / 7 - h, float(i % 3) if i % 11 else None)
                for h, t in cells for i in range(40)]
        df = spark.createDataFrame(rows, "s string, technique string, replicate int, x double, y double, z double").select(F.col("s").cast("timestamp").alias("ts"), "technique", "replicate", "x", "y", "z")
        df.coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        part = next(p for p in os.listdir(tmp_path / f"w{k}") if p.endswith(".parquet"))
        os.rename(tmp_path / f"w{k}" / part, f"{out}/f{k}.parquet")
        now = time.time() - 1000 + 10 * k
        os.utime(f"{out}/f{k}.parquet", (now, now))
        all_ = df if all_ is None else all_.unionByName(df)
    return out, all_


def test_comoments_out_of_order_within_the_watermark(spark, tmp_path):
    out, rows = _files(spark, tmp_path, [[(1, "A"), (3, "A")], [(2, "A"), (2, "B")], [(1, "B"), (4, "A")]])
    got = stream_comoments(spark, out, "*.parquet", lambda s: s, ["x", "y", "z"], "1 hour", "6 hours", "ts")
    _same(got, comoments(rows, ["x", "y", "z"], "1 hour"), ["window_start", "technique", "var_i", "var_j"])


def test_adherence_counts_late_rows(spark, tmp_path):
    # hour 1 comes again after hour 9 has moved the watermark past its end
    out, rows = _files(spark, tmp_path, [[(1, "A"), (2, "B")], [(9, "A")], [(9, "B")], [(1, "A"), (1, "B"), (10, "A")]])
    bounds = spark.createDataFrame([("x", 105.0, 908.0), ("y", -4.0, 3.0)], "variable string, lo double, hi double")
    got = stream_adherence(spark, out, "*.parquet", lambda s: s, bounds, ["x", "y"], "1 hour", "1 hour", "ts")
    keys = ["window_start", "technique", "variable"]
    late = F.col("replicate").eqNullSafe(4) & (F.hour("ts") == 1)
    on_time = adherence(rows.filter(~late), bounds, ["x", "y"], "1 hour")
    _same(got.filter("n > 0").drop("late"), on_time, keys)
    counted = {(r.technique, r.variable): r.late for r in got.filter("late > 0").collect()}
    filled = sum(i % 9 != 0 for i in range(40))
    assert counted == {("A", "x"): 40, ("B", "x"): 40, ("A", "y"): filled, ("B", "y"): filled}
    whole = adherence(rows, bounds, ["x", "y"], "1 hour")
    assert whole.agg(F.sum("n")).first()[0] == got.agg(F.sum(F.col("n") + F.col("late"))).first()[0]


def test_incremental_load_is_idempotent(spark, tmp_path):
    out, rows = _files(spark, tmp_path, [[(1, "A"), (2, "B")], [(3, "A"), (1, "B")], [(4, "A")]])
    hold = tmp_path / "hold.parquet"
    os.rename(f"{out}/f2.parquet", hold)
    store = str(tmp_path / "store")
    v = ["x", "y", "z"]
    load = lambda: incremental.load_new_files(spark, out, rows.schema, store, lambda b: b, v)
    keys = ["technique", "replicate", "var_i", "var_j"]
    assert load() == 2
    first = rows.filter("replicate < 3")
    _same(incremental.stored_moments(spark, store), moments(first, v), keys)
    # the same batch again, as after a failure between writing and the checkpoint
    incremental.take_batch(spark.read.parquet(f"{out}/f1.parquet"), 1, store, v)
    assert load() == 0  # nothing new
    _same(incremental.stored_moments(spark, store), moments(first, v), keys)
    os.rename(hold, f"{out}/f2.parquet")
    assert load() == 1
    _same(incremental.stored_moments(spark, store), moments(rows, v), keys)
    counts = {(r.technique, r.replicate, r.variable): r for r in incremental.stored_counts(spark, store).collect()}
    assert (counts["A", 1, "y"].n_rows, counts["A", 1, "y"].n) == (40, sum(i % 9 != 0 for i in range(40)))
    want = rows.filter("technique = 'A' AND replicate = 3").agg(F.min("x"), F.max("x")).first()
    assert (counts["A", 3, "x"].min, counts["A", 3, "x"].max) == tuple(want)


def test_moments_of_few_rows(spark):
    df = spark.createDataFrame([("A", 1, 1.0, None), ("A", 1, 3.0, None), ("B", 1, 1e9 + 1, 2.0), ("B", 1, 1e9 + 3, 6.0), ("C", 1, None, None)],
                               "technique string, replicate int, x double, y double")
    got = {r.technique: r for r in moments(df, ["x", "y"]).collect()}
    assert (got["A"].n, got["A"].mean_i, got["A"].corr, got["A"].n_rows) == (0, None, None, 2) and got["C"].n_rows == 1
    assert got["B"].cov == pytest.approx(4.0) and got["B"].corr == pytest.approx(1.0) and got["B"].mean_i == 1e9 + 2
