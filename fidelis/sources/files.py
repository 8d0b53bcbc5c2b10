"""Sources and sinks: panel files, column groups, audits, metadata, CSV/Parquet writers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIP_NAME_PARTS = ("log", "correction")


def _skipped(file: str) -> bool:
    return any(part in file.rsplit("/", 1)[-1].lower() for part in SKIP_NAME_PARTS)


def _has_rows(df: DataFrame, file: str) -> bool:
    """Whether ``file``, one of ``df.inputFiles()``, holds a row: only files whose path ends so are opened, and the first
    row ends the scan."""
    path = file.split("://", 1)[-1]  # the metadata may write the scheme in another form
    mine = df.filter(F.col("_metadata.file_path").endswith(path)).withColumn("_file", F.input_file_name())
    return bool(mine.filter(F.col("_file") == file).select(F.lit(1)).take(1))


def scan_panel_files(spark: SparkSession, sources: dict[str, str], schema: T.StructType, real: str = "REAL",
                     fmt: str = "csv", header: bool = True) -> DataFrame:
    """Read REAL (exactly one file) and every technique's replicate files into one panel.

    ``sources`` maps technique -> file glob.  File names containing ``log`` or
    ``correction`` are skipped, and so are files without rows; the replicate number is the
    position of the file in name order (files are listed once on the driver, rows never are).
    """
    frames = []
    for tech, pattern in sources.items():
        reader = spark.read.schema(schema).format(fmt)
        if fmt == "csv":
            reader = reader.option("header", header)
        df = reader.load(pattern)
        files = [f for f in sorted(set(df.inputFiles())) if not _skipped(f) and _has_rows(df, f)]
        if not files:
            raise FileNotFoundError(f"no files for technique {tech}")
        if tech == real and len(files) != 1:
            raise ValueError(f"REAL must be exactly one file, found {len(files)}")
        fmap = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f), F.lit(0 if tech == real else i + 1))])
        rows = df.withColumn("replicate", fmap[F.input_file_name()]).filter("replicate IS NOT NULL")
        frames.append(rows.select(F.lit(tech).alias("technique"), "replicate", *[F.col(f.name) for f in schema.fields]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def select_columns(df: DataFrame, columns: Sequence[str], condition: Column | None = None) -> DataFrame:
    """Projection (and optional filter) that Catalyst pushes into the Parquet scan."""
    out = df.filter(condition) if condition is not None else df
    return out.select(*columns)


def split_wide_table(df: DataFrame, keys: Sequence[str], groups: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """A key table plus one table per column group, each repeating the keys."""
    out = {"keys": df.select(*keys)}
    for name, cols in groups.items():
        out[name] = df.select(*keys, *cols)
    return out


def split_summary(parts: dict[str, DataFrame]) -> DataFrame:
    frames = []
    for name, df in parts.items():
        first = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
        s = F.sum(first[0]) if first else F.lit(None).cast("double")
        frames.append(df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows"), s.alias("sum_first")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def pool_replicates(panel: DataFrame, variables: Sequence[str]) -> DataFrame:
    return panel.groupBy("technique").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("replicate").alias("n_replicates"),
        *[F.avg(v).alias(f"mean_{v}") for v in variables])


def column_audit(df: DataFrame, by: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Per source: rows, required columns with any value, names of the required columns without one."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"_c_{c}") for c in required])
    present = reduce(lambda a, b: a + b, [(F.col(f"_c_{c}") > 0).cast("int") for c in required])
    missing = F.concat_ws(",", *[F.when(F.col(f"_c_{c}") == 0, F.lit(c)) for c in required])
    return g.select(*by, "n_rows", present.alias("n_present"), missing.alias("missing_required"))


def distinct_union_sorted(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of first columns, trimmed, blanks dropped, distinct, sorted."""
    u = reduce(lambda a, b: a.union(b), [f.select(F.trim(F.col(f.columns[0]).cast("string")).alias("value"))
                                          for f in frames])
    return u.filter(F.col("value") != "").distinct().orderBy("value")


def table_metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column: rows, nulls and the heuristic variable type (one aggregate per table)."""
    from fidelis.operators.prep import infer_variable_type

    frames = []
    for name, df in tables.items():
        aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(c).alias(f"_c_{i}") for i, c in enumerate(df.columns)]
        g = df.agg(*aggs)
        rows = [F.struct(F.lit(c).alias("column_name"), (F.col("_n") - F.col(f"_c_{i}")).alias("n_null"))
                for i, c in enumerate(df.columns)]
        frames.append(g.select(F.lit(name).alias("table_name"), F.col("_n").alias("n_rows"),
                               F.explode(F.array(*rows)).alias("r")).select(
            "table_name", "r.column_name", "n_rows", "r.n_null",
            infer_variable_type(F.col("r.column_name")).alias("inferred_type")))
    return reduce(lambda a, b: a.unionByName(b), frames)


_ORIGIN = ("_file", "_start", "_row")


def drop_index_row_set_headers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Headerless synthetic file: drop a bogus first row holding 0, 1, 2, ... and name the columns.

    ``df`` comes from ``read_headerless_csv`` of any number of files; each file may have such a first line."""
    data_cols = [c for c in df.columns if c not in _ORIGIN]
    if len(data_cols) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {len(data_cols)}")
    bogus = reduce(lambda a, b: a & b, [F.trim(F.col(c).cast("string")).isin(str(i), f"{i}.0")
                                        for i, c in enumerate(data_cols)])
    # the first line of a file is the first row of the split that starts at byte 0
    first = df.filter("_start = 0").groupBy("_file").agg(F.min("_row").alias("_first")).select("_first")
    keep = df.withColumn("_bogus", bogus).join(first, (F.col("_row") == F.col("_first")) & F.col("_bogus"), "left_anti")
    return keep.select(*[F.col(c).alias(n) for c, n in zip(data_cols, names)])


def read_headerless_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless files under ``path``: columns _c0, _c1, ..., and where each row comes from: _file, _start (of its
    split) and _row (numbers that ascend within a split)."""
    df = spark.read.option("header", False).option("recursiveFileLookup", True).csv(path)
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                     F.monotonically_increasing_id().alias("_row"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                decimals: int | None = None) -> None:
    """Sink: Parquet (default) or CSV; ``decimals`` formats doubles for a presentation copy."""
    out = df
    if decimals is not None:
        out = out.select(*[F.round(F.col(f.name), decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                           else F.col(f.name) for f in df.schema.fields])
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
