"""Incremental panel load: replicate files arrive, stored partial moments and counts grow.

Each micro-batch of new files becomes one folder of partial co-moments (one row per dataset and
pair) and one of counts (rows, filled values, least and greatest value per dataset and variable), named by the batch
number.  A batch that is run again after a failure overwrites its own folders, so nothing is
counted twice; the stream's checkpoint knows the files that were taken.  Reading merges
the folders with Chan's formula: the result equals the moments of all files at once, and the
rows themselves are never read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators.dependency import DATASET, combine_partials, moment_partials, moments_of

Build = Callable[[DataFrame], DataFrame]


def take_batch(rows: DataFrame, batch_id: int, store: str, variables: Sequence[str], by: Sequence[str] = DATASET) -> None:
    """Store one batch's partial moments and counts under its number."""
    by = list(by)
    combine_partials(moment_partials(rows, variables, by), by).write.mode("overwrite").parquet(f"{store}/moments/batch={batch_id}")
    long = rows.select(*by, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])).alias("_v")).select(*by, "_v.*")
    counts = long.groupBy(*by, "variable").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
    counts.write.mode("overwrite").parquet(f"{store}/counts/batch={batch_id}")


def load_new_files(spark: SparkSession, source_dir: str, schema: T.StructType, store: str, rows: Build, variables: Sequence[str],
                   by: Sequence[str] = DATASET, pattern: str = "*.parquet", files_per_batch: int = 1) -> int:
    """Take the files of ``source_dir`` that were not taken yet; the number of batches run."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
              .option("recursiveFileLookup", "true").parquet(source_dir))
    q = (stream.writeStream.foreachBatch(lambda batch, batch_id: take_batch(rows(batch), batch_id, store, variables, by))
         .option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return len([p for p in q.recentProgress if p["numInputRows"] > 0])


def stored_moments(spark: SparkSession, store: str, by: Sequence[str] = DATASET) -> DataFrame:
    """Moments of everything that was taken."""
    return moments_of(combine_partials(spark.read.parquet(f"{store}/moments").drop("batch"), by), by)


def stored_counts(spark: SparkSession, store: str, by: Sequence[str] = DATASET) -> DataFrame:
    """Rows, filled values, least and greatest value per dataset and variable of everything that was taken."""
    return spark.read.parquet(f"{store}/counts").groupBy(*by, "variable").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))
