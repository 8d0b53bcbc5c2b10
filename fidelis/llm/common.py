"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.session import materialise, open_store, shared_path

__all__ = ["lookup_join", "materialise", "open_store", "read_table", "shared_path", "words"]

# A word is a maximal run of characters other than space and \t \n \v \f \r.
BLANKS = r"[\x20\x09-\x0D]+"

# A lookup table is broadcast up to this many rows; a larger one is joined by salted shuffle.
LOOKUP_ROWS = 20_000
LOOKUP_SALTS = 32


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def lookup_join(left: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of many rows with a materialised table of one row per ``keys`` (null equals null).

    The table is counted first: up to ``LOOKUP_ROWS`` rows it is broadcast, beyond that it
    is repeated once per salt and shuffled, so that a hot key is spread over
    ``LOOKUP_SALTS`` partitions.
    """
    small = lookup.count() <= LOOKUP_ROWS
    right = lookup.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in lookup.columns if c not in keys])
    if small:
        right = F.broadcast(right)
        on = None
    else:
        left = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(LOOKUP_SALTS)))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOOKUP_SALTS - 1).cast("long")))
        right = right.withColumn("_r_salt", salts)
        on = F.col("_salt") == F.col("_r_salt")
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = eq if on is None else on & eq
    return left.join(right, on, "left").drop(*[f"_r_{k}" for k in keys], "_salt", "_r_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
