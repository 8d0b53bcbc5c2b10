"""Mixing sources to target weights.

Words are counted per source, every source gets a target by weight, and a document is
emitted floor(rate) times plus once more if a number hashed from its doc_id and the seed
lies below the fraction of the rate (rate = target / size of its source).

Weights come from a pattern repeated over the sources in code-point order, null last.  A
target stops at ``cap`` times the size of its source; the excess goes to the others by
weight until none is above.  The level of that sharing is found by one aggregation of the
source table a round, so nothing but three sums reaches the driver.

Defined cases: null or empty texts have no words and are never taken; a null source is a
source of its own; a source without words has target 0; a null doc_id draws like any other
value; rows repeated with one doc_id draw alike; an empty table gives an empty result;
other columns pass through ``emit`` unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import lookup_join, materialise, words
from fidelis.operators.order import with_row_index

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def draw(doc_id, seed: str = SEED):
    """Uniform number in [0, 1) from the first 52 bits of the md5 of seed and doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: _source, source_size, target, rate."""
    sizes = materialise(
        docs.select(F.col("source").alias("_source"), F.size(words(F.col("text"))).cast("long").alias("_size"))
        .groupBy("_source").agg(F.sum("_size").alias("source_size")),
        "mix-sizes",
    )
    ranked = with_row_index(
        sizes.withColumn("_null", F.col("_source").isNull()).select("_null", "_source", "source_size"),
        ["_null", "_source"], "_rank",
    )
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    table = materialise(
        ranked.select("_source", "source_size",
                      F.get(pattern, ((F.col("_rank") - 1) % len(weights)).cast("int")).alias("_weight")),
        "mix-weights",
    )
    limit = F.col("source_size") * cap
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("_weight") > limit
        row = table.agg(
            F.sum(F.when(above, limit)).alias("fixed"),
            F.sum(F.when(~above, F.col("_weight"))).alias("open"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped = row["n"]
        level = (total - float(row["fixed"] or 0)) / row["open"]
    level_col = F.lit(level) * F.col("_weight")
    target = F.when(level_col > limit, limit.cast("double")).otherwise(level_col)
    return materialise(
        table.withColumn("target", target).withColumn(
            "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        ).drop("_weight"),
        "mix-targets",
    )


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, _source, more) with source_size, target and _copies, the times a row is emitted."""
    rated = lookup_join(docs, targets, ["_source"])
    whole = F.floor("rate")
    copies = whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return rated.withColumn("_copies", copies.cast("long"))


def emit(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, "doc_id", F.col("source").alias("_source"))
    counted = with_copies(rows, source_targets(docs, weights, cap), seed).filter("_copies > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")
    return counted.select("_row", copies).select("_row.*")


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, copies."""
    sized = docs.select("doc_id", F.col("source").alias("_source"), F.size(words(F.col("text"))).cast("long").alias("size"))
    return with_copies(sized, source_targets(docs, weights, cap), seed).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.col("_copies") * F.col("size")).alias("taken"), F.col("_copies").alias("copies"),
    )


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
r AS (SELECT source, s, [{', '.join(f'{w}.0' for w in WEIGHTS)}][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS w FROM s),
a AS (SELECT *, sum(s) OVER () AS t, sum(w) OVER () AS ws,
             coalesce(sum(s) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
             coalesce(sum(w) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0 FROM r),
c AS (SELECT *, CAST(t - {CAP} * s0 AS DOUBLE) / (ws - w0) * w > {CAP} * s AS capped FROM a),
l AS (SELECT (any_value(CAST(t AS DOUBLE)) - coalesce(sum({CAP} * s) FILTER (capped), 0)) / sum(w) FILTER (NOT capped) AS lv FROM c),
g AS (SELECT source, CAST(s AS BIGINT) AS source_size,
             CASE WHEN capped THEN CAST({CAP} * s AS DOUBLE) ELSE lv * w END AS target FROM c, l),
e AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / {float(2**52)!r} AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM e
"""
