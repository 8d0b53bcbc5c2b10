"""The ``panel`` view: REAL and synthetic replicates of one table in one DataFrame.

The driver's tables carry no survey microdata, so the panel is derived from
``lineitem`` by a fixed mixing rule that gives indicators with known loadings
(three constructs FA, FB, FC with paths FA->FC and FB->FC).  The same rule is
emitted as SQL text (``panel_sql``) so an independent engine can rebuild the
identical rows.  Only double arithmetic in a fixed operation order is used, so
both engines produce bit-identical indicator values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.operators.order import with_row_index
from fidelis.session import checkpoint_dir

# --- fixed values of the panel rule -------------------------------------------------
# noise e_k = ((l_orderkey*A + l_linenumber*B + l_partkey*K) % M) / M * 3.4641 - 1.7320
# listed as (K, A, B, M) for e1..e9
NOISE_PARAMS = [
    (13, 7919, 104729, 1009),
    (17, 15485, 32452, 997),
    (19, 49979, 86028, 991),
    (23, 67867, 12253, 983),
    (29, 86028, 27449, 977),
    (31, 10007, 57885, 971),
    (37, 33461, 15487, 967),
    (41, 73856, 19349, 953),
    (43, 83492, 60727, 947),
]
NOISE_SCALE, NOISE_SHIFT = 3.4641, 1.7320
Q_CENTER, Q_SCALE = 25.5, 14.43
D_CENTER, D_SCALE = 0.05, 0.029
T_CENTER, T_SCALE = 0.04, 0.0235
# indicator = s * loading * factor + uniqueness * noise
INDICATORS = [
    ("a1", "fa", 0.8, 0.6, 1), ("a2", "fa", 0.8, 0.6, 2), ("a3", "fa", 0.8, 0.6, 3),
    ("b1", "fb", 0.7, 0.714, 4), ("b2", "fb", 0.7, 0.714, 5), ("b3", "fb", 0.7, 0.714, 6),
    ("c1", "fc", 0.9, 0.436, 7), ("c2", "fc", 0.8, 0.6, 8), ("c3", "fc", 0.7, 0.714, 9),
]
TECHNIQUES = ["REAL", "SYN_SAME", "SYN_NOISY", "SYN_INDEP"]  # by l_orderkey % 4
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
# extended panel: a2 missing when l_orderkey % 50 = 7; SYN_COPY = REAL rows with l_orderkey % 20 = 0
MISSING_MOD, MISSING_REM = 50, 7
COPY_MOD = 20
# -------------------------------------------------------------------------------------

VARIABLES = [name for name, *_ in INDICATORS]
MEASUREMENT = {"FA": ["a1", "a2", "a3"], "FB": ["b1", "b2", "b3"], "FC": ["c1", "c2", "c3"]}
STRUCTURE = [("FA", "FC"), ("FB", "FC")]
QI_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "o1"]
SENSITIVE = "sens"

_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _noise(k: int) -> Column:
    kk, a, b, m = NOISE_PARAMS[k - 1]
    raw = (F.col("l_orderkey") * a + F.col("l_linenumber").cast("long") * b + F.col("l_partkey") * kk) % m
    return raw.cast("double") / float(m) * NOISE_SCALE - NOISE_SHIFT


def panel_from_lineitem(lineitem: DataFrame, *, extended: bool = False, with_row_id: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Build the panel (technique, replicate, [row_id], a1..c3 [, o1, qi, sens] [, keep]) from lineitem."""
    cols = [*_LINEITEM_COLS, *keep]
    if with_row_id:
        cols += [c for c in ROW_KEY if c not in cols]
    if extended:
        cols += ["l_returnflag", "l_linestatus"]
    src = lineitem.select(*dict.fromkeys(cols))
    if with_row_id:
        src = with_row_index(src, ROW_KEY, "row_id")
    m = F.col("l_orderkey") % 4
    q = (F.col("l_quantity") - Q_CENTER) / Q_SCALE
    d = (F.col("l_discount") - D_CENTER) / D_SCALE
    t = (F.col("l_tax") - T_CENTER) / T_SCALE
    fa = q
    fb = F.when(m == 3, d).otherwise(F.lit(0.5) * q + F.lit(0.866) * d)
    fc = F.lit(0.4) * fa + F.lit(0.3) * fb + F.lit(0.794) * t
    s = F.when(m == 2, F.lit(0.5)).otherwise(F.lit(1.0))
    factor = {"fa": fa, "fb": fb, "fc": fc}
    technique = F.element_at(F.array(*[F.lit(x) for x in TECHNIQUES]), (m + 1).cast("int"))
    replicate = F.when(m == 0, F.lit(0)).otherwise((F.col("l_partkey") % 3 + 1).cast("int"))
    out = [technique.alias("technique"), replicate.alias("replicate")]
    if with_row_id:
        out.append(F.col("row_id"))
    for name, f, lam, uniq, k in INDICATORS:
        val = s * F.lit(lam) * factor[f] + F.lit(uniq) * _noise(k)
        if extended and name == "a2":
            val = F.when(F.col("l_orderkey") % MISSING_MOD == MISSING_REM, F.lit(None).cast("double")).otherwise(val)
        out.append(val.alias(name))
    if extended:
        out += [F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber"), F.col("l_orderkey")]
    df = src.select(*out, *keep)
    if extended:
        df = df.withColumn("o1", F.floor(F.col("a1") + 3).cast("int"))
        df = df.withColumn(SENSITIVE, F.floor(F.col("b1")).cast("int"))
        copies = (
            df.filter((F.col("technique") == "REAL") & (F.col("l_orderkey") % COPY_MOD == 0))
            .withColumn("technique", F.lit("SYN_COPY"))
            .withColumn("replicate", (F.col("l_orderkey") % 3 + 1).cast("int"))
        )
        df = df.unionByName(copies).drop("l_orderkey")
    return df


def load_panel(spark: SparkSession, sf_dir: str, *, extended: bool = False, with_row_id: bool = False,
               materialize: bool = True) -> DataFrame:
    """The panel of ``sf_dir``'s lineitem.

    By default the panel is derived once and written as Parquet, partitioned by
    technique, under the shared checkpoint folder; later evaluators read it back
    (REAL-only statistics then prune to REAL's files).  The folder name carries the
    source's size and modification time, so a changed source is derived anew.
    """
    src = f"{sf_dir}/lineitem.parquet"
    if not materialize:
        return panel_from_lineitem(spark.read.parquet(src), extended=extended, with_row_id=with_row_id)
    tag = f"{'x' if extended else 'b'}{'r' if with_row_id else 'n'}-{source_fingerprint(spark, src)}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/panel-{tag}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df = panel_from_lineitem(spark.read.parquet(src), extended=extended, with_row_id=with_row_id)
        df.write.mode("overwrite").partitionBy("technique").parquet(path)
    df = spark.read.parquet(path)
    order = ["technique", "replicate"] + (["row_id"] if with_row_id else []) + VARIABLES
    if extended:
        order += ["l_returnflag", "l_linestatus", "l_linenumber", "o1", SENSITIVE]
    return df.select(*order)


def source_fingerprint(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(hpath)
    status = fs.getFileStatus(hpath)
    raw = f"{fs.makeQualified(hpath).toString()}|{summary.getLength()}|{summary.getFileCount()}|{status.getModificationTime()}"
    return hashlib.sha1(raw.encode()).hexdigest()[:16]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath))


# ---------------------------------------------------------------- SQL twin (oracle side)

def _sql_noise(k: int) -> str:
    kk, a, b, m = NOISE_PARAMS[k - 1]
    return (
        f"(CAST(((l_orderkey*{a} + CAST(l_linenumber AS BIGINT)*{b} + l_partkey*{kk}) % {m}) AS DOUBLE)"
        f" / CAST({m} AS DOUBLE) * CAST({NOISE_SCALE} AS DOUBLE) - CAST({NOISE_SHIFT} AS DOUBLE))"
    )


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def panel_sql(*, extended: bool = False, with_row_id: bool = False) -> str:
    """SELECT text that rebuilds the panel from a ``lineitem`` view."""
    m = "(l_orderkey % 4)"
    q = f"((l_quantity - {_dbl(Q_CENTER)}) / {_dbl(Q_SCALE)})"
    d = f"((l_discount - {_dbl(D_CENTER)}) / {_dbl(D_SCALE)})"
    t = f"((l_tax - {_dbl(T_CENTER)}) / {_dbl(T_SCALE)})"
    fa = q
    fb = f"(CASE WHEN {m} = 3 THEN {d} ELSE {_dbl(0.5)} * {q} + {_dbl(0.866)} * {d} END)"
    fc = f"({_dbl(0.4)} * {fa} + {_dbl(0.3)} * {fb} + {_dbl(0.794)} * {t})"
    s = f"(CASE WHEN {m} = 2 THEN {_dbl(0.5)} ELSE {_dbl(1.0)} END)"
    factor = {"fa": fa, "fb": fb, "fc": fc}
    tech = "CASE " + " ".join(f"WHEN {m} = {i} THEN '{x}'" for i, x in enumerate(TECHNIQUES)) + " END"
    cols = [f"{tech} AS technique", f"CAST(CASE WHEN {m} = 0 THEN 0 ELSE l_partkey % 3 + 1 END AS INTEGER) AS replicate"]
    if with_row_id:
        cols.append(f"CAST(row_number() OVER (ORDER BY {', '.join(ROW_KEY)}) AS BIGINT) AS row_id")
    for name, f, lam, uniq, k in INDICATORS:
        val = f"{s} * {_dbl(lam)} * {factor[f]} + {_dbl(uniq)} * {_sql_noise(k)}"
        if extended and name == "a2":
            val = f"CASE WHEN l_orderkey % {MISSING_MOD} = {MISSING_REM} THEN NULL ELSE {val} END"
        cols.append(f"{val} AS {name}")
    if not extended:
        return "SELECT " + ",\n  ".join(cols) + "\nFROM lineitem"
    cols += ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"]
    base = "SELECT " + ",\n  ".join(cols) + "\nFROM lineitem"
    rid = ", row_id" if with_row_id else ""
    body = (
        "technique, replicate{rid}, a1, a2, a3, b1, b2, b3, c1, c2, c3, l_returnflag, l_linestatus, l_linenumber, "
        "CAST(floor(a1 + 3) AS INTEGER) AS o1, CAST(floor(b1) AS INTEGER) AS sens"
    ).format(rid=rid)
    copy_body = body.replace("technique, replicate", "'SYN_COPY' AS technique, CAST(l_orderkey % 3 + 1 AS INTEGER) AS replicate", 1)
    return (
        f"SELECT {body} FROM ({base}) px\nUNION ALL\n"
        f"SELECT {copy_body} FROM ({base}) px WHERE technique = 'REAL' AND l_orderkey % {COPY_MOD} = 0"
    )


def with_panel(sql: str, ctes: list[tuple[str, str]] = (), *, extended: bool = False,
               with_row_id: bool = False, name: str = "panel") -> str:
    """Oracle query text: the panel and further named CTEs, then ``sql``."""
    parts = [(name, panel_sql(extended=extended, with_row_id=with_row_id)), *ctes]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{q}\n)" for n, q in parts) + "\n" + sql
