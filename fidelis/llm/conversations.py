"""Repair of conversation structure by weighted CYK interval parsing.

A good conversation's role initials are ``(s?(ua)+)?``.  Its grammar in Chomsky normal form
has a nonterminal N_pq for every two states of the role pattern (start, after s, after u,
after a): N_pq derives what leads from p to q, N_pq -> N_pr N_rq, and a row derives N_pq by
Keep, Rerole or Delete.  An inserted row derives N_pq from nothing; the cheapest chains of
insertions (the insertion closure) are taken into every cell, before and after its span.  A
cell holds the least (cost, audit) of its span; equally dear audits of one span never begin
with one another (they differ in letters that consume rows, or in cost), so the least of
the parts gives the least of the whole.

Rows become symbols: what Keep would derive, crossed with the fault.  A conversation is cut
into blocks of ``BLOCK`` rows.  A block's chart is filled by span length, every split of every
span; equal blocks are parsed once.  Blocks are then combined bottom-up, spans of two, four,
eight ... blocks: N_pq is closed under splitting at any row, so all splits of a span give the
same cell and one is enough.  No task holds more than two cells of a long conversation, and a
conversation with a third of all rows is spread over its blocks until its last levels.

Only the final text is sequential (a hash over the whole conversation): rows stream through
one task in order behind their audit, and nothing but the state is held.

Defined cases: null role or text is one space, a null conv_id is a conversation of its own;
an empty role has no initial and is never kept; equal turns are ordered by role, then text;
rows repeated in full are rows of their own (the later ones duplicates); an empty table
gives an empty result; other columns are not read; texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.llm.common import materialise
from fidelis.operators.order import with_row_index

BLOCK = 12  # rows of a block
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States of the role pattern: start, after s, after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
STATES = range(4)

_VISIBLE = r"[^\x20\x09-\x0D]"

Cell = dict[tuple[int, int], tuple[int, str]]


def product(left: Cell, right: Cell) -> Cell:
    """N_pq -> N_pr N_rq: the least (cost, audit) of both parts."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            if (r, q) in right:
                more, rest = right[r, q]
                found = (cost + more, audit + rest)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _least(a: Cell, b: Cell) -> Cell:
    return {k: min(x for x in (a.get(k), b.get(k)) if x is not None) for k in a.keys() | b.keys()}


def insertion_closure() -> Cell:
    """Cells of the empty span: the cheapest chain of insertions between any two states."""
    closed: Cell = {(p, p): (0, "") for p in STATES}
    single = {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role in ROLES}
    while (grown := _least(closed, product(closed, single))) != closed:
        closed = grown
    return closed


EMPTY = insertion_closure()


def row_cell(symbol: str) -> Cell:
    """Cells of one row; symbol: d (must go), or s/u/a/x (its initial, x: another), upper case if truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != "d":
        extra = TRUNCATED if symbol.isupper() else 0
        for (p, role), q in STEPS.items():
            if role in ROLES:
                cell[p, q] = (REROLE + extra, "R")
            if role == symbol.lower():
                cell[p, q] = (extra, "K")
    return product(product(EMPTY, cell), EMPTY)


def block_cell(symbols: str) -> Cell:
    """Cells of a block: the chart over all spans by length, the least over every split."""
    if not symbols:
        return EMPTY
    n = len(symbols)
    chart = {(i, 1): row_cell(s) for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(1, length):
                cell = _least(cell, product(chart[i, k], chart[i + k, length - k]))
            chart[i, length] = cell
    return chart[0, n]


CELL_TYPE = T.ArrayType(T.StructType([
    T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()),
    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def _pack(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in sorted(cell.items())]


def _unpack(items) -> Cell:
    return {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in items}


@F.pandas_udf(CELL_TYPE)
def _parse_block(symbols: pd.Series) -> pd.Series:
    return symbols.map(lambda s: _pack(block_cell(s)))


@F.pandas_udf(CELL_TYPE)
def _combine(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_pack(product(_unpack(a), _unpack(b))) for a, b in zip(left, right)], dtype=object)


# ------------------------------------------------------------------ rows


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with null role and text as one space, damaged by crc32(conv_id:turn) % 20."""
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    how = F.crc32(key.cast("binary")) % 20
    rows = plain(turns).withColumn("_how", how).filter("_how != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def plain(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def numbered(turns: DataFrame) -> DataFrame:
    """``plain`` rows in conversation order: conv, conv_id, turn, pos, role, text, fault, initial.

    ``conv`` numbers conversations by the place of their first row.  Numbering is a range sort
    over all rows, so a long conversation is spread like any other rows.
    """
    rows = plain(turns)
    order = ["conv_id", "turn", "role", "text", "_n"]
    rows = rows.withColumn("_n", F.monotonically_increasing_id())  # tells rows repeated in full apart
    rows = with_row_index(rows, order, "_at").drop("_n")
    rows = rows.withColumn("_hash", F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256))
    first = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.min("_at").alias("conv"))
    # the same role and text earlier in the conversation: the first place of each, joined back
    seen = rows.groupBy(F.col("conv_id").alias("_s"), F.col("_hash").alias("_h")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"))
    seen = seen.filter("_m > 1").drop("_m")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")))
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_h")), "left")
    fault = F.when(~F.col("text").rlike(_VISIBLE), "blank").when(F.col("_at") > F.col("_first"), "duplicate") \
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return rows.select("conv", "conv_id", "turn", (F.col("_at") - F.col("conv")).alias("pos"), "role", "text",
                       F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _symbol() -> Column:
    keep = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(keep)).otherwise(keep)


def parse(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of ``numbered`` rows, per conv: cost and audit of the cheapest repair, n_illegal (adjacent initials not su, ua, au)."""
    numbered_block = rows.select("conv", F.floor(F.col("pos") / block).alias("blk"), "pos", "initial", _symbol().alias("sym"))
    seq = F.array_sort(F.collect_list(F.struct("pos", "sym", "initial")))
    blocks = numbered_block.groupBy("conv", "blk").agg(seq.alias("_s")).select(
        "conv", "blk", F.array_join(F.transform("_s", lambda x: x["sym"]), "").alias("symbols"),
        F.transform("_s", lambda x: x["initial"]).alias("_i"))
    pair_bad = lambda a, b: (~F.concat(a, b).isin("su", "ua", "au")).cast("long")
    inside = F.aggregate(
        F.zip_with(F.slice("_i", F.lit(1), F.greatest(F.size("_i") - 1, F.lit(0))), F.slice("_i", F.lit(2), F.greatest(F.size("_i") - 1, F.lit(0))), pair_bad),
        F.lit(0).cast("long"), lambda s, x: s + x)
    blocks = materialise(blocks.select(
        "conv", "blk", "symbols", F.get("_i", F.lit(0)).alias("first"), F.element_at("_i", -1).alias("last"), inside.alias("n_illegal")), "blocks")
    # equal blocks have equal cells: each is parsed once
    different = blocks.select("symbols").distinct()
    spread = int(different.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)  # few bytes, much work: not to be coalesced
    # by a hash of the symbols: by the symbols themselves it would be the partitioning of the distinct step, and left out
    cells = materialise(different.repartition(spread, F.xxhash64("symbols")).withColumn("cell", _parse_block("symbols")), "cells")
    spans = blocks.join(cells, "symbols").drop("symbols")
    whole = None
    while True:
        spans = materialise(spans, "spans")
        size = spans.groupBy("conv").agg(F.max("blk").alias("_top"))
        done = spans.join(size.filter("_top = 0").select("conv"), "conv", "left_semi")
        whole = done if whole is None else whole.unionByName(done)
        rest = spans.join(size.filter("_top > 0").select("conv"), "conv", "left_semi")
        if rest.isEmpty():
            break
        # spans twice as long: an even block with the odd one after it
        even = rest.filter("blk % 2 = 0").select("conv", F.shiftright("blk", 1).alias("blk"), "first", "last", "n_illegal", "cell")
        odd = rest.filter("blk % 2 = 1").select("conv", F.shiftright("blk", 1).alias("blk"), *[F.col(c).alias(f"_{c}") for c in ("first", "last", "n_illegal", "cell")])
        both = even.join(odd, ["conv", "blk"], "left")
        paired = both.filter("_cell IS NOT NULL").select(
            "conv", "blk", "first", F.col("_last").alias("last"),
            (F.col("n_illegal") + F.col("_n_illegal") + pair_bad(F.col("last"), F.col("_first"))).alias("n_illegal"),
            _combine("cell", "_cell").alias("cell"))
        spans = paired.unionByName(both.filter("_cell IS NULL").select("conv", "blk", "first", "last", "n_illegal", "cell"))
    ends = F.array_min(F.transform(
        F.filter("cell", lambda x: (x["p"] == 0) & x["q"].isin(*ACCEPTED)), lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    return whole.select("conv", "n_illegal", ends.alias("_best")).select("conv", "n_illegal", "_best.cost", "_best.audit")


# ------------------------------------------------------------------ repaired rows

_REPAIRED = "conv long, seq long, edit string, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, pos, role, text) in order, each conversation led by its audit (pos -1): the repaired rows."""
    conv, audit, at, seq, state = None, "", 0, 0, 0
    out: list[tuple] = []

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal seq, state
        state = STEPS[state, role[:1]]
        out.append((conv, seq, edit, role, text))
        seq += 1

    def insert() -> None:
        nonlocal at
        while audit[at:at + 1] == "I":
            at += 1
            emit("I", wanted(), "")

    def wanted() -> str:
        return ROLES["a" if state == 2 else "u"]

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        out.clear()
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv", "seq", "edit", "role", "text"])

    for b in batches:
        for c, pos, role, text in zip(*(b.column(name) for name in ("conv", "pos", "role", "text"))):
            if pos.as_py() < 0:
                conv, audit, at, seq, state = c.as_py(), text.as_py(), 0, 0, 0
                insert()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                emit(edit, role.as_py() if edit == "K" else wanted(), text.as_py())
            insert()
        yield batch()


def repair(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Repaired rows of ``numbered`` rows: conv, seq, edit (K, R or I), role, text.

    Partitioned by conv and in order within each partition.
    """
    heads = parsed.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = heads.unionByName(rows.select("conv", "pos", "role", "text"))
    return stream.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_apply, _REPAIRED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's ``role:text`` lines; rows come in order."""
    conv, digest = None, None
    for b in batches:
        ids, hashes = [], []
        for c, role, text in zip(*(b.column(name) for name in ("conv", "role", "text"))):
            c = c.as_py()
            if c != conv:
                if digest is not None:
                    ids.append(conv)
                    hashes.append(digest.hexdigest())
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv", "repaired_sha256"])


def repair_report(turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``turns`` after ``damage``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = materialise(numbered(damage(turns)), "numbered-turns")
    parsed = materialise(parse(rows), "parsed")
    hashes = repair(rows, parsed).mapInArrow(_digest, "conv long, repaired_sha256 string")
    # distinct turns first, so that a long conversation is counted in parts
    spread = rows.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("_1")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    counts = rows.groupBy("conv").agg(
        F.first("conv_id").alias("_id"), *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    found = counts.join(parsed, "conv").join(spread, "conv", "left").join(hashes, "conv", "left")
    ids = turns.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")],
        F.coalesce("n_illegal", zero).alias("illegal"), F.coalesce("cost", zero).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
