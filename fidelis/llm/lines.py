"""Line dedup by a suffix array over line numbers, built by distributed prefix doubling.

Documents in the order (doc_id, text hash) are sequences of lines; lines without a word are
skipped and always kept.  A suffix is named by the position of the first suffix that begins
with the same lines, so names are exact and show where the earlier copy is.  Doubling: the
names for 2k lines are the classes of the pairs (name of k lines here, name of k lines k
further on).  Suffixes alone in their class leave, so every round works on repeated runs
only.  From the classes, the longest prefix that a suffix shares with another (the value of
its LCP interval) is found by adding powers of two downwards.

A line is deleted when it lies in a run of at least ``MIN_LINES`` lines that also begins at
an earlier position; runs are judged on the input.  From one line on, every later copy of a
line goes, whatever its length: one-line copies of documents and boilerplate lines too.

Only DataFrame functions are used.  A position is one long: document number and line.
Defined cases: null and empty texts have no lines; rows repeated in full are one document
and get the same result; a null doc_id comes first; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import materialise
from fidelis.operators.order import with_row_index

MIN_LINES = 1
LINE_BITS = 28  # lines of a document; 2**35 documents


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def sequences(docs: DataFrame) -> DataFrame:
    """Different documents in order: doc, doc_id, _th, lines (pairs of line hashes)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), _lines(F.col("text")).alias("_l"))
    hashed = rows.select(
        "doc_id", "_th", F.transform("_l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("lines"))
    return with_row_index(hashed.dropDuplicates(["doc_id", "_th"]), ["doc_id", "_th"], "doc")


def _classes(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(p, name) of the suffixes that share ``keys`` with another; name is the first one's p."""
    shared = materialise(
        rows.groupBy(*keys).agg(F.min("p").alias("_first"), F.max("p").alias("_last")).filter("_last > _first").drop("_last"), name)
    return rows.join(shared, keys).select("p", F.col("_first").alias("name"))


def _further(names: DataFrame, at: Column, by: DataFrame) -> DataFrame:
    """``names`` (p, ...) with ``next``, the name in ``by`` of the position ``at`` of the same document."""
    ahead = by.select(F.col("p").alias("_q"), F.col("name").alias("next"))
    # at stays within the document: positions of different documents are 2**LINE_BITS apart
    return names.withColumn("_q", at).join(ahead, "_q").drop("_q")


def suffix_classes(seqs: DataFrame) -> list[DataFrame]:
    """Per k = 1, 2, 4, ...: (p, name) of the suffixes whose first k lines occur elsewhere too."""
    rows = seqs.select("doc", F.posexplode("lines").alias("pos", "line")).select(
        (F.shiftleft(F.col("doc"), LINE_BITS) + F.col("pos")).alias("p"), "line.a", "line.b")
    levels = [materialise(_classes(materialise(rows, "lines"), ["a", "b"], "line-names"), "level")]
    k = 1
    while not levels[-1].isEmpty():
        pairs = _further(levels[-1], F.col("p") + k, levels[-1])
        levels.append(materialise(_classes(materialise(pairs, "pairs"), ["name", "next"], "pair-names"), "level"))
        k *= 2
    return levels[:-1]


def shared_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(p, lcp): lines that the suffix p shares with the suffix most like it, at least one."""
    if not levels:
        raise ValueError("no repeated line")
    # start from the highest level a suffix has, then try the powers of two below it
    top = None
    for i, level in enumerate(levels):
        rows = level.select("p", F.lit(i).alias("i"), "name")
        top = rows if top is None else top.unionByName(rows)
    best = materialise(
        top.groupBy("p").agg(F.max(F.struct("i", "name")).alias("t"))
        .select("p", F.col("t.i").alias("top"), F.expr("CAST(1 AS BIGINT) << t.i").alias("lcp"), F.col("t.name").alias("name")), "lcp")
    for i in range(len(levels) - 2, -1, -1):
        below = best.filter(F.col("top") > i)
        tried = _further(below, F.col("p") + F.col("lcp"), levels[i])
        grown = materialise(
            tried.groupBy("lcp", "name", "next").agg(F.min("p").alias("first"), F.max("p").alias("_last")).filter("_last > first").drop("_last"),
            "lcp-grown")
        longer = tried.join(grown, ["lcp", "name", "next"]).select("p", "first")
        best = materialise(
            best.join(longer, "p", "left").select(
                "p", "top", (F.col("lcp") + F.when(F.col("first").isNotNull(), F.lit(1 << i)).otherwise(0)).alias("lcp"),
                F.coalesce("first", "name").alias("name")), "lcp")
    return best.select("p", "lcp")


def later_copies(levels: list[DataFrame], min_lines: int = MIN_LINES) -> DataFrame:
    """(p) of suffixes whose first ``min_lines`` lines begin at an earlier position too."""
    i = min_lines.bit_length() - 1
    if i >= len(levels):
        return levels[0].filter("false").select("p")
    rest = min_lines - (1 << i)
    if not rest:
        return levels[i].filter("name < p").select("p")
    pairs = _further(levels[i], F.col("p") + rest, levels[i])
    return _classes(materialise(pairs, "pairs"), ["name", "next"], "pair-names").filter("name < p").select("p")


def deleted_lines(levels: list[DataFrame], min_lines: int = MIN_LINES) -> DataFrame:
    """(doc, pos) of the lines to delete; pos counts lines with a word from 0."""
    p = F.col("p")
    lines = later_copies(levels, min_lines).select(F.explode(F.sequence(p, p + (min_lines - 1))).alias("p")).distinct()
    return lines.select(F.shiftright("p", LINE_BITS).alias("doc"), p.bitwiseAND((1 << LINE_BITS) - 1).cast("int").alias("pos"))


def deduplicate(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_deleted, n_runs (deleted stretches), longest_shared (longest run of
    lines of the document that occurs elsewhere), kept_text (null for a null text)."""
    seqs = sequences(docs)
    levels = suffix_classes(seqs)
    sized = seqs.select("doc", "doc_id", "_th")
    if levels:
        gone = deleted_lines(levels, min_lines).groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("_gone"))
        shared = shared_prefixes(levels).groupBy(F.shiftright("p", LINE_BITS).alias("doc")).agg(F.max("lcp").alias("_shared"))
        sized = sized.join(gone, "doc", "left").join(shared, "doc", "left")
    else:
        sized = sized.withColumns({"_gone": F.lit(None).cast("array<int>"), "_shared": F.lit(None).cast("long")})
    key = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("_th") == F.col("_h")]
    found = sized.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), "_gone", "_shared")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_th")).join(found, key[0] & key[1], "left")
    return _without(rows)


def _without(rows: DataFrame) -> DataFrame:
    """Cut the lines numbered in _gone out of text."""
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    n = F.coalesce(F.size("_gone"), F.lit(0))
    df = rows.withColumn("_all", split).withColumn("n_lines", F.size(_lines(F.col("text"))).cast("long"))
    df = df.withColumn("n_deleted", F.when(F.col("_gone").isNull(), 0).otherwise(n).cast("long"))
    # numbers of lines with a word, at their places among all lines
    worded = F.filter(F.transform("_all", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    df = df.withColumn("_worded", F.when(F.col("n_deleted") > 0, worded))
    df = df.withColumn("_places", F.when(F.col("n_deleted") > 0, F.transform("_gone", lambda g: F.get(F.col("_worded"), g))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_places"))
    df = df.withColumn("_stay", F.when(F.col("n_deleted") > 0, stay))
    kept = F.transform("_stay", lambda i: F.get(F.col("_all"), i))
    runs = F.size(F.filter("_gone", lambda g, i: (i == 0) | (F.get(F.col("_gone"), F.greatest(i - 1, F.lit(0))) != g - 1)))
    return df.select(
        "doc_id", "n_lines", "n_deleted", F.when(F.col("n_deleted") > 0, runs).otherwise(0).cast("long").alias("n_runs"),
        F.coalesce("_shared", F.lit(0)).cast("long").alias("longest_shared"),
        F.when(F.col("n_deleted") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("kept_text"))


def line_report(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """As ``deduplicate``, with kept_sha256 in place of the text."""
    df = deduplicate(docs, min_lines)
    return df.select("doc_id", "n_lines", "n_deleted", "n_runs", "longest_shared",
                     F.sha2(F.coalesce(F.col("kept_text"), F.lit("")), 256).alias("kept_sha256"))
