"""SimHash near-dedup by a byte-position inverted index with count filtering.

Fingerprints: 3-word shingles of the ASCII-lower-cased words, hashed with XXH64 (seed 42);
a bit is set when it is set in over half the hashes.  Fingerprints within ``MAX_BITS`` = 3
bits differ in at most three of their eight bytes, so two linked fingerprints share at
least five positional bytes.  Lists keyed by one positional byte would pair a 256th of the
corpus with itself; the index therefore keeps a list for every choice of five positions
(56 lists a fingerprint), whose members have reached the guaranteed count by sharing one
list, and no list can hold more than 2**24 different fingerprints.  Members of a list
are verified exactly: all pairs in short lists, and in long ones by looking up each of the
2,324 ways to flip up to three of the 24 free bits, so a list of near copies costs time in
proportion to its length.  Each list returns a star for every group it finds, never its
pairs; stars are joined into components by alternating large-star and small-star rounds.

Exact copies are one entry of the index.  Defined cases: null and empty texts have
fingerprint zero and link like any other; a null doc_id never is the smallest, and a
component of null ids only has component_id null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import materialise

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BYTES = 8
SHARED = BYTES - MAX_BITS  # positional bytes that linked fingerprints share at least
FREE_BITS = 8 * MAX_BITS
ALL_PAIRS = 1_000  # lists up to this length are compared pair by pair
BLOCK = 65_536  # shingles that are counted at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    tokens = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII blanks
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    stops = ends[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + BLOCK], stops[i:i + BLOCK], strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n - shingle + 1).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _with_fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            prints = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            signed = np.array(prints, np.uint64).view(np.int64)
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
            names = [name for name in batch.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(signed)], [*names, "_fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _th (hash of the text), _fp of every row, written to the shared folder."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_text"))
    schema = rows.drop("_text").withColumn("_fp", F.lit(0).cast("long")).schema
    return materialise(rows.mapInArrow(_with_fingerprints(shingle), schema), "simhash")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fingerprint and choice of positions: key (choice, shared bytes) and fingerprint."""
    choices = list(combinations(range(BYTES), SHARED))
    for batch in batches:
        prints = batch.column("_fp").to_numpy(zero_copy_only=False)
        parts = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BYTES).astype(np.int64)
        for number, positions in enumerate(choices):
            key = np.full(len(prints), number, np.int64)
            for p in positions:
                key = (key << 8) | parts[:, p]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints)], ["key", "fp"])


def _flips() -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for n in range(1, MAX_BITS + 1) for bits in combinations(range(FREE_BITS), n)], np.int64)


class _Roots:
    """Smallest linked index of each of n items, from arrays of links."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while (shorter := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = shorter


def link_list(prints: np.ndarray, choice: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fingerprint, smallest of its group) of one list of different, sorted fingerprints."""
    n = len(prints)
    roots = _Roots(n)
    if n <= ALL_PAIRS:
        a, b = np.nonzero(np.triu(np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= MAX_BITS, 1))
        roots.link(a, b)
    else:
        positions = list(combinations(range(BYTES), SHARED))[choice]
        parts = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BYTES).astype(np.int64)
        free = np.zeros(n, np.int64)
        for p in range(BYTES):
            if p not in positions:
                free = (free << 8) | parts[:, p]
        where = np.full(1 << FREE_BITS, -1, np.int32)
        where[free] = np.arange(n, dtype=np.int32)
        for flip in _flips():
            found = where[free ^ flip]
            a = np.nonzero(found >= 0)[0]
            roots.link(a, found[a])
    moved = roots.of != np.arange(n)
    return prints[moved], prints[roots.of[moved]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links of the lists of a partition sorted by key; only the list at a batch's end is carried over."""

    def lists(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate(([0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]))
        sizes = np.diff(cuts)
        a, b = [], []
        two = cuts[:-1][sizes == 2]
        x, y = prints[two], prints[two + 1]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_BITS
        a.append(np.maximum(x, y)[near])
        b.append(np.minimum(x, y)[near])
        for i in np.nonzero(sizes > 2)[0]:
            more = link_list(np.sort(prints[cuts[i]:cuts[i + 1]]), int(keys[cuts[i]]) >> (8 * SHARED))
            a.append(more[0])
            b.append(more[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    keys, prints = [], []
    for batch in batches:
        k, p = batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        keys.append(k)
        prints.append(p)
        if k[0] == k[-1]:
            continue  # one long list goes on
        k, p = np.concatenate(keys), np.concatenate(prints)
        last = np.searchsorted(k, k[-1])
        yield from lists(k[:last], p[:last])
        keys, prints = [k[last:]], [p[last:]]
    if keys:
        yield from lists(np.concatenate(keys), np.concatenate(prints))


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a > b): root is the smallest node reachable."""
    links = materialise(links.distinct(), "stars")
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a != b").distinct()
        )
        after = materialise(small, "stars")
        done = after.count() == links.count() and after.join(links, ["a", "b"], "left_anti").isEmpty()
        links = after
        if done:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(prints: DataFrame) -> DataFrame:
    """Per fingerprint: _fp, _root (names the component), component_id (smallest doc_id reachable)."""
    spark = prints.sparkSession
    entries = materialise(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "simhash-entries")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = entries.select("_fp").repartition(n).mapInArrow(_postings, "key long, fp long")
    links = index.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")
    roots = star_components(links)
    rooted = materialise(
        entries.join(roots, F.col("_fp") == F.col("node"), "left")
        .select("_fp", "_least", F.coalesce("root", "_fp").alias("_root")), "simhash-roots")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return rooted.join(least, "_root").select("_fp", "_root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = fingerprints(docs, shingle)
    found = materialise(components(prints), "simhash-components")
    # a hot fingerprint is one row on the right; its rows on the left are split by adaptive execution
    return prints.join(found, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for every component, that of the smallest doc_id; columns unchanged.

    Of several rows with that doc_id in one component, that of the smallest text hash stays.
    """
    prints = fingerprints(docs, shingle)
    found = materialise(components(prints), "simhash-components")
    least = prints.join(found, "_fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialise(
        least.groupBy("_root").agg(F.min(F.struct("doc_id", "_th")).alias("_k")).select(_name(F.col("_k.doc_id")), "_k._th"),
        "simhash-kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(_name(F.col("doc_id")), F.xxhash64("text").alias("_th"), row)
    # join and dropDuplicates share one shuffle of the texts
    return rows.join(kept, ["_name", "_th"], "left_semi").dropDuplicates(["_name", "_th"]).select("_row.*")


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null")).alias("_name")
