"""Benchmark decontamination by greedy string tiling.

Texts become lower-case words without punctuation.  Every run of ``TILE`` words of a
benchmark item is a seed; seeds are found in the documents by a rolling (Karp-Rabin) hash
over word numbers and compared word by word.  For each document and item with a common
seed, the longest common run is marked again and again, none overlapping a marked one,
until none of ``TILE`` words is left.  The document is contaminated when the marked tiles
cover at least ``COVERAGE`` of an item's words, so a reordered passage is caught too.

A stem that many items share costs one pass over sorted arrays: how far its seeds cover an
item is counted first, and places are paired only for items that the seeds can cover enough.

The benchmark is a query set: it is read in blocks of at most ``BLOCK_WORDS`` words, each
broadcast and held against all documents in one pass without a shuffle.  Items of one
text (case aside) are held once, under their smallest item_id.  Memory is one block, as
sorted arrays built once per Python worker, and one batch; a block is finished before the next.

Defined cases: null and empty texts are clean; items without words are left out; items
shorter than ``TILE`` words are sought whole; an empty table on either side flags nothing;
a null doc_id is judged like any other; rows repeated in full share one verdict; a very long
text is held whole by its task; other columns, whatever their names, pass through
``keep_clean`` unchanged.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fidelis.llm.common import materialise

TILE = 5
COVERAGE = 0.6
BLOCK_WORDS = 2_000_000

_DROP = re.compile(r"[^\w\s]+")
_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash


def word_list(text: str | None) -> list[str]:
    return _DROP.sub("", (text or "").lower()).split()


class Items:
    """Seeds of a block of benchmark items, as arrays sorted by hash."""

    def __init__(self, items: list[tuple[object, str]], tile: int = TILE):
        self.number: dict[str, int] = {}
        self.names, parts = [], []
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in word_list(text)]
            if ids:
                self.names.append(item)
                parts.append(np.array(ids, np.int32))
        self.length = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        sizes = np.minimum(self.length, tile)
        #: per seed size: different hashes, where their places begin, places (positions in flat)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes).tolist():
            of = np.nonzero(sizes == size)[0]
            at = _ranges(self.first[of], self.length[of] - size + 1).astype(np.int32)
            h = rolling(self.flat, size)[at]
            order = np.argsort(h, kind="stable")
            hashes, begin = np.unique(h[order], return_index=True)
            self.seeds[size] = hashes, np.append(begin, len(h)), at[order]

    def hits(self, text: str, least: float = 0.0) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
        """Seed size, item positions and text positions of the common seeds, per number of an item that they cover by ``least``."""
        tokens = word_list(text)
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        found = {}
        for size, (hashes, begin, places) in self.seeds.items():
            if len(ids) < size:
                continue
            h = rolling(ids, size)
            seed = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            there = np.nonzero(hashes[seed] == h)[0]
            there = there[np.argsort(seed[there], kind="stable")]
            seeds, start, times = np.unique(seed[there], return_index=True, return_counts=True)
            if not len(seeds):
                continue
            n = begin[seeds + 1] - begin[seeds]
            at = places[_ranges(begin[seeds], n)].astype(np.int64)
            order = np.argsort(at)
            at, which = at[order], np.repeat(np.arange(len(seeds)), n)[order]
            item = np.searchsorted(self.first, at, "right") - 1
            cuts = np.nonzero(np.diff(item, prepend=-1))[0]
            # words that the seeds cover: of each place those before the next one of the item
            reach = np.minimum(np.diff(at, append=at[-1] + size), size)
            reach[np.append(cuts[1:], len(at)) - 1] = size
            enough = np.add.reduceat(reach, cuts) >= least * self.length[item[cuts]]
            keep = np.repeat(enough, np.diff(np.append(cuts, len(at))))
            at, which, item = at[keep], which[keep], item[keep]
            # pair the places in items with those in the text, and compare words
            i, item = np.repeat(at, times[which]), np.repeat(item, times[which])
            j = there[_ranges(start[which], times[which])]
            same = np.ones(len(i), bool)
            for k in range(size):
                same &= self.flat[i + k] == ids[j + k]
            i, j, item = i[same], j[same], item[same]
            if not len(item):
                continue
            cuts = np.nonzero(np.diff(item, prepend=-1))[0]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)], strict=True):
                found[int(item[a])] = size, i[a:b] - self.first[item[a]], j[a:b]
        return found


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + n[0] - 1, first[1], ..."""
    total = int(n.sum())
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` numbers, modulo 2**64."""
    h = np.zeros(len(ids) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint64(_BASE) + ids[k:len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(2)
    return h


def tiles(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, text position, length) from the common seeds of ``size`` words."""
    heap = []
    diagonals: dict[int, list[int]] = defaultdict(list)
    for i, j in hits:
        diagonals[j - i].append(i)
    for shift, starts in diagonals.items():
        starts.sort()
        first = last = starts[0]
        for i in [*starts[1:], None]:
            if i is not None and i == last + 1:
                last = i
                continue
            heap.append((-(last - first + size), first, first + shift))
            if i is not None:
                first = last = i
    heapify(heap)
    item_marks, text_marks, out = set(), set(), []
    while heap:
        minus, i, j = heappop(heap)
        free = [i + k not in item_marks and j + k not in text_marks for k in range(-minus)]
        if all(free):
            out.append((i, j, -minus))
            item_marks.update(range(i, i - minus))
            text_marks.update(range(j, j - minus))
            continue
        start = None
        for k, ok in enumerate([*free, False]):  # what is left unmarked may still be long enough
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= size:
                    heappush(heap, (start - k, i + start, j + start))
                start = None
    return out


def covered(items: Items, text: str | None, least: float = COVERAGE) -> list[tuple[int, float, int]]:
    """(item, coverage, tiles) of the items that a text covers by at least ``least``."""
    if not text:
        return []
    out = []
    for number, (size, at, there) in items.hits(text, least).items():
        length = int(items.length[number])
        laid = tiles(list(zip(at.tolist(), there.tolist(), strict=True)), size)
        share = sum(n for _, _, n in laid) / length
        if share >= least:
            out.append((items.names[number], share, len(laid)))
    return sorted(out)


_BUILT: dict[str, Items] = {}


def _items(key: str, shared: Broadcast) -> Items:
    """The seeds of a broadcast block, built once per Python worker; the block before is let go."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(shared.value)
    return _BUILT[key]


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items of different words in blocks of bounded size, read one partition after the other."""
    text = F.lower(F.trim(F.coalesce(F.col("text"), F.lit(""))))
    one = benchmark.groupBy(text.alias("_t")).agg(F.min("item_id").alias("item_id")).filter("_t != ''")
    block, size = [], 0
    for row in materialise(one, "benchmark").toLocalIterator():
        n = len(row["_t"].split())
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["_t"]))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """Contaminated documents only: doc_id, items (ids), n_items, coverage and n_tiles of the best covered."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", kind), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType())])
    item_type = to_arrow_type(kind)
    out = None
    for block in item_blocks(benchmark):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            items = _items(key, shared)
            for batch in batches:
                rows = [(k, *hit) for k, text in enumerate(batch.column("text")) for hit in covered(items, text.as_py(), least)]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), pa.array([r[1] for r in rows], item_type),
                     pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32())],
                    ["doc_id", "item_id", "coverage", "n_tiles"])

        part = materialise(docs.select("doc_id", "text").mapInArrow(run, schema), "contaminated")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.countDistinct("item_id").alias("n_items"),
        F.max("coverage").alias("coverage"), F.max(F.struct("coverage", "n_tiles"))["n_tiles"].alias("n_tiles"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that cover no item; columns unchanged."""
    spark, first = docs.sparkSession, True
    for block in item_blocks(benchmark):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            items = _items(key, shared)
            for batch in batches:
                clean = [not covered(items, text.as_py(), least) for text in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = (docs if first else materialise(docs, "decontaminated")).mapInArrow(run, docs.schema)
        first = False
    return docs
