"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all rows of one text (null counts as empty) and stays in one shard.  Sizes are
UTF-8 bytes plus ``ROW_BYTES`` per row.  Every group is packed: groups sorted by size enter
the bin with the tightest remaining capacity that holds them, found in a balanced tree of
bins; the capacity is the least one, searched by bisection, that needs no more than the
given shards.  A group larger than an even share gets a shard of its own.

Groups of one size are interchangeable, and the tightest bin stays the tightest until it is
full for that size, so packing runs over (size, number of groups) and gives each size its
runs (bin, how many groups).  The driver holds one row a size: different sizes add up to no
more than the bytes of the table, so there are at most sqrt(2 * bytes) of them.  A group
finds its bin by its number within its size, counted per (size, hash bucket) and added up,
so a size that many groups share is not one task.  Rows meet their group's bin on the text's
hash; groups with at least 1 / ``HOT`` of the rows (no more than HOT groups) are salted.

Defined cases: null text counts as empty; rows repeated in full get slots of their own; an
empty table gives an empty result; a very long text is one group like any other; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import lookup_join, materialise

ROW_BYTES = 8
SHARDS = 24
HOT = 2048
SALTS = 32
# groups are numbered within (size, hash bucket) and slots within (shard, hash bucket), buckets one after the other
BUCKETS = 256


class _Node:
    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


def _height(n: _Node | None) -> int:
    return n.height if n else 0


def _rotate(n: _Node, up: str, down: str) -> _Node:
    top = getattr(n, up)
    setattr(n, up, getattr(top, down))
    setattr(top, down, n)
    for x in (n, top):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return top


def _balance(n: _Node) -> _Node:
    n.height = 1 + max(_height(n.left), _height(n.right))
    lean = _height(n.left) - _height(n.right)
    if lean > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _rotate(n.left, "right", "left")
        return _rotate(n, "left", "right")
    if lean < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _rotate(n.right, "left", "right")
        return _rotate(n, "right", "left")
    return n


class BinTree:
    """AVL tree of (remaining capacity, bin)."""

    def __init__(self):
        self._root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return _balance(n)

        self._root = put(self._root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        best, n = None, self._root
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        if best is not None:
            self._root = self._drop(self._root, best)
        return best

    def _drop(self, n: _Node, key: tuple[int, int]) -> _Node | None:
        if key < n.key:
            n.left = self._drop(n.left, key)
        elif key > n.key:
            n.right = self._drop(n.right, key)
        elif n.left is None or n.right is None:
            return n.left or n.right
        else:
            least = n.right
            while least.left:
                least = least.left
            n.key = least.key
            n.right = self._drop(n.right, least.key)
        return _balance(n)


Runs = list[list[tuple[int, int]]]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, limit: int | None = None) -> Runs | None:
    """Runs (bin, how many) of each (size, count), largest size first and none above ``capacity``.

    None if more than ``limit`` bins are needed.
    """
    tree, bins, placed = BinTree(), 0, []
    for size, count in sizes:
        runs = []
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if bins == limit:
                    return None
                found, bins = (capacity, bins), bins + 1
            # what is left of this bin is tighter than any other that holds the size
            n = min(count, found[0] // size)
            tree.add((found[0] - n * size, found[1]))
            runs.append((found[1], n))
            count -= n
        placed.append(runs)
    return placed


def pack(sizes: list[tuple[int, int]], shards: int) -> tuple[int, Runs]:
    """Least capacity that needs no more than ``shards``, and the runs (shard, how many) of each (size, count).

    Sizes come largest first.  Groups above an even share of what is left have shards of their own, 0, 1, ...
    """
    total, alone, head, rest = sum(s * n for s, n in sizes), 0, [], list(sizes)
    while rest and alone < shards - 1 and rest[0][0] * (shards - alone) > total:
        size, count = rest[0]
        total -= size
        if head and head[-1][0] == size:
            head[-1][1].append((alone, 1))
        else:
            head.append((size, [(alone, 1)]))
        alone += 1
        rest = [(size, count - 1), *rest[1:]] if count > 1 else rest[1:]
    if not rest:
        return 0, [runs for _, runs in head]
    bins = shards - alone
    low = max(rest[0][0], -(-total // bins))
    step, high = max(1, low // 4096), low
    while (placed := best_fit_decreasing(rest, high, bins)) is None:
        low, high, step = high, high + step, step * 2
    while high - low > max(1, low // 16384):
        mid = (low + high) // 2
        trial = best_fit_decreasing(rest, mid, bins)
        if trial is None:
            low = mid
        else:
            high, placed = mid, trial
    placed = [[(alone + b, n) for b, n in runs] for runs in placed]
    if head and head[-1][0] == rest[0][0]:  # the rest of a size of which some groups are alone
        placed[0] = head.pop()[1] + placed[0]
    return high, [runs for _, runs in head] + placed


def group_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_BYTES).cast("long")


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


class Packing:
    """Shards of the groups of ``keyed`` (_key, size); ``assign`` adds the column _shard."""

    def __init__(self, keyed: DataFrame, shards: int = SHARDS):
        spark = keyed.sparkSession
        groups = materialise(
            keyed.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
            .withColumn("_bucket", _bucket("_key")), "shard-groups")
        counts = materialise(groups.groupBy("_bytes", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "shard-sizes")
        # one row a size, see above
        table = counts.groupBy("_bytes").agg(F.sum("_n").alias("_n")).toPandas().sort_values("_bytes", ascending=False)
        sizes = list(zip(table["_bytes"].tolist(), table["_n"].tolist(), strict=True))
        self.capacity, placed = pack(sizes, shards)
        runs = [(size, list(accumulate(n for _, n in of)), [b for b, _ in of]) for (size, _), of in zip(sizes, placed, strict=True)]
        runs = materialise(spark.createDataFrame(runs, "_bytes long, _ends array<long>, _shards array<int>"), "shard-runs")
        before = counts.withColumn("_before", F.expr(
            "coalesce(sum(_n) OVER (PARTITION BY _bytes ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
        numbered = groups.withColumn("_at", F.expr("row_number() OVER (PARTITION BY _bytes, _bucket ORDER BY _key)") - 1).join(
            before.drop("_n"), ["_bytes", "_bucket"])
        number = F.col("_at") + F.col("_before")
        shard = F.get("_shards", F.size(F.filter("_ends", lambda e: e <= number)))
        self.groups = materialise(
            lookup_join(numbered, runs, ["_bytes"]).select("_key", "_rows", shard.alias("_shard")), "shard-of-group")
        rows = self.groups.agg(F.sum("_rows")).first()[0] or 0
        self.hot = F.col("_rows") >= max(2, -(-rows // HOT))

    def assign(self, keyed: DataFrame) -> DataFrame:
        salts = F.sequence(F.lit(0), F.when(self.hot, SALTS - 1).otherwise(0))
        right = self.groups.select(F.col("_key").alias("_k"), "_shard", F.explode(salts).alias("_s"))
        # at most HOT rows
        hot = F.broadcast(self.groups.filter(self.hot).select(F.col("_key").alias("_h")))
        salt = F.when(F.col("_h").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
        left = keyed.join(hot, F.col("_key") == F.col("_h"), "left").withColumn("_salt", salt)
        return left.join(right, (F.col("_key") == F.col("_k")) & (F.col("_salt") == F.col("_s"))).drop("_h", "_salt", "_k", "_s")


def add_shard(docs: DataFrame, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """``docs`` with the column ``name``; a column of that name in ``docs`` is replaced."""
    packing = Packing(docs.select(group_key(F.col("text")).alias("_key"), _size(F.col("text")).alias("size")), shards)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != name]).alias("_row")
    return packing.assign(docs.select(row, group_key(F.col("text")).alias("_key"))).select(
        "_row.*", F.col("_shard").alias(name))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = materialise(
        docs.select("doc_id", _size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"),
                    group_key(F.col("text")).alias("_key")), "shard-rows")
    placed = materialise(
        Packing(keyed, shards).assign(keyed).withColumn("_bucket", _bucket("doc_id", "_key"))
        .drop("_key"), "shard-placed")
    in_shard = "PARTITION BY _shard ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    # at most shards * BUCKETS rows
    before = placed.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_shard").alias("_s"), F.col("_bucket").alias("_b"),
        F.expr(f"coalesce(sum(_n) OVER ({in_shard}), 0)").alias("_before"))
    slot = F.expr("row_number() OVER (PARTITION BY _shard, _bucket ORDER BY doc_id, size, text_crc32)") - 1
    return (
        placed.withColumn("_slot", slot)
        .join(F.broadcast(before), (F.col("_shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
                (F.col("_slot") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
