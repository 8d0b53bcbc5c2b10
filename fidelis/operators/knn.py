"""Exact k-nearest-neighbour search over kd-tree cells with boxes in all dimensions.

Reference rows lie in the leaves of a kd-tree (``kdtree.py``); a cell is a node
``CELL_LEVELS`` levels above them.  The cells are written once, each as a stretch of a file in the shared
folder, with an index of their boxes (one row a cell).  Query rows are sorted by the same tree,
so a task holds blocks of rows that lie together, and reads the cells that its block needs
itself: no row of either side is sent to more than one place, whatever the number of cells that
a query row's ball reaches.

A block is searched in groups of ``GROUP`` neighbouring rows.  Each group first meets its
``NEAR`` nearest cells, which gives its rows a bound: the k-th distance found.  Then the cells
are met whose box is within the greatest bound of a group, nearest first, by the rows whose own
bound reaches the box, and inside a cell leaf by leaf in the same way.  A reference row in a box
beyond the bound cannot enter the top k, so the result is exact.

Distances are screened by one single-precision product with a bound on its rounding error; at most
``TILE`` pairs are measured at once, and a leaf leaves at most k candidates per query row.  What
passes is measured by direct differences, so exact copies give 0.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators import kdtree
from fidelis.session import materialise, open_store, shared_path

LEAF_ROWS = 576
CELL_LEVELS = 4  # a cell is a node so many levels above the leaves
Q_BLOCK = 65_536  # query rows of a block
R_BLOCK = 16_384  # reference rows of a cell; a node with more (of equal rows) is several cells
TASK_ROWS = 8192  # query rows a task, unless that makes more than TASKS tasks a shuffle partition
TASKS = 4
GROUP = 32  # neighbouring query rows that choose their cells together
NEAR = 2  # cells that give a group its bounds
TILE = 2_000_000  # pairs measured at once
HELD = 2_000_000  # candidates held before those beyond the bounds are dropped
STRIP = 8192  # query rows whose gaps to the leaves of a cell are measured at once
KEPT_CELLS = 32  # read cells that a worker keeps


def euclid(features: Sequence[str], left: str = "q_", right: str = "r_") -> Column:
    total = None
    for f in features:
        d = F.col(f"{left}{f}") - F.col(f"{right}{f}")
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def few_true(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the true elements of a mask, few of many: eight elements are passed over at once."""
    flat = mask.reshape(-1)
    whole = len(flat) & ~7
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = np.flatnonzero(flat[:whole].reshape(-1, 8)[words].reshape(-1))
    out = (words[at >> 3] << 3) + (at & 7)
    rest = np.flatnonzero(flat[whole:])
    return np.concatenate([out, rest + whole]) if len(rest) else out


class _Best:
    """The k best candidates of each query row of a block, and its bound."""

    def __init__(self, bound: np.ndarray, k: int):
        self.k, self.bound = k, bound
        self.dist = np.full((len(bound), k), np.inf)
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (query row, distance, reference id), any order."""
        order = np.lexsort((ids, d, rows))
        r, dd, ii = rows[order], d[order], ids[order]
        new = np.ones(len(r), bool)
        np.not_equal(r[1:], r[:-1], out=new[1:])
        first = np.flatnonzero(new)
        if self.k == 1:  # the first of each row
            touched, dd = r[first], dd[first]
            self.rows.append((touched, dd, ii[first]))
            self.held += len(first)
            self.bound[touched] = np.minimum(self.bound[touched], dd)
        else:
            size = np.diff(first, append=len(r))
            rank = np.arange(len(r)) - np.repeat(first, size)
            top = rank < self.k
            self.rows.append((r[top], dd[top], ii[top]))  # no other can be among the k best
            self.held += int(top.sum())
            touched = r[first]
            fresh = np.full((len(touched), self.k), np.inf)
            fresh[np.repeat(np.arange(len(first)), size)[top], rank[top]] = dd[top]
            merged = np.sort(np.concatenate([self.dist[touched], fresh], axis=1), axis=1)[:, :self.k]
            self.dist[touched] = merged
            self.bound[touched] = np.minimum(self.bound[touched], merged[:, -1])
        if self.held > HELD:
            kept = self.result()
            self.rows, self.held = [kept], -len(kept[0])  # so many more before the next time

    def result(self):
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        rows, d, ids = (np.concatenate(c) for c in zip(*self.rows))
        near = d <= self.bound[rows]
        rows, d, ids = rows[near], d[near], ids[near]
        order = np.lexsort((ids, d, rows))
        rows, d, ids = rows[order], d[order], ids[order]
        keep = _ranks(rows) <= self.k
        return rows[keep], d[keep], ids[keep]


def _ranks(rows: np.ndarray) -> np.ndarray:
    """1, 2, ... within each stretch of equal numbers."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)])) + 1


def _meet(best: _Best, q: np.ndarray, at: np.ndarray, r: np.ndarray, ids: np.ndarray) -> None:
    """Distances of query rows ``at`` to the reference rows ``r``, candidates within the bound kept."""
    if len(at) and len(r):
        _Meeting(best, q, at, _Leaves(r, ids)).leaf(np.arange(len(at)), 0, len(r))


class _Leaves:
    """Reference rows about their centre, with the right factor of the screening product and the boxes of the leaves."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, first: Sequence[int] = (0,)):
        self.x, self.ids, self.centre = x, ids, x.mean(axis=0)
        self.first = np.r_[first, len(x)].astype(np.int64)
        c = x - self.centre
        norm = np.einsum("ij,ij->i", c, c)
        self.most = float(norm.max(initial=0.0))
        self.double = np.vstack([c.T, np.ones(len(x)), norm])
        self.single = self.double.astype(np.float32) if self.most < 1e30 else None
        self.lo, self.hi = np.minimum.reduceat(c, self.first[:-1]), np.maximum.reduceat(c, self.first[:-1])


class _Meeting:
    """Query rows ``rows`` of a block with the reference rows of one cell."""

    def __init__(self, best: _Best, q: np.ndarray, rows: np.ndarray, leaves: _Leaves):
        self.best, self.q, self.rows, self.leaves = best, q, rows, leaves
        x = q[rows] - leaves.centre
        norm = np.einsum("ij,ij->i", x, x)
        single = leaves.single is not None and float(norm.max(initial=0.0)) < 1e30
        self.right = leaves.single if single else leaves.double
        # rounding error of the screening product, and of the gaps to the leaves
        self.error = (4e-7 if single else 1e-15) * (x.shape[1] + 4) * (norm + leaves.most) + 1e-12
        self.norm = norm
        self.left = np.empty((len(x), x.shape[1] + 2), self.right.dtype)
        np.multiply(x, -2.0, out=self.left[:, :-2], casting="same_kind")
        self.left[:, -1] = 1.0
        self.bound2 = best.bound[rows] ** 2
        kind = self.left.dtype
        self.gap2 = lambda: _point_gap2(np.ascontiguousarray(x.T, kind), leaves.lo.astype(kind), leaves.hi.astype(kind))

    def reach(self) -> np.ndarray:
        """Squared distance that a row's bound reaches."""
        return (self.bound2 * (1 + 1e-6) + self.error).astype(self.left.dtype)

    def leaf(self, at: np.ndarray, start: int, stop: int) -> bool:
        """Rows ``rows[at]`` against the reference rows start .. stop; whether a bound may have changed."""
        step = max(1, TILE // (stop - start))
        return any([self._tile(at[s:s + step], start, stop) for s in range(0, len(at), step)])

    def _tile(self, at: np.ndarray, start: int, stop: int) -> bool:
        right = self.right[:, start:stop]
        limit, left = self.bound2[at], self.left[at]
        if limit.max() == np.inf:
            open_ = np.isinf(limit)
            if stop - start > self.best.k:  # the k-th of these pairs is a bound
                left[:, -2] = self.norm[at]
                kth = np.partition(left[open_] @ right, self.best.k - 1, axis=1)[:, self.best.k - 1]
                limit[open_] = np.maximum(kth, 0.0) + self.error[at][open_]
            else:  # all of them
                limit[open_] = 4 * (self.norm[at][open_] + self.leaves.most)
        left[:, -2] = self.norm[at] - limit * (1 + 1e-6) - self.error[at]
        hit = few_true(left @ right <= 0)
        if not len(hit):
            return False
        i, j = np.divmod(hit, stop - start)
        i, j = at[i], j + start
        row = self.rows[i]
        diff = self.q[row] - self.leaves.x[j]
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        near = np.flatnonzero(d <= self.best.bound[row])
        if not len(near):
            return False
        self.best.add(row[near], d[near], self.leaves.ids[j[near]])
        self.bound2[i[near]] = self.best.bound[row[near]] ** 2
        return True


def _gap2(x_lo: np.ndarray, x_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared least distances of boxes (rows) to boxes (columns)."""
    total = np.zeros((len(x_lo), len(lo)))
    for i in range(x_lo.shape[1]):
        g = np.maximum(np.maximum(lo[None, :, i] - x_hi[:, i, None], x_lo[:, i, None] - hi[None, :, i]), 0.0)
        total += g * g
    return total


def _point_gap2(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared least distances of boxes (rows) to points (columns; ``x`` holds a feature a row), in the type of ``x``."""
    total = np.empty((len(lo), x.shape[1]), x.dtype)
    for s in range(0, x.shape[1], STRIP):
        part = x[:, s:s + STRIP]
        out, none, a, b = np.zeros((4, len(lo), part.shape[1]), x.dtype)
        for i in range(len(x)):
            np.subtract(lo[:, i, None], part[i], out=a)
            np.subtract(part[i], hi[:, i, None], out=b)
            np.maximum(a, b, out=a)
            np.maximum(a, none, out=a)
            np.multiply(a, a, out=a)
            out += a
        total[:, s:s + STRIP] = out
    return total


class _Cells:
    """The index of the written cells of one key: their boxes and where they are."""

    def __init__(self, at: list[tuple], lo: np.ndarray, hi: np.ndarray):
        self.at, self.lo, self.hi = at, lo, hi


@lru_cache(maxsize=2)
def _index(files: tuple[str, ...], keys: tuple[str, ...], p: int) -> dict[tuple, _Cells]:
    import pyarrow as pa
    import pyarrow.parquet as pq

    parts = []
    for file in files:
        store, path = open_store(file)
        with store.open_input_file(path) as f:
            parts.append(pq.ParquetFile(f).read())
    t = pa.concat_tables(parts)
    box = lambda c: np.array(t.column(c).to_pylist(), np.float64).reshape(-1, p)
    lo, hi = box("_lo"), box("_hi")
    at = list(zip(*[t.column(c).to_pylist() for c in ("_file", "_start", "_size")]))
    of: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[t.column(c).to_pylist() for c in keys]) if keys else [()] * len(at)):
        of.setdefault(key, []).append(i)
    return {key: _Cells([at[i] for i in rows], lo[rows], hi[rows]) for key, rows in of.items()}


@lru_cache(maxsize=KEPT_CELLS)
def _read_cell(file: str, start: int, size: int):
    """The rows of one cell."""
    store, path = open_store(file)
    with store.open_input_file(path) as f:
        return _Leaves(*pickle.loads(f.read_at(size, start)))


def _nearest(q: np.ndarray, cells: _Cells, k: int):
    """The k nearest reference rows of each row of a block (as ``_Best``), and the number of rows that each was compared with."""
    best, compared = _Best(np.full(len(q), np.inf), k), np.zeros(len(q), np.int64)
    slack = 1 + 1e-9
    columns = np.ascontiguousarray(q.T)

    def visit(c: int, rows: np.ndarray, ordered: bool) -> None:
        box = _point_gap2(columns[:, rows], cells.lo[c:c + 1], cells.hi[c:c + 1])[0]
        rows = rows[box <= best.bound[rows] ** 2 * slack]
        if not len(rows):
            return
        met = _Meeting(best, q, rows, _read_cell(*cells.at[c]))
        first, gap, far = met.leaves.first, met.gap2(), met.reach()
        nearest = gap.argmin(axis=0) if ordered else None
        for turn in (0, 1) if ordered else (2,):  # every row's nearest leaf, then the others that its bound lets in
            for j in range(len(gap)):
                open_ = gap[j] <= far
                if ordered:
                    open_ &= (nearest == j) if turn == 0 else (nearest != j)
                at = np.flatnonzero(open_)
                if len(at):
                    compared[rows[at]] += first[j + 1] - first[j]
                    if met.leaf(at, first[j], first[j + 1]):
                        far = met.reach()

    starts = np.arange(0, len(q), GROUP)
    lo, hi = np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)
    members = lambda groups: (lambda r: r[r < len(q)])((groups[:, None] * GROUP + np.arange(GROUP)).ravel())
    mid = (lo + hi) / 2
    near = np.argsort(_gap2(mid, mid, cells.lo, cells.hi), axis=1, kind="stable")[:, :NEAR]
    asked = np.zeros((len(starts), len(cells.at)), bool)
    np.put_along_axis(asked, near, True, axis=1)
    for turn in range(near.shape[1]):
        for c in np.unique(near[:, turn]):
            visit(c, members(np.flatnonzero(near[:, turn] == c)), turn == 0)
    gap = _gap2(lo, hi, cells.lo, cells.hi)
    gap[asked] = np.inf
    least = gap.min(axis=0)
    for c in np.argsort(least, kind="stable"):
        if np.isinf(least[c]):
            break
        far = np.maximum.reduceat(best.bound, starts) ** 2 * slack
        groups = np.flatnonzero((gap[:, c] <= far) & np.isfinite(gap[:, c]))
        if len(groups):
            visit(c, members(groups), False)
    return best, compared


def _runs(df: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """First rows of the stretches of ``df`` with equal values, and its end."""
    new = np.zeros(max(len(df) - 1, 0), bool)
    for c in columns:
        v = df[c].to_numpy()
        new |= v[1:] != v[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, len(df)]


def _write_cells(folder: str, keys: list[str], features: list[str]):
    """mapInPandas body: sorted reference rows to cells in a file of the task's own; the index rows."""

    def run(batches):
        store, base = open_store(folder)
        name, out, place, held = "", None, 0, None

        def write(df: pd.DataFrame):
            nonlocal name, out, place
            index = []
            for s in range(0, len(df), R_BLOCK):
                part = df.iloc[s:s + R_BLOCK]
                x, leaf = part[features].to_numpy(dtype=np.float64), part["_leaf"].to_numpy()
                while len(leaf) and len(np.unique(leaf)) * part["_least"].iloc[0] > len(leaf) and leaf[0] != leaf[-1]:
                    leaf = leaf >> 1  # few rows of this key: leaves of its own size
                first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
                data = pickle.dumps((x, part["_rid"].to_numpy(), first), protocol=5)
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.cells"
                    out = store.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}", compression=None)
                out.write(data)
                index.append({c: part[c].iloc[0] for c in keys} | {
                    "_file": name, "_start": place, "_size": len(data), "_n": len(part), "_lo": x.min(axis=0).tolist(), "_hi": x.max(axis=0).tolist()})
                place += len(data)
            return pd.DataFrame(index)

        try:
            for batch in batches:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
                runs = _runs(held, [*keys, "_cell"])
                for s, e in zip(runs[:-2], runs[1:-1]):
                    yield write(held.iloc[s:e])
                held = held.iloc[runs[-2]:] if len(held) else None
                while held is not None and len(held) > R_BLOCK:
                    yield write(held.iloc[:R_BLOCK])
                    held = held.iloc[R_BLOCK:]
            if held is not None and len(held):
                yield write(held)
        finally:
            if out is not None:
                out.close()

    return run


def _search(files: tuple[str, ...], keys: list[str], ident: list[str], features: list[str], k: int, count: bool):
    """mapInPandas body: sorted query rows, block by block, against the cells."""

    def block(df: pd.DataFrame):
        index = _index(files, tuple(keys), len(features))
        runs = _runs(df, keys)
        for s, e in zip(runs[:-1], runs[1:]):
            mine = df.iloc[s:e]
            cells = index.get(tuple(mine[c].iloc[0] for c in keys))
            if cells is None:
                continue
            best, compared = _nearest(mine[features].to_numpy(dtype=np.float64), cells, k)
            if count:
                yield mine[ident].assign(compared=compared)
                continue
            rows, d, ids = best.result()
            out = {c: mine[c].to_numpy()[rows] for c in ident}
            yield pd.DataFrame(out | {"rank": _ranks(rows).astype(np.int32), "dist": d, "_rid": ids})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= Q_BLOCK:
                yield from block(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield from block(pd.concat(held, ignore_index=True))

    return run


class _Search:
    """One search: reference rows in written cells, query rows in the order of the tree."""

    def __init__(self, query, ref, features, k, query_id, ref_id, keys, carry, leaf_rows):
        self.features, self.k, self.keys = features, k, keys
        self.ident = [*keys, *carry, "_qid"]
        spark = ref.sparkSession
        there = lambda df: df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in keys)) if keys else df
        x = [F.col(f).cast("double").alias(f) for f in features]
        r = there(ref.select(*keys, F.col(ref_id).alias("_rid"), *x).dropna(subset=features))
        q = there(query.select(*keys, *carry, F.col(query_id).alias("_qid"), *x).dropna(subset=features))
        # one row a key
        self.sizes = materialise(r.groupBy(*keys).agg(F.count(F.lit(1)).alias("ref_rows")), "knn-sizes")
        total, typical = self.sizes.agg(F.sum("ref_rows"), F.avg("ref_rows")).first()
        self.tree = kdtree.build(r, features, "_rid", kdtree.depth_for(typical or 1, leaf_rows))
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions") or 200)
        # a key with fewer rows than typical has its cells further up
        up = F.lit(CELL_LEVELS) + F.greatest(F.lit(0), F.round(F.log2(F.lit(float(typical or 1)) / F.col("ref_rows")))).cast("int")
        placed = self.tree.place(r)
        if keys:
            placed = placed.join(F.broadcast(self.sizes.select(*keys, up.alias("_up"))), keys)  # one row a key
        else:
            placed = placed.withColumn("_up", F.lit(CELL_LEVELS))
        placed = materialise(placed.withColumn("_cell", F.expr(f"shiftright(_leaf, least(_up, {self.tree.depth}))")).drop("_up"), "knn-ref")
        n = max(1, min(-(-(total or 0) // (4 * R_BLOCK)), TASKS * self.parts))
        folder = shared_path(spark, "knn-cells")
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        order = [*keys, "_leaf"]
        schema = T.StructType([placed.schema[c] for c in keys] + [
            T.StructField("_file", T.StringType()), T.StructField("_start", T.LongType()), T.StructField("_size", T.LongType()), T.StructField("_n", T.LongType()),
            T.StructField("_lo", T.ArrayType(T.DoubleType())), T.StructField("_hi", T.ArrayType(T.DoubleType()))])
        sorted_ = placed.withColumn("_least", F.lit(max(1, leaf_rows // 2))).repartitionByRange(n, *order, "_rid").sortWithinPartitions(*order)
        self.index = materialise(sorted_.mapInPandas(_write_cells(folder, keys, features), schema), "knn-index")
        self.rid = placed.schema["_rid"].dataType
        self.queries = materialise(self.tree.place(q), "knn-query")

    def run(self, count: bool = False) -> DataFrame:
        """(ident, rank, dist, _rid), or (ident, compared) if ``count``."""
        order = [*self.keys, "_leaf"]
        n = max(1, min(-(-self.queries.count() // TASK_ROWS), TASKS * self.parts))
        out = [self.queries.schema[c] for c in self.ident]
        out += [T.StructField("compared", T.LongType())] if count else [
            T.StructField("rank", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("_rid", self.rid)]
        body = _search(tuple(sorted(self.index.inputFiles())), self.keys, self.ident, self.features, self.k, count)
        rows = self.queries.repartitionByRange(n, *order, "_qid").sortWithinPartitions(*order)
        return rows.mapInPandas(body, T.StructType(out))


def knn(query: DataFrame, ref: DataFrame, features: Sequence[str], k: int = 1, *, query_id: str, ref_id: str,
        keys: Sequence[str] = (), carry: Sequence[str] = (), leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """For every query row: its k nearest reference rows with equal ``keys``.

    ``carry`` are further query columns that identify a query row (e.g. its dataset
    when all datasets share one reference).  Returns (keys, carry, query_id, rank,
    dist, ref_id) where ``ref_id`` holds the reference row's ``ref_id`` column; ties are
    broken by it.  Rows with a null feature or key are skipped.
    """
    s = _Search(query, ref, list(features), k, query_id, ref_id, list(keys), list(carry), leaf_rows)
    return s.run().select(*keys, *carry, F.col("_qid").alias(query_id), "rank", "dist", F.col("_rid").alias("ref_id"))


def knn_compared(query: DataFrame, ref: DataFrame, features: Sequence[str], k: int = 1, *, query_id: str, ref_id: str,
                 keys: Sequence[str] = (), carry: Sequence[str] = (), leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The work of ``knn``: per query row the reference rows it was compared with, and their number in all."""
    s = _Search(query, ref, list(features), k, query_id, ref_id, list(keys), list(carry), leaf_rows)
    done = s.run(count=True)
    done = done.join(s.sizes, list(keys)) if keys else done.withColumn("ref_rows", F.lit(s.sizes.first()["ref_rows"]))
    return done.withColumnRenamed("_qid", query_id)
