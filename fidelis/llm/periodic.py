"""Periodic runs of words, found on a Re-Pair grammar of each document.

A run is a stretch of words with smallest period q and at least max(24, 3 q) words that no
neighbouring word extends.  Re-Pair replaces pairs of symbols that occur twice or more in a
document by new nonterminals, in rounds: in each round every occurrence of a pair is
replaced that beats the pairs it overlaps (more frequent first, then the smaller pair), in
all documents of a batch at once.  The most frequent pair always wins, and no pair occurs twice in what is
left.  What is left is bracketed in balanced pairs up to one root per document.

Every run has a lowest node of the derivation that spans it, and crosses the boundary
between that node's two children.  So for each nonterminal, once, at its first occurrence,
the runs that cross its boundary are computed: for every period q up to a third of its
length, the words are compared at distance q around the boundary (a hash of eight words
first, then words).  The runs are translated to every position where the nonterminal was derived, and pieces
within a longer run of the same period are merged into it.  A stretch that also has a
multiple of its period is found with the smallest one too, and keeps that.

A task works through its documents in batches of about ``BATCH`` words; memory is bounded by
the batch and the longest document.  Nothing is shuffled.

Defined cases: null and empty texts have no words; a null doc_id is kept, and is not planted;
rows repeated in full get the same result; documents are judged alone, so ties between
documents do not arise; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 24  # words of a run
REPEATS = 3  # periods of a run
GRAM = 8  # words compared by hash first: a run holds LEAST - LEAST // REPEATS = 16 words at distance q
BATCH = 60_000  # words treated at once
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ Re-Pair


def _pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every pair and the size of each class; equal pairs, equal class."""
    key = left * (np.int64(max(left.max(), right.max())) + 1) + right
    _, cls, size = np.unique(key, return_inverse=True, return_counts=True)
    return cls, size


def repair_rounds(symbols: np.ndarray, starts: np.ndarray):
    """Replace repeated pairs until none is left.

    ``symbols`` are words as numbers that differ between documents, so a pair never joins two
    documents by chance; ``starts`` are the places where documents begin.  Returns per round
    the nodes made ((start, middle, end, rule) arrays of word positions, rule numbering the
    nonterminals), the places where the remaining symbols begin, and these symbols.
    """
    n = len(symbols)
    begin = np.arange(n + 1)  # word position of each symbol, and the end
    sym = symbols.astype(np.int64)
    closed = np.zeros(n, bool)  # a symbol that ends its document has no pair
    closed[starts[1:] - 1] = True
    if n:
        closed[-1] = True
    fresh, rules = int(sym.max()) + 1 if n else 0, 0
    nodes = []
    # a pair that occurs once stays alone until one of its symbols is replaced
    open_ = np.flatnonzero(~closed)
    while len(open_):
        cls, size = _pairs(sym[open_], sym[open_ + 1])
        rank = np.zeros(len(sym), np.int64)  # 0: no repeated pair begins here
        many = size[cls] > 1
        if not many.any():
            break
        # equal pairs, equal rank; more frequent pairs have the greater one
        order = np.empty(len(size), np.int64)
        order[np.lexsort((-np.arange(len(size)), size))] = np.arange(1, len(size) + 1)
        rank[open_[many]] = order[cls[many]]
        before = np.r_[0, rank[:-1]]
        after = np.r_[rank[1:], 0]
        # a stretch of one repeated symbol: every second place from its start
        same = (rank == before) & (rank > 0)
        first = np.flatnonzero((rank > 0) & ~same)
        run = np.cumsum((rank > 0) & ~same) - 1
        offset = np.arange(len(rank)) - (first[run] if len(first) else 0)
        odd = same & (offset % 2 == 1)
        # a place gives way to a greater pair that it overlaps
        take = (rank > 0) & ~odd & (rank >= before) & (rank >= after)
        # the last place of a stretch may overlap a taken place of a greater pair only
        at = np.flatnonzero(take)
        taken = rank[at]
        uniq, rule = np.unique(taken, return_inverse=True)
        nodes.append((begin[at], begin[at + 1], begin[at + 2], rule + rules))
        sym[at] = fresh + rule
        closed[at] = closed[at + 1]
        rules, fresh = rules + len(uniq), fresh + len(uniq)
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        # look again where a repeated pair was passed over, and beside new symbols
        look = rank > 0
        look[at] = True
        look[np.maximum(at - 1, 0)] = True
        look &= stay & ~closed
        # a symbol whose right neighbour went: its pair is new (it is beside a new symbol already)
        sym, closed = sym[stay], closed[stay]
        begin = begin[np.r_[stay, True]]
        open_ = np.flatnonzero(look[stay])
    return nodes, begin, sym


def bracket(begin: np.ndarray, document: np.ndarray):
    """Balanced nodes over the remaining symbols, level by level up to one per document."""
    nodes, rules = [], 0
    edges, doc = begin, document
    while len(doc) > 1:
        # the place of each symbol within its document
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        place = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
        left = np.flatnonzero((place % 2 == 0) & np.r_[doc[1:] == doc[:-1], False])
        if not len(left):
            break
        nodes.append((edges[left], edges[left + 1], edges[left + 2], np.arange(len(left)) + rules))
        rules += len(left)
        stay = np.ones(len(doc), bool)
        stay[left + 1] = False
        edges, doc = edges[np.r_[stay, True]], doc[stay]
    return nodes


# ------------------------------------------------------------------ runs


def _gram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words from each place on (wrapping at the end of the batch)."""
    h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < GRAM:
        ahead = np.roll(h, -step)
        h = (h * np.uint64(0xBF58476D1CE4E5B9) + ahead) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        step *= 2
    return h


def _extend(words: np.ndarray, at: np.ndarray, distance: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How far words equal those ``distance`` on, going by ``step`` from ``at``, at most ``room``."""
    far = np.zeros(len(at), np.int64)
    live = np.flatnonzero(room > 0)
    width = 16
    while len(live):
        k = np.arange(width)
        i = at[live, None] + step * (far[live, None] + k)
        ok = far[live, None] + k < room[live, None]
        i = np.where(ok, i, at[live, None])
        equal = (words[i] == words[i + distance[live, None]]) & ok
        equal = np.logical_and.accumulate(equal, axis=1)
        got = equal.sum(axis=1)
        far[live] += got
        live = live[(got == width) & (far[live] < room[live])]
        width = min(width * 2, 512)
    return far


CANDIDATES = 1_000_000  # periods of nodes looked at together


def crossing_runs(words: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray):
    """Runs within each node that cross its middle: (node, from, to, period), maximal within the node."""
    found = []
    gram = _gram_hash(words)
    most = (end - start) // REPEATS
    node = np.flatnonzero(end - start >= LEAST)
    total = np.cumsum(most[node])
    at = 0
    while at < len(node):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, "right")))
        part = node[at:upto]
        at = upto
        x = np.repeat(part, most[part])
        q = np.arange(len(x)) - np.repeat(np.cumsum(most[part]) - most[part], most[part]) + 1
        b, s, e = middle[x], start[x], end[x]
        # the stretch of words equal at distance q holds b - q or b - 1, and 16 words: eight to one side of it
        points = []
        for i in (b - q, b - 1):
            near = np.zeros(len(x), bool)
            for j in (i, i - GRAM + 1):
                inside = (j >= s) & (j + q + GRAM <= e)
                j = np.where(inside, j, 0)
                near |= inside & (gram[j] == gram[np.where(inside, j + q, 0)])
            near[near] = words[i[near]] == words[i[near] + q[near]]
            points.append((x[near], q[near], i[near]))
        x, q, i = (np.concatenate(c) for c in zip(*points))
        order = np.lexsort((i, q, x))
        x, q, i = x[order], q[order], i[order]
        # the smallest periods first; a multiple of a period found gives the same stretch again and is left out
        turn = 2
        while len(x):
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            group = np.cumsum(np.r_[True, x[1:] != x[:-1]]) - 1
            now = np.arange(len(x)) - first[group] < turn
            xi, qi, ii = x[now], q[now], i[now]
            low = ii - _extend(words, ii, qi, ii - start[xi] + 1, -1) + 1
            high = ii + _extend(words, ii, qi, end[xi] - qi - ii, 1) + qi
            good = high - low >= np.maximum(LEAST, REPEATS * qi)
            found.append((xi[good], low[good], high[good], qi[good]))
            order = np.lexsort((qi, low - high, xi))
            best = order[np.r_[True, xi[order][1:] != xi[order][:-1]]]  # the longest stretch of each node
            to = best[group[~now]]
            x, q, i = x[~now], q[~now], i[~now]
            again = (q % qi[to] == 0) & (low[to] <= i) & (i < high[to] - q)
            x, q, i = x[~again], q[~again], i[~again]
            turn *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found))


def runs(words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Per document (beginning at ``starts``; word numbers differ between documents): rows
    (start, length, period) by start, then period; start from the document's first word."""
    count = len(starts)
    empty = [np.zeros((0, 3), np.int64)] * count
    if not len(words):
        return empty
    nodes, begin, _ = repair_rounds(words, starts)
    document = np.searchsorted(starts, begin[:-1], "right") - 1
    pieces = []
    for level in (nodes, bracket(begin, document)):
        if not level:
            continue
        s, m, e, rule = (np.concatenate(c) for c in zip(*level))
        # each nonterminal once, at its first occurrence
        order = np.lexsort((s, rule))
        lead = order[np.r_[True, rule[order][1:] != rule[order][:-1]]]
        x, low, high, q = crossing_runs(words, s[lead], m[lead], e[lead])
        if not len(x):
            continue
        # ... and translated to every position where it was derived
        sorted_rule = rule[order]
        lo = np.searchsorted(sorted_rule, rule[lead[x]], "left")
        hi = np.searchsorted(sorted_rule, rule[lead[x]], "right")
        times = hi - lo
        which = np.repeat(np.arange(len(x)), times)
        occurrence = order[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        shift = s[occurrence] - s[lead[x]][which]
        pieces.append((low[which] + shift, high[which] + shift, q[which]))
    if not pieces:
        return empty
    low, high, q = (np.concatenate(c) for c in zip(*pieces))
    # one stretch, the smallest of its periods
    order = np.lexsort((q, high, low))
    low, high, q = low[order], high[order], q[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    low, high, q = low[new], high[new], q[new]
    # pieces within a longer stretch of the same period belong to it
    order = np.lexsort((-high, low, q))
    low, high, q = low[order], high[order], q[order]
    size = int(high.max()) + 1
    reach = np.maximum.accumulate(q * size + high)  # periods ascend, so an earlier period never reaches over
    keep = np.r_[True, q[1:] * size + high[1:] > reach[:-1]]
    low, high, q = low[keep], high[keep], q[keep]
    order = np.lexsort((q, low))
    low, high, q = low[order], high[order], q[order]
    doc = np.searchsorted(starts, low, "right") - 1
    out = list(empty)
    for d in np.unique(doc):
        mine = doc == d
        out[d] = np.stack([low[mine] - starts[d], high[mine] - low[mine], q[mine]], axis=1)
    return out


# ------------------------------------------------------------------ documents


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The contract's change of every tenth document (by crc32 of its id): words repeat from a place on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _numbers(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that differ between documents, and where documents begin."""
    sizes = np.array([len(w) for w in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = pa.chunked_array([pa.array(w, pa.string()) for w in texts if w] or [pa.array([], pa.string())])
    codes = flat.combine_chunks().dictionary_encode()
    ids = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.repeat(np.arange(len(texts)), sizes) * max(len(codes.dictionary), 1) + ids
    return np.unique(key, return_inverse=True)[1], starts


def _batch(texts: list[list[str]]) -> list[np.ndarray]:
    """Runs of each document of a batch."""
    filled = [i for i, w in enumerate(texts) if w]
    words, starts = _numbers([texts[i] for i in filled])
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    for i, r in zip(filled, runs(words, starts) if filled else []):
        out[i] = r
    return out


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for s, n, q in found.tolist():
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def collapse(words: list[str], found: np.ndarray) -> list[str]:
    """Words without the repeats: of each run its first period stays."""
    if not len(found):
        return words
    kept = np.ones(len(words), bool)
    for s, n, q in found.tolist():
        kept[s + q:s + n] = False
    return [words[i] for i in np.flatnonzero(kept)]


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _work(plant: bool, digest: bool):
    def rows(ids: list, words: list[list[str]]) -> pa.RecordBatch:
        out = []
        for i, w, found in zip(ids, words, _batch(words)):
            text = " ".join(collapse(w, found))
            best = strongest(found)
            if digest:
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
                out.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            else:
                out.append((i, [{"start": s, "length": n, "period": q} for s, n, q in found.tolist()], text))
        names, types = (_DIGEST_NAMES, _DIGEST_TYPES) if digest else (_FULL_NAMES, _FULL_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, size = [], [], 0
            for i, text in zip(b.column("doc_id"), b.column("text")):
                i, text = i.as_py(), text.as_py()
                w = _WORD.findall(text or "")
                ids.append(i)
                words.append(planted(w, i) if plant else w)
                size += len(w)
                if size >= BATCH:
                    yield rows(ids, words)
                    ids, words, size = [], [], 0
            if ids:
                yield rows(ids, words)

    return run


_FULL_NAMES = ["doc_id", "runs", "text"]
_FULL_TYPES = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
_DIGEST_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_DIGEST_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def find_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, runs (start, length, period by word number), text with each run cut to one period."""
    return docs.select("doc_id", "text").mapInArrow(_work(False, False), f"doc_id long, runs {_RUNS}, text string")


def run_report(docs: DataFrame) -> DataFrame:
    """Runs of the ``planted`` documents as numbers and digests, one row per row of ``docs``."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_work(True, True), schema)
