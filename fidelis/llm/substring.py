"""Substring dedup by seed and extend over winnowed anchors.

Of every ``WINDOW`` consecutive words, the run of ``GRAM`` words with the smallest hash
(the rightmost of equal ones) is the anchor: equal windows have equal anchors, and a text
has an anchor about every 21 words.  Neighbouring windows with one anchor form a span, the
text around the anchor that its windows reach.  Documents meet on anchors:

* spans of equal words form a class, and only the smallest doc_id of a class matters: the
  other documents' windows of that span are repeats (extension as far as the span goes);
* where an anchor has several classes, one span a class is extended word by word: its
  windows are looked up by their own hash, and a window is a repeat where a smaller doc_id
  has it too.

So copies are compared by class, never in pairs, and work stays in proportion to the text
however many documents share a passage.  The windows that are found are merged to maximal
repeats and their words removed; all windows are judged on the input.  Spans are compared
by anchor and span hash (160 bits together), windows by 128 bits.  Anchors of one document
only, which are most, leave before spans are compared, and texts are packed (zstd) for the
two shuffles that bring them to their spans.

Defined cases: null and empty texts have no words; documents of one doc_id never remove
words of each other; a null doc_id neither loses words nor makes others lose any; rows
repeated in full get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import materialise

WINDOW = 50
GRAM = 10
CHUNK = 1 << 17  # bytes of text that a task holds and hashes at a time, if no single text is longer

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Words:
    """The words of a few texts: hashes of any run of words of one text in constant time."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        ink = ~_BLANK[raw]
        edges = np.diff(ink.astype(np.int8), prepend=0, append=0)
        starts, stops = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        self.n = len(starts)
        text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: words before each text
        self.first = np.searchsorted(starts, text_starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        lengths = stops - starts
        offsets = np.cumsum(lengths) - lengths
        letters = raw[ink].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(letters)) - np.repeat(offsets, lengths)
        self._sums, self._back = [], []
        for base, step in zip(_BASES, _STEPS, strict=True):
            if not self.n:
                self._sums.append(np.zeros(1, np.uint64))
                self._back.append(np.ones(1, np.uint64))
                continue
            word = _mix(np.add.reduceat(letters * _powers(base, int(lengths.max()))[place], offsets))
            self._sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _powers(step, self.n), dtype=np.uint64))))
            self._back.append(_powers(np.uint64(pow(int(step), -1, 1 << 64)), self.n + 1))

    def run(self, which: int, at: np.ndarray, size) -> np.ndarray:
        """Hash number ``which`` of the ``size`` words from ``at`` on."""
        sums = self._sums[which]
        return _mix((sums[at + size] - sums[at]) * self._back[which][at])

    def window_starts(self, size: int) -> np.ndarray:
        """Positions from which ``size`` words of one text follow."""
        at = np.arange(max(0, self.n - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at


def _rightmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the smallest (the rightmost of equal ones) of ``size`` values from each position on."""
    best, where, have = values, np.arange(len(values)), 1
    while have < size:
        step = min(have, size - have)
        right = best[step:] <= best[:-step]
        best, where = np.where(right, best[step:], best[:-step]), np.where(right, where[step:], where[:-step])
        have += step
    return where


def spans(w: Words) -> tuple[np.ndarray, ...]:
    """Anchor hash, two span hashes, first and last window start (positions in ``w``) of each span."""
    empty = np.zeros(0, np.uint64)
    at = w.window_starts(WINDOW)
    if not len(at):
        return empty, empty, empty, at, at
    grams = w.run(0, np.arange(w.n - GRAM + 1), GRAM)
    anchor = _rightmost_least(grams, WINDOW - GRAM + 1)[at]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)))
    begin = np.nonzero(new)[0]
    first, last = at[begin], at[np.concatenate((begin[1:], [len(at)])) - 1]
    size = last + WINDOW - first
    return grams[anchor[begin]], w.run(0, first, size), w.run(1, first, size), first, last


def _chunks(column: pa.Array, read) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows of about CHUNK bytes; only these texts are held."""
    start, size, texts = 0, 0, []
    for i, cell in enumerate(column):
        text = read(cell)
        if texts and size + len(text) > CHUNK:
            yield start, texts
            start, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield start, texts


def _plain(cell: pa.Scalar) -> bytes:
    return cell.as_py() or b""


def _reader():
    press = zstandard.ZstdDecompressor()
    return lambda cell: press.decompress(cell.as_py())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _emit_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in _chunks(batch.column("_text"), _plain):
            with np.errstate(over="ignore"):
                w = Words(texts)
                anchor, s1, s2, first, last = spans(w)
            doc = w.doc[first]
            row = pa.array(doc + a)
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(s1), pa.array((s2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column("doc_id").take(row),
                 batch.column("_th").take(row), pa.array((first - w.first[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                ["anchor", "s1", "s2", "doc_id", "_th", "at", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for a, texts in _chunks(batch.column("_text"), _plain):
            packed = pa.array([press.compress(t) for t in texts], pa.binary())
            rows = batch.slice(a, len(texts))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_th"), packed], ["doc_id", "_th", "_zip"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _reader()
    for batch in batches:
        for a, texts in _chunks(batch.column("_zip"), read):
            asked = batch.column("_spans").slice(a, len(texts))
            with np.errstate(over="ignore"):
                w = Words(texts)
                at = [np.arange(x["at"], x["at"] + x["n"]) + w.first[k] for k, spans_of in enumerate(asked) for x in spans_of.as_py()]
                at = np.concatenate(at) if at else np.zeros(0, np.int64)
                w1, w2 = w.run(0, at, WINDOW), w.run(1, at, WINDOW)
            doc = w.doc[at] if len(at) else at
            row = pa.array(doc + a)
            yield pa.RecordBatch.from_arrays(
                [_signed(w1), _signed(w2), batch.column("doc_id").take(row), batch.column("_th").take(row),
                 pa.array((at - w.first[doc]).astype(np.int32))],
                ["w1", "w2", "doc_id", "_th", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _reader()
    for batch in batches:
        for a, texts in _chunks(batch.column("_zip"), read):
            rows = batch.slice(a, len(texts))
            count, removed, digests = [], [], []
            for text, repeats in zip(texts, rows.column("_repeats"), strict=True):
                tokens = text.split()
                count.append(len(tokens))
                found = repeats.as_py()
                if found:
                    edge = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(edge, [x["at"] for x in found], 1)
                    np.add.at(edge, [x["at"] + x["n"] + WINDOW - 1 for x in found], -1)
                    keep = (np.cumsum(edge[:-1]) == 0).tolist()
                    tokens = [t for t, k in zip(tokens, keep, strict=True) if k]
                removed.append(count[-1] - len(tokens))
                digests.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    # a row is told from others of its doc_id by 31 bits of its text's hash
    th = F.xxhash64("text").bitwiseAND((1 << 31) - 1).cast("int").alias("_th")
    return docs.select("doc_id", th, F.col("text").cast("binary").alias("_text"))


def _packed(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_pack, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, _th int, _zip binary")


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated windows: doc_id, _th (hash of the text), at (word), n (windows from there on)."""
    place = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _th int, at int"
    texts = _texts(docs).filter("doc_id IS NOT NULL")
    found = materialise(texts.mapInArrow(_emit_spans, f"anchor long, s1 long, s2 int, {place}, n int"), "spans")
    # anchors of two documents at least; several: their spans differ
    shared = materialise(
        found.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.min("s1").alias("_p"), F.max("s1").alias("_q"))
        .filter("_b > _a").select("anchor", (F.col("_p") != F.col("_q")).alias("several")), "anchors")
    near = materialise(found.join(shared, "anchor"), "shared-spans")
    classes = materialise(near.groupBy("anchor", "s1", "s2").agg(F.min("doc_id").alias("least")), "span-classes")
    judged = materialise(
        near.join(classes, ["anchor", "s1", "s2"]).select("doc_id", "_th", "at", "n", "several", (F.col("doc_id") > F.col("least")).alias("repeat"))
        .filter("repeat OR several"), "judged-spans")
    spans_of = judged.filter("NOT repeat").groupBy("doc_id", "_th").agg(F.collect_list(F.struct("at", "n")).alias("_spans"))
    windows = materialise(
        _packed(texts).join(spans_of, ["doc_id", "_th"]).mapInArrow(_emit_windows, f"w1 long, w2 long, {place}"), "windows")
    first = materialise(
        windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("most > least").select("w1", "w2", "least"), "window-classes")
    single = windows.join(first, ["w1", "w2"]).filter("doc_id > least").select("doc_id", "_th", "at", F.lit(1).alias("n"))
    return judged.filter("repeat").select("doc_id", "_th", "at", "n").unionByName(single)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""
    by_doc = repeats(docs).groupBy("doc_id", "_th").agg(F.collect_list(F.struct("at", "n")).alias("_repeats"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _packed(_texts(docs)).join(by_doc, ["doc_id", "_th"], "left").select("doc_id", "_zip", "_repeats").mapInArrow(
        _cut, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")
