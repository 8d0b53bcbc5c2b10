"""Token counts of flat, unindexed token files by separator scan.

A token file holds the token numbers of one document after the other, each document ended
by the end-of-document number, and nothing else.  ``count_tokens`` reads files in blocks of
``BLOCK`` bytes on any task, searches the separators of a block with one vector comparison,
and returns the lengths between them with the loose ends before the first and after the
last.  A prefix scan over the blocks of each file then numbers the documents and adds the
loose ends of earlier blocks to the document that ends in a later one.

``write_token_files`` tokenises documents with a public byte-level BPE vocabulary whose
path is a parameter; the driver reads it and broadcasts it (bounded by the vocabulary).
File names are chosen anew by every task, and only files that the committed manifest names
count.

Defined cases: null and empty texts are a separator alone and have 0 tokens; a document
without a final separator counts if it has a token; files that end inside a number are
refused; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import materialise, open_store, shared_path

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: splits a text into the pieces that byte-pair merges stay within (fixed value of the vocabulary)
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
DTYPE = "<u2"
BLOCK = 4 << 20


@lru_cache(maxsize=1)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _write(folder: str, vocabulary, end: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value).encode_ordinary
        store, base = open_store(folder)
        out, name, number = None, "", 0
        try:
            for batch in batches:
                if out is None:
                    name = f"{uuid.uuid4().hex}.tokens"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                for text in batch.column("text"):
                    out.write(np.array([*encode(text.as_py() or ""), end], dtype).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(np.arange(number, number + n)), batch.column("doc_id")],
                    ["file", "nth", "doc_id"])
                number += n
        finally:
            if out is not None:
                out.close()

    return run


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """Write the tokens of ``docs``; returns the manifest: file, nth (document of the file), doc_id."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(
        docs.select("doc_id", "text").mapInArrow(_write(folder, shared, end, dtype), f"file string, nth long, doc_id {kind}"), "token-manifest")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("file").to_pylist()
        size = []
        for f in files:
            store, path = open_store(f)
            size.append(store.get_file_info(path).size)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(size, pa.int64())], ["file", "bytes"])


def _scan(end: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = open_store(r["file"])
                with store.open_input_file(path) as f:
                    data = f.read_at(r["size"], r["start"])
                if len(data) % width:
                    raise ValueError(f"{r['file']} ends inside a number")
                numbers = np.frombuffer(data, dtype)
                at = np.flatnonzero(numbers == end)
                head = int(at[0]) if len(at) else 0
                tail = len(numbers) - 1 - int(at[-1]) if len(at) else len(numbers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()),
                     pa.array([tail], pa.int64()), pa.array([(np.diff(at) - 1).tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "ends", "head", "tail", "inner"])

    return run


def count_tokens(files: DataFrame, end: int = END, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """Documents of the token ``files`` (file): file, nth (from 0), n_tokens."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block -= block % np.dtype(dtype).itemsize
    sized = files.select("file").distinct().mapInArrow(_sizes, "file string, bytes long").filter("bytes > 0")
    blocks = sized.select(
        "file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block))).alias("block"), "bytes"
    ).select("file", "block", (F.col("block") * block).alias("start"), F.least(F.lit(block), F.col("bytes") - F.col("block") * block).alias("size"))
    scanned = materialise(
        blocks.repartition(n, "file", "block").mapInArrow(
            _scan(end, dtype), "file string, block long, ends long, head long, tail long, inner array<long>"), "token-blocks")
    before = "PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    scan = scanned.drop("inner").withColumns({
        "first": F.expr(f"coalesce(sum(ends) OVER ({before}), 0)"),
        "loose": F.expr(f"coalesce(sum(tail) OVER ({before}), 0)"),
        "last": F.expr("row_number() OVER (PARTITION BY file ORDER BY block DESC) = 1"),
    }).withColumn("carried", F.col("loose") - F.expr(f"coalesce(last(CASE WHEN ends > 0 THEN loose END, true) OVER ({before}), 0)"))
    ended = scan.filter("ends > 0").select("file", F.col("first").alias("nth"), (F.col("carried") + F.col("head")).alias("n_tokens"))
    inner = (
        scanned.filter("size(inner) > 0").select("file", "block", "inner")
        .join(scan.select("file", "block", "first"), ["file", "block"])
        .select("file", "first", F.posexplode("inner").alias("k", "n_tokens"))
        .select("file", (F.col("first") + F.col("k") + 1).alias("nth"), "n_tokens")
    )
    open_end = scan.filter("last").select(
        "file", (F.col("first") + F.col("ends")).alias("nth"),
        F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail")).alias("n_tokens")).filter("n_tokens > 0")
    return ended.unionByName(inner).unionByName(open_end)


def document_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, counted in the token files."""
    manifest = write_token_files(docs, vocabulary=vocabulary)
    return manifest.join(count_tokens(manifest), ["file", "nth"]).select("doc_id", "n_tokens")
