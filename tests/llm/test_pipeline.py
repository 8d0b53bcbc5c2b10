"""The pipeline's stages against plain versions, and every operator on empty and odd tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from fidelis.llm import decontam, lines, mixing, pii, quality, sharding, simhash, substring, tokens, warc
from tests.conftest import SF_SMALL
from tests.llm.test_corpus import classes, fingerprint


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SF_SMALL), "test")
        before, after = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        if name != "sharding":
            assert out.columns == columns
        left = Counter(r["doc_id"] for r in after)
        if name == "quality rules":
            assert left == Counter(r.doc_id for r in quality.judge(docs).collect() if r.kept)
        elif name == "simhash near-dedup":
            prints = np.array([fingerprint(r["text"]) for r in before], np.uint64)
            ids = np.array([r["doc_id"] for r in before])
            label = classes(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
            assert left == Counter(int(ids[label == c].min()) for c in set(label))
        elif name == "benchmark decontamination":
            items = [decontam.word_list(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
            whole = [" " + " ".join(i) + " " for i in items]
            texts = {r["doc_id"]: " " + " ".join(decontam.word_list(r["text"])) + " " for r in before}
            assert left == Counter(i for i, t in texts.items() if not any(w in t for w in whole))
        elif name == "mixing sources to target weights":
            assert left == Counter({r.doc_id: r.copies for r in mixing.mix_report(docs).collect() if r.copies})
        else:
            assert left == Counter(r["doc_id"] for r in before)
            assert len({(r["text"], r["shard"]) for r in after}) == len({r["text"] for r in after})
        docs = out


def test_entry_has_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


RUNS = {
    "mix": mixing.mix_report, "emit": mixing.emit, "quality": quality.judge, "keep_good": quality.keep_good, "shards": sharding.shard_report,
    "add_shard": sharding.add_shard, "simhash": simhash.near_duplicates, "keep_one": simhash.keep_one, "substring": substring.remove_repeats,
    "lines": lines.line_report, "pii": pii.find, "tokens": tokens.document_tokens,
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, documents, name):
    assert RUNS[name](documents([(1, "x")]).filter("false")).collect() == []


@pytest.mark.parametrize("name", RUNS)
def test_all_null_rows_and_clashing_columns(spark, documents, name):
    rows = [(None, None, None, None), (None, None, None, None), (1, "one two three", None, None), (2, "", "en", "s")]
    clash = ["_row", "_source", "rate", "target", "_copies", "_copy", "n_words", "_w", "kept", "_lang", "_key", "size", "_bundle", "_name", "_th",
             "_fp", "row", "_text", "_small", "_salt", "page", "lines", "doc"]
    docs = documents(rows).selectExpr("*", *[f"'x' AS `{c}`" for c in clash])
    out = RUNS[name](docs)
    n = len(out.collect())
    if name in ("emit", "keep_good", "keep_one"):
        assert out.columns == docs.columns
    if name == "keep_good":
        assert n == 0
    elif name == "keep_one":
        assert n == 2  # the empty texts link
    elif name != "emit":
        assert n == len(rows)


def test_empty_benchmark_and_pages(spark, documents):
    docs = documents([(1, "some words of a text")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).collect() == []
    assert decontam.keep_clean(docs, none).count() == 1
    some = spark.createDataFrame([(1, "some words of a text")], "item_id long, text string")
    assert decontam.contaminated(docs.filter("false"), some).collect() == [] and decontam.keep_clean(docs, some).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
