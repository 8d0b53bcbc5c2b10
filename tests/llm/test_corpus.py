"""Operators that hold documents against each other: sharding, copies, passages, lines, benchmark."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fidelis.llm import decontam, lines, sharding, simhash, substring
from tests.llm.conftest import sentence


def plain_best_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        fit = [(f, b) for b, f in enumerate(free) if f >= s]
        if not fit:
            free.append(capacity)
            fit = [(capacity, len(free) - 1)]
        b = min(fit)[1]
        free[b] -= s
        out.append(b)
    return out


def test_best_fit_decreasing_against_linear_search():
    rnd = random.Random(2)
    for _ in range(200):
        sizes = sorted((rnd.randrange(1, rnd.choice([6, 60])) for _ in range(rnd.randrange(1, 80))), reverse=True)
        counted = sorted(Counter(sizes).items(), reverse=True)
        got = [b for runs in sharding.best_fit_decreasing(counted, 60) for b, n in runs for _ in range(n)]
        want = plain_best_fit(sizes, 60)
        assert got == want
        assert sharding.best_fit_decreasing(counted, 60, max(want) + 1) is not None and sharding.best_fit_decreasing(counted, 60, max(want)) is None
        capacity, placed = sharding.pack(counted, 4)
        assert [sum(n for _, n in runs) for runs in placed] == [n for _, n in counted]
        assert {b for runs in placed for b, _ in runs} <= set(range(4))


def test_every_group_is_packed(documents):
    """Thousands of small groups and a few large ones, many of one size, against a plain best-fit-decreasing."""
    rnd = random.Random(4)
    rows = [(i, f"{i:05d}" + "x" * rnd.choice([3, 3, 3, 40, rnd.randrange(200)])) for i in range(5000)]
    rows += [(6000 + i, f"big {i % 3} " * 900) for i in range(30)] + [(7000 + i, "é" * 150_000) for i in range(2)]
    group = Counter()
    for _, t in rows:
        group[t] += len(t.encode()) + 8
    sizes = sorted(group.values(), reverse=True)
    capacity, _ = sharding.pack(sorted(Counter(sizes).items(), reverse=True), 24)
    total, alone = sum(sizes), 0
    while sizes[alone] * (24 - alone) > total:
        total -= sizes[alone]
        alone += 1
    want = defaultdict(list)
    for s, b in zip(sizes, [*range(alone), *(alone + b for b in plain_best_fit(sizes[alone:], capacity))], strict=True):
        want[b].append(s)
    got, text = defaultdict(set), dict(rows)
    for r in sharding.shard_report(documents(rows)).collect():
        got[r.shard].add(text[r.doc_id])
    assert 0 < alone < 24 and {b: sorted((group[t] for t in ts), reverse=True) for b, ts in got.items()} == want
    loads = [sum(group[t] for t in ts) for b, ts in got.items() if b >= alone]
    assert max(loads) - min(loads) < 0.01 * max(loads)


def test_shards(documents):
    rnd = random.Random(3)
    rows = [(i, sentence(rnd, rnd.randrange(1, 120))) for i in range(900)]
    rows += [(2000 + i, "hot text " * 30) for i in range(500)] + [(5000, None), (5001, ""), (None, "x"), (5002, "é" * 9), rows[0]]
    got = sharding.shard_report(documents(rows)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    where, load, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        where[raw].add(r.shard)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values()) and set(load) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = next(iter(where[("hot text " * 30).encode()]))
    rest = [n for s, n in load.items() if s != hot]
    assert max(rest) - min(rest) < 0.05 * max(rest) + 1000
    out = sharding.add_shard(documents(rows).selectExpr("*", "1 AS size", "2 AS _key", "3 AS shard"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "_key", "shard"] and out.count() == len(rows)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def classes(near):
    label = np.arange(len(near))
    while True:
        lower = np.where(near, label[None, :], len(near)).min(1)
        if (lower == label).all():
            return label
        label = lower


def test_simhash_components(documents):
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        base = sentence(rnd, rnd.randrange(1, 150)).split()
        for _ in range(rnd.randrange(1, 6)):
            copy = list(base)
            if rnd.random() < 0.7:
                copy[rnd.randrange(len(copy))] = "Changed"
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (3, "One"), (4, "one"), (5, "ONE two"), (6, "É İ X\u0085y")]
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(rows)).collect()}
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    ids = np.array([i for i, _ in rows])
    label = classes(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    for k, (i, _) in enumerate(rows):
        assert got[i].fingerprint == f"{int(prints[k]):016x}"
        assert got[i].component_id == ids[label == label[k]].min()
    extra = [*rows, (None, "no id at all here"), rows[0], (rows[0][0], "another text under an old id")]
    kept = simhash.keep_one(documents(extra))
    assert kept.columns == documents(extra).columns
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    want = {(False, int(ids[label == c].min())) for c in set(label)}
    assert {x[:2] for x in left} == want | {(True, 0)} and len(left) == len(want) + 2


def test_long_lists_link_like_pairs():
    rng = np.random.default_rng(3)
    high = np.int64(0x0102030405) << np.int64(24)
    free = np.unique(np.concatenate([rng.integers(0, 1 << 24, 600), (0xABCDEF ^ np.array([sum(1 << int(b) for b in rng.choice(24, 5, False)) for _ in range(900)]))]))
    prints = np.sort(high | free.astype(np.int64))
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= 3
    want = prints[classes(near)]
    # little-endian bytes 3..7 are shared
    choice = [c for c, p in enumerate(simhash.combinations(range(8), 5)) if p == (3, 4, 5, 6, 7)][0]
    assert len(prints) > simhash.ALL_PAIRS
    a, b = simhash.link_list(prints, choice)
    found = dict(zip(prints.tolist(), prints.tolist(), strict=True)) | dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [found[int(p)] for p in prints] == want.tolist()


def test_star_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r.node: r.root for r in simhash.star_components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def removed(rows, size=50):
    first = {}
    tokens = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(tokens):
        for j in range(len(tokens[i]) - size + 1):
            first.setdefault(tuple(tokens[i][j:j + size]), i)
    out = {}
    for i, w in tokens.items():
        gone = set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j:j + size])] < i:
                gone.update(range(j, j + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(documents):
    rnd = random.Random(11)
    passages = [sentence(rnd, rnd.randrange(40, 140)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [sentence(rnd, rnd.randrange(0, 90))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages).split()
            cut = rnd.randrange(0, 20)
            parts += [" ".join(p[cut:len(p) - rnd.randrange(0, 20)]), sentence(rnd, rnd.randrange(0, 60))]
        rows.append((rnd.randrange(0, 10_000) * 200 + i, rnd.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(7, "same " * 120), (8, "same " * 80), (9, "same " * 49), (1, None), (2, ""), (3, "\u0085a b\x1cc " * 60), (4, "\u0085a b\x1cc " * 70)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(documents(rows)).collect()}
    assert got == removed(rows)
    assert sum(n for _, n, _ in got.values()) > 1000


def test_substring_dedup_rows_and_ids(documents):
    text = sentence(random.Random(1), 80)
    rows = [(5, text), (5, text), (6, text), (None, text), (6, text + " more")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.remove_repeats(documents(rows)).collect())
    assert got == [(0, 80, 0), (5, 80, 0), (5, 80, 0), (6, 80, 80), (6, 81, 80)]


def test_substring_dedup_long_texts_and_a_common_passage(documents):
    """Texts longer than a chunk, and one passage amid different words in a third of all documents."""
    rnd = random.Random(12)
    long = sentence(rnd, 60_000, 50_000)
    assert len(long) > 2 * substring.CHUNK
    words = long.split()
    rows = [(1, long), (2, " ".join(words[20_000:20_080])), (3, " ".join(["new", *words[100:400], "old"] + words[50_000:])), (4, long + " end")]
    passage = sentence(rnd, 70, 5000)
    rows += [(10 + i, f"{sentence(rnd, rnd.randrange(60), 9000)} {passage if i % 3 == 0 else ''} {sentence(rnd, rnd.randrange(60), 9000)}") for i in range(150)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(documents(rows)).collect()}
    assert got == removed(rows)
    assert sum(n >= 70 for i, (_, n, _) in got.items() if i >= 10) == 49


def line_truth(docs, least=2):
    docs = sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    all_lines = []
    for i, t in docs:
        parts = (t or "").split("\n")
        at = [k for k, x in enumerate(parts) if re.search(r"[^\x20\x09-\x0D]", x)]
        all_lines.append((i, t, parts, at, [parts[k] for k in at]))
    first, times = {}, defaultdict(int)
    for i, _, _, _, seq in all_lines:
        for j in range(len(seq) - least + 1):
            first.setdefault(tuple(seq[j:j + least]), (i, j))
        for j in range(len(seq)):
            for n in range(1, len(seq) - j + 1):
                times[tuple(seq[j:j + n])] += 1
    out = {}
    for i, t, parts, at, seq in all_lines:
        gone = {k for j in range(len(seq) - least + 1) if first[tuple(seq[j:j + least])] != (i, j) for k in range(j, j + least)}
        longest = max((n for j in range(len(seq)) for n in range(1, len(seq) - j + 1) if times[tuple(seq[j:j + n])] > 1), default=0)
        drop = {at[k] for k in gone}
        kept = "\n".join(x for k, x in enumerate(parts) if k not in drop) if gone else t
        out[i] = (len(seq), len(gone), sum(k - 1 not in gone for k in gone), longest, kept)
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(documents, least):
    rnd = random.Random(least)
    rows = [(k, "\n".join(rnd.choice(["a", "b", "c c", " ", "d", "e"]) for _ in range(rnd.randrange(0, 12)))) for k in range(40)]
    rows += [(70, None), (71, ""), (None, "a\nb\nc c\nd\ne"), (90, "q\nw\ne\nr\nt\ny\nu"), (91, "q\nw\ne\nr\nt\ny\nz"), (92, "1\nw\ne\nr\nt\n\ny\nz")]
    got = lines.deduplicate(documents([*rows, rows[3]]), least).collect()
    want = line_truth(rows, least)
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_lines, r.n_deleted, r.n_runs, r.longest_shared, r.kept_text) == want[r.doc_id]


def test_line_dedup_from_one_line_on(documents):
    rnd = random.Random(1)
    rows = [(k, "\n".join(rnd.choice(["a", "b", "c c", " ", f"own {k}", f"x{rnd.randrange(99)}"]) for _ in range(rnd.randrange(0, 12)))) for k in range(40)]
    long = sentence(rnd, 80)
    rows += [(50, long), (51, long), (52, f"first of its own\n{long}\nlast of its own"), (53, None), (54, "only here")]
    want = line_truth(rows, 1)
    got = {r.doc_id: r for r in lines.deduplicate(documents(rows)).collect()}  # the registered rule, no threshold given
    for i, r in got.items():
        assert (r.n_lines, r.n_deleted, r.n_runs, r.longest_shared, r.kept_text) == want[i]
    assert (got[50].n_deleted, got[51].n_deleted, got[51].kept_text, got[52].kept_text) == (0, 1, "", "first of its own\nlast of its own")
    report = {r.doc_id: r.n_deleted for r in lines.line_report(documents(rows)).collect()}
    assert report == {i: r.n_deleted for i, r in got.items()}


def test_tiles_cover_reordered_passages():
    rnd = random.Random(3)
    item = sentence(rnd, 40, 5000)
    w = item.split()
    items = decontam.Items([(1, item), (2, sentence(rnd, 30, 5000)), (3, "one two"), (4, "")])
    assert decontam.covered(items, f"x {item.upper()}! y") == [(1, 1.0, 1)]
    assert decontam.covered(items, " ".join(w[20:] + ["zz"] + w[:20])) == [(1, 1.0, 2)]
    assert decontam.covered(items, " ".join(w[:10])) == []
    assert decontam.covered(items, None) == [] and decontam.covered(items, "and One, two!") == [(3, 1.0, 1)]
    assert decontam.covered(items, " ".join([*w[:15]] * 4)) == []  # a repeated part covers no more than itself


def test_tiles_are_greedy_and_do_not_overlap():
    rnd = random.Random(8)
    for _ in range(100):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(5, 30))] for _ in range(2))
        hits = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i:i + 3] == b[j:j + 3]]
        got = decontam.tiles(hits, 3)
        used_a, used_b, before = set(), set(), 10**9
        for i, j, n in got:
            assert a[i:i + n] == b[j:j + n] and n >= 3 and n <= before
            x, y = set(range(i, i + n)), set(range(j, j + n))
            assert not x & used_a and not y & used_b
            used_a, used_b, before = used_a | x, used_b | y, n
        longest = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                longest = max(longest, n)
        assert longest < 3


def test_decontamination_text_ids_and_blocks(spark, documents, monkeypatch):
    rnd = random.Random(31)
    items = {f"q{k}": sentence(rnd, 30, 100_000) for k in range(6)}
    rows = [(k, f"{sentence(rnd, 40, 100_000)} {items[f'q{k}']} {sentence(rnd, 20, 100_000)}") for k in range(6)] + [(90, sentence(rnd, 200, 100_000))]
    rows.append((91, f"{items['q1']} and {items['q5']}"))
    bench = spark.createDataFrame(list(items.items()), "item_id string, text string")
    want = {k: [f"q{k}"] for k in range(6)} | {91: ["q1", "q5"]}
    for words in (10**6, 70):  # one block, several
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        monkeypatch.setattr(decontam.item_blocks, "__defaults__", (words,))
        assert len(list(decontam.item_blocks(bench))) == (1 if words > 1000 else 3)
        assert {r.doc_id: r["items"] for r in decontam.contaminated(documents(rows), bench).collect()} == want
        assert [r.doc_id for r in decontam.keep_clean(documents(rows), bench).collect()] == [90]


def test_decontamination(spark, documents):
    rnd = random.Random(5)
    items = [(i, sentence(rnd, rnd.randrange(15, 60), 3000)) for i in range(30)]
    benchmark = spark.createDataFrame([*items, (90, items[0][1]), (91, None), (92, " ")], "item_id long, text string")
    rows = []
    for i in range(80):
        text = sentence(rnd, rnd.randrange(5, 300), 3000)
        if i % 4 == 0:
            text = text[:50] + " " + items[i % 30][1] + " " + text[50:]
        rows.append((i, text))
    rows += [(900, None), (901, ""), (None, items[4][1])]
    docs = documents(rows)
    got = {r.doc_id: r.items for r in decontam.contaminated(docs, benchmark).collect()}
    assert got == {i: [i % 30] for i in range(0, 80, 4)} | {None: [4]}
    clean = decontam.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - set(got)
    blocks = list(decontam.item_blocks(benchmark, block_words=100))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == [i for i, _ in items]


def plain_coverage(item, text, tile=5):
    """Greedy tiling by looking for the longest unmarked common run again and again."""
    a, b = decontam.word_list(item), decontam.word_list(text)
    size, free_a, free_b, total = min(tile, len(a)), [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < size:
            return total / len(a)
        total += n
        free_a[i:i + n], free_b[j:j + n] = [False] * n, [False] * n


def test_coverage_against_plain_tiling():
    rnd = random.Random(41)
    seen = 0
    for _ in range(60):
        bench = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 25)))) for k in range(6)]
        bench = list({t: (k, t) for k, t in bench}.values())
        items = decontam.Items(bench)
        text = " ".join(rnd.choice(["a", "b", "c", "zz"]) for _ in range(rnd.randrange(1, 60)))
        want = {k: c for k, t in bench if (c := plain_coverage(t, text)) >= decontam.COVERAGE}
        got = {k: c for k, c, _ in decontam.covered(items, text)}
        assert got == pytest.approx(want)
        seen += len(want)
    assert seen > 30


def test_a_stem_that_all_items_share():
    stem = "which of the following statements about the topic is"
    items = decontam.Items([(i, f"{stem} " + " ".join(f"v{i}x{k}" for k in range(21))) for i in range(50_000)])
    text = " ".join([stem, "one", stem, "two", stem, "three"])
    start = time.process_time()
    for _ in range(5):
        assert decontam.covered(items, text) == []
    assert (time.process_time() - start) / 5 < 0.25
    tail = " ".join(f"v77x{k}" for k in range(21))
    assert decontam.covered(items, f"{text} {tail}") == [(77, 1.0, 2)]
