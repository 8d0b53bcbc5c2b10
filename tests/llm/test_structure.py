"""License scans, periodic runs and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from fidelis.llm import conversations, licenses, periodic
from tests.conftest import SF_SMALL
from tests.llm.conftest import sentence

BLANK = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------ licenses

def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()]
             for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def check_base(rows, got):
    assert len(rows) == len(got)
    want = sorted(((r[0], *license_base(r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score == 1.0) or not r.n_base


def test_license_base_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = licenses.license_report(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    assert any(r.n_base for r in got)


def test_license_cases(documents):
    rnd = random.Random(8)
    rows = [
        (1, None), (2, ""), (3, "MIT license mit-License\nGNU general, public license; CC BY"), (4, "cc by cc by cc by"),
        (5, "ＭＩＴ license émit license mit\xa0license"), (None, "apache license"), (6, "gnu general public"),
        (7, sentence(rnd, 60_000) + " the Apache License " + sentence(rnd, 10)), (8, "permitlicense MIT_LICENSE"),
    ] + [(9, "gnu general public license")] * 3 + [(100 + i, "MIT License " * 50) for i in range(60)]
    clash = documents(rows).selectExpr("*", "1 AS tid", "2 AS pos", "3 AS _w", "4 AS n_words")
    check_base(rows, licenses.license_report(clash).collect())
    assert licenses.license_report(documents(rows[:0])).count() == 0


def test_license_notices(documents):
    rnd = random.Random(9)
    mit = dict(licenses.NOTICES)["mit"].split()
    changed = [w for i, w in enumerate(mit) if i % 30 != 7]  # words left out: neighbouring diagonals
    added = [x for i, w in enumerate(mit) for x in ([w, "indeed"] if i % 25 == 3 else [w])]
    half = mit[: int(len(mit) * 0.3)]
    rows = [(1, sentence(rnd, 30) + " " + " ".join(changed)), (2, " ".join(added)), (3, " ".join(half)),
            (4, " ".join(sorted(mit))), (5, sentence(rnd, 400)), (6, " ".join(mit) + " " + sentence(rnd, 50) + " " + dict(licenses.NOTICES)["bsd"])]
    got = {r.doc_id: r for r in licenses.scan(documents(rows)).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4, 5, 6)] == ["mit", "mit", "", "", "", "bsd,mit"]
    assert got[6].score == 1.0 and 0.5 < got[1].score < 1 and 0.2 < got[3].score < 0.5 and got[5].score < 0.1
    span = next(s for s in got[6].spans if s.label == "mit")
    assert (span.start, span.end, span.covered) == (0, len(licenses.library({}, [("mit", " ".join(mit))])) + 3, 1.0)
    spread = licenses.LIBRARY
    try:
        licenses.LIBRARY = 0  # the templates by shuffle
        assert {r.doc_id: r for r in licenses.scan(documents(rows)).collect()} == got
    finally:
        licenses.LIBRARY = spread


# ------------------------------------------------------------------ periodic runs

def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def run_row(doc_id, text):
    w = re.findall(BLANK, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def mixed_words(rnd):
    out, k = [], rnd.choice([1, 2, 3, 30])
    for _ in range(rnd.randrange(8)):
        if rnd.random() < 0.4:
            out += [f"w{rnd.randrange(k)}" for _ in range(rnd.randrange(40))]
        else:
            p = [f"w{rnd.randrange(k)}" for _ in range(rnd.randrange(1, 14))]
            n = rnd.randrange(1, 120)
            out += (p * (n // len(p) + 1))[:n]
        if rnd.random() < 0.2 and out:
            out += out[-rnd.randrange(1, 60):] * rnd.randrange(1, 4)
    return out


def test_runs_against_all_periods():
    rnd = random.Random(11)
    for _ in range(150):
        docs = [mixed_words(rnd) for _ in range(rnd.randrange(1, 6))]
        for w, got in zip(docs, periodic._batch(docs)):
            assert [tuple(r) for r in got.tolist()] == plain_runs(w), w


def test_grammar_has_no_repeated_pair_and_covers_each_node_once():
    rnd = random.Random(12)
    for _ in range(40):
        w = mixed_words(rnd) or ["x"]
        numbers, starts = periodic._numbers([w])
        nodes, begin, left = periodic.repair_rounds(numbers, starts)
        derived = {}
        for s, m, e, rule in nodes:
            for a, b, c, r in zip(*(x.tolist() for x in (s, m, e, rule))):
                derived.setdefault(r, set()).add((tuple(w[a:b]), tuple(w[b:c])))
        assert all(len(x) == 1 for x in derived.values())  # equal rules derive equal words, cut at one place
        left = left.tolist()
        assert len(left) == len(begin) - 1
        pairs = [p for i, p in enumerate(itertools.pairwise(left)) if not (i and left[i - 1] == p[0] == p[1])]
        assert len(pairs) == len(set(pairs))


def test_runs_of_the_table_and_cases(spark, documents):
    rnd = random.Random(13)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = [run_row(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in periodic.run_report(docs).collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0]) and sum(r[1] for r in got) > 10
    tenth = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, sentence(rnd, rnd.randrange(0, 200), 50)) for i in tenth] + [(None, "a " * 30), (1, None), (2, ""), (3, " \n\t"), (3, " \n\t"),
            (4, "x" * 100_000 + " y" * 40), (tenth[0], "one"), (5, " ".join(sentence(rnd, 700, 9000) for _ in range(3))), (6, " ".join([sentence(rnd, 900, 9000)] * 4))]
    clash = documents(rows).selectExpr("*", "1 AS start", "2 AS words", "3 AS runs")
    got = [tuple(r) for r in periodic.run_report(clash).collect()]
    assert sorted(got, key=str) == sorted((run_row(i, t) for i, t in rows), key=str)
    full = {r.doc_id: r for r in periodic.find_runs(documents(rows)).collect()}
    assert [tuple(x) for x in full[None].runs] == [(0, 30, 1)] and full[None].text == "a"
    assert periodic.run_report(documents(rows[:0])).count() == 0


def test_long_repetitive_text(documents):
    w = "to be or not".split() * 30_000
    r = periodic.find_runs(documents([(1, " ".join(w)), (2, "z " * 50_000)])).collect()
    assert sorted((x.doc_id, *map(tuple, x.runs), x.text) for x in r) == [(1, (0, 120_000, 4), "to be or not"), (2, (0, 50_000, 1), "z")]


# ------------------------------------------------------------------ conversations

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, role, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """rows (role, text) in order: faults, and the cheapest repair by search over rows, left to right."""
    seen, faults = set(), []
    for role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # role initials so far (reduced to their last state) -> cost, audit, repaired
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def relax(table):
        todo = list(table)
        while todo:
            p = todo.pop()
            for c, role in (("u", "user"), ("a", "assistant")):
                q = step.get((p, c))
                if q:
                    cost, audit, rows_ = table[p]
                    new = (cost + 3, audit + "I", (*rows_, f"{role}:"))
                    if q not in table or new[:2] < table[q][:2]:
                        table[q] = new
                        todo.append(q)

    relax(best)
    for (role, text), fault in zip(rows, faults):
        after = {}

        def put(q, new):
            if q not in after or new[:2] < after[q][:2]:
                after[q] = new

        for p, (cost, audit, done) in best.items():
            put(p, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (p, role[:1]) in step:
                put(step[p, role[:1]], (cost + more, audit + "K", (*done, f"{role}:{text}")))
            for c, name in (("u", "user"), ("a", "assistant")):
                if (p, c) in step:
                    put(step[p, c], (cost + 3 + more, audit + "R", (*done, f"{name}:{text}")))
        relax(after)
        best = after
    cost, audit, done = min(best[q] for q in ("", "a") if q in best)
    return faults, cost, audit, "\n".join(done)


def conversation_rows(rows):
    out = []
    for conv in sorted({r[0] for r in rows}, key=str):
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[3], r[4]))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, cost, audit, text = plain_repair([(r[3], r[4]) for r in mine])
        bad = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_conversations_of_the_table(spark):
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    got = sorted(map(tuple, conversations.repair_report(turns).collect()))
    assert got == sorted(conversation_rows([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]))
    assert len({r[7] for r in got}) > 10


SCHEMA = "conv_id long, turn long, role string, text string, conv int, pos int, _hash string, audit string"


def test_conversation_cases(spark):
    rnd = random.Random(14)
    texts = ["Yes.", "No!", "cut", " ", "", None, "é\x85", "Why? ", "x.\n"]
    roles = ["system", "user", "assistant", "User", "", None, "tool", "support", "ugly"]
    rows = []
    for conv in [*range(60), None]:
        weights = [4, 8, 8, 1, 1, 1, 1, 1, 1]
        n = rnd.choice([0, 1, 2, 3, 5, 9, 14, 40])
        rows += [(conv, rnd.choice([None, i, i, i, i + 1]), rnd.choices(roles, weights)[0], rnd.choice(texts) if rnd.random() < 0.4 else f"t{i}.") for i in range(n)]
    rows += [(100, i, ("user", "assistant")[i % 2], f"{i} words." if i % 7 else "cut") for i in range(700)]  # many blocks
    rows += [(101, 1, "user", "same.")] * 30 + [(102, None, "user", "é" * 100_000 + ".")]
    drops = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(drops, 1, "user", "gone.")]
    turns = spark.createDataFrame([(*r, 1, 2, "h", "a") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in conversations.repair_report(turns).collect()), key=str)
    assert got == sorted(conversation_rows(rows), key=str)
    assert next(r for r in got if r[0] == drops)[1:] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_report(turns.limit(0)).count() == 0


@pytest.mark.parametrize("symbols", ["", "u", "sUxad", "aauuss", "dxXSa", "uauaUAdsx"])
def test_every_split_gives_the_same_cell(symbols):
    whole = conversations.block_cell(symbols)
    for k in range(len(symbols) + 1):
        assert conversations.product(conversations.block_cell(symbols[:k]), conversations.block_cell(symbols[k:])) == whole


def test_cells_against_all_edits():
    for symbols in map("".join, itertools.product("suaxUd", repeat=2)):
        best = None
        for edits in itertools.product("KRrD", repeat=2):  # r: to assistant
            marks, cost = [], 0
            for s, e in zip(symbols, edits):
                if s == "d" and e != "D" or s == "x" and e == "K":
                    break
                cost += {"K": 0, "D": 4}.get(e, 3) + (3 if s == "U" and e != "D" else 0)
                marks.append({"K": s.lower(), "R": "u", "r": "a", "D": ""}[e])
            else:
                # insertions: up to two rows at each of the three places
                for ins in itertools.product(["", "u", "a", "ua", "au"], repeat=3):
                    roles = ins[0] + "".join(m + i for m, i in zip(marks, ins[1:]))
                    if re.fullmatch("(s?(ua)+)?", roles):
                        audit = "I" * len(ins[0]) + "".join(e.upper() + "I" * len(i) for e, i in zip(edits, ins[1:]))
                        found = (cost + 3 * sum(map(len, ins)), audit)
                        best = found if best is None else min(best, found)
        cell = conversations.block_cell(symbols)
        assert min(cell[k] for k in ((0, 0), (0, 3)) if k in cell) == best, symbols


def test_insertion_closure():
    assert conversations.EMPTY[0, 3] == (6, "II") and conversations.EMPTY[2, 3] == (3, "I") and (3, 0) not in conversations.EMPTY
    assert np.all([conversations.EMPTY[p, p] == (0, "") for p in range(4)])
