"""Personal data: overlapping candidate spans judged by gradient-boosted trees.

Strict patterns find the base spans (email, ip, card, phone) and always stay.  Looser
generators propose further, overlapping spans.  Every proposal has format features (digits,
separators, check digit, value range, plus sign, brackets, top-level domain) and context
features (the characters beside it, a cue word of its kind before it).  Trees of depth two
are boosted with Newton steps on a table of distinct feature vectors with their counts; the
table has at most ``CELLS`` rows, whatever the corpus.  Scores are calibrated by isotonic
regression, and a proposal whose calibrated probability is at least ``CALIBRATED`` is added
unless it overlaps a base span or an earlier added one.

Labels come from two sides.  Of the corpus, proposals equal to a strict base span are
positive; others are negative only where something other than the strict form speaks against
them (``_against``: touching letters or digits, a failed check digit without a cue, an
address out of range or without a domain), and left out where nothing does.  The labelled
``sample`` (a few hundred short texts built from the lists below) holds the forms that the
strict patterns cannot match: local phones and mistyped cards behind a cue, and the same
forms without one.  It weighs as much as the corpus, so that no corpus outvotes it.

Only DataFrame functions touch the texts.  Offsets are running sums over the pieces
between matches (code points, end exclusive).  Patterns are possessive and start at the
start of a run only, so long texts take linear time.

Defined cases: null text is empty; rows repeated in full are judged one by one; a null
doc_id is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_LOOSE = r"^\x20\x09-\x0D@<>()\[\]"
# same matches as the plain patterns: a match can start only at the start of its run of
# characters or right after the match before it
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": rf"(?:(?<![{_LOOSE}])|\G)[{_LOOSE}]++@[{_LOOSE}]++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_RANGE = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_CUE_WORDS = ("e-?mail|mail|contact|address", "ip|host|address", "card|visa|mastercard|amex", "tel|telephone|phone|mobile|cell|call|fax|contact")
CUES = [rf"(?i)(?<![A-Za-z])(?:{w})s?(?:[^A-Za-z0-9]{{1,3}}(?:number|no|nr|at|is|us|me|on)){{0,2}}[^A-Za-z0-9]{{0,3}}$" for w in _CUE_WORDS]

# The labelled sample: (texts before, proposals, texts behind) per kind, first the personal ones.
_LOCAL_PHONES = ("(212) 555-0199", "212-555-0142", "212 555 0142", "030 1234 5678", "0171.555.0123", "2125550142", "44 555 0199")
_PHONE_CUES = ("Tel. ", "phone: ", "Call ", "fax ", "mobile ", "contact us at ", "phone number ")
_WRONG_CARDS = ("4111 1111 1111 1112", "4111111111111112", "4111-1111-1111-1112", "378282246310006")
_PLAIN = ("", "order ", "see page ", "sum of ", "the id ")
_BEHIND = ("", " today", ".", ", then")
SAMPLE = {
    "email": [
        (("", "mail to "), ("jörg@bücher-müller.de", "анна@почта.com"), _BEHIND[:2]),
        (("", "by "), ("x@y", "me@home", "при@мер"), _BEHIND[:2]),
    ],
    "card": [
        (("card ", "Visa: ", "card number "), (*_WRONG_CARDS, "4111 1111 1111 1111"), _BEHIND),
        ((*_PLAIN, "tel "), _WRONG_CARDS, (*_BEHIND, "ab3f")),
    ],
    "phone": [
        (_PHONE_CUES, _LOCAL_PHONES, _BEHIND),
        ((*_PLAIN, "ip ", "card "), (*_LOCAL_PHONES, "20240115"), _BEHIND),
    ],
}
# cued all the same, and still no phone: the beginning of a hex run or of an address
SAMPLE["phone"].append((_PHONE_CUES, ("2125550142", "192.168.100"), ("ab3f", ".300")))
# the strict form, so that the plus sign counts for what it is in the sample too
SAMPLE["phone"][0:0] = [((*_PHONE_CUES, *_PLAIN), ("+1 (212) 555-0199", "+49 30 1234567"), (*_BEHIND, " 4795326016703902"))]
PERSONAL = {"email": 1, "card": 1, "phone": 2}  # so many entries of SAMPLE are personal data

#: features and their number of values
FEATURES = {"plus": 2, "digits": 5, "luhn": 2, "range": 2, "paren": 2, "seps": 4, "left": 4, "right": 4, "tld": 2, "cue": 2}
CELLS = len(KINDS) * math.prod(FEATURES.values())
ROUNDS = 30
RATE = 0.3
SMOOTH = 1.0
CALIBRATED = 0.9


def _hits(source: int, kind: int, pieces: str, matches: str) -> Column:
    return F.transform(F.col(matches), lambda m, i: F.struct(
        F.lit(source).alias("source"), F.lit(kind).alias("kind"), i.alias("nth"),
        F.length(F.get(F.col(pieces), i)).alias("gap"), m.alias("found"),
        F.right(F.get(F.col(pieces), i), F.lit(16)).alias("before"),
        F.left(F.get(F.col(pieces), i + 1), F.lit(2)).alias("after")))


def proposals(docs: DataFrame) -> DataFrame:
    """Matches of all patterns: row, doc_id, source (0 strict, 1 generator), kind, nth, gap, found, before, after.

    A row without a match appears once with nulls.
    """
    text = F.col("_text")
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("row", F.monotonically_increasing_id())
    df = df.withColumn("_digit", text.rlike("[0-9]"))
    hits = []
    for source, patterns in enumerate((STRICT, GENERATORS)):
        for kind, name in enumerate(KINDS):
            gate = F.contains(text, F.lit("@")) if name == "email" else F.col("_digit")
            m, p = f"_m{source}{kind}", f"_p{source}{kind}"
            df = df.withColumn(m, F.when(gate, F.regexp_extract_all(text, F.lit(patterns[name]), F.lit(0))))
            df = df.withColumn(p, F.when(F.size(m) > 0, F.split(text, patterns[name], -1)))
            hits.append(F.coalesce(_hits(source, kind, p, m), F.array()))
    # pieces are used several times below, so the optimiser keeps them as columns of their own
    return df.select("row", "doc_id", F.explode_outer(F.concat(*hits)).alias("h")).select("row", "doc_id", "h.*")


def _side(char: Column) -> Column:
    return (
        F.when(F.coalesce(F.length(char), F.lit(0)) == 0, 0).when(char.rlike(r"^[\x20\x09-\x0D]$"), 0)
        .when(char.rlike(r"^\p{L}$"), 1).when(char.rlike("^[0-9]$"), 2).otherwise(3)
    )


def spans(docs: DataFrame) -> DataFrame:
    """Proposals with start, end, base (strict and valid), features, and for generated ones
    ``same`` (a base span of that kind is equal) and ``clash`` (one of any kind overlaps)."""
    found = materialise(proposals(docs), "pii")
    digits = F.regexp_replace(F.col("found"), "[^0-9]", "")
    n = F.length("_digits")
    valid = (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("range") == 1)
        .when(F.col("kind") == 2, n.between(12, 19) & (F.col("luhn") == 1))
        .otherwise(n.between(9, 15))
    )
    size = F.length("found")
    df = found.withColumn("_digits", digits).withColumn("end", F.expr(
        "sum(gap + length(found)) OVER (PARTITION BY row, source, kind ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    df = df.withColumns({
        "start": F.col("end") - size,
        "plus": F.col("found").startswith("+").cast("int"),
        "digits": F.when(n < 9, 0).when(n < 12, 1).when(n < 16, 2).when(n == 16, 3).otherwise(4),
        "luhn": F.when(n.between(12, 19), F.expr("luhn_check(_digits)").cast("int")).otherwise(0),
        "range": F.col("found").rlike(IP_RANGE).cast("int"),
        "paren": F.contains("found", F.lit("(")).cast("int"),
        "seps": F.least(size - n, F.lit(3)),
        "left": _side(F.right(F.col("before"), F.lit(1))),
        # a point before a further digit goes on with the number
        "right": F.when(F.col("after").rlike("^[.][0-9]"), 2).otherwise(_side(F.left("after", F.lit(1)))),
        "tld": F.col("found").rlike(r"\.[A-Za-z]{2,}$").cast("int"),
        "cue": F.coalesce(*[F.when(F.col("kind") == i, F.col("before").rlike(c).cast("int")) for i, c in enumerate(CUES)]),
    })
    df = df.withColumn("base", F.coalesce((F.col("source") == 0) & valid, F.lit(False)))
    df = df.withColumns({
        "same": F.expr("max(base) OVER (PARTITION BY row, kind, start, end)"),
        "_reach": F.expr("max(CASE WHEN base THEN end END) OVER (PARTITION BY row ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
        "_next": F.expr("min(CASE WHEN base THEN start END) OVER (PARTITION BY row ORDER BY start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    })
    clash = F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))
    # strict matches that fail are gone; the row itself stays
    return df.withColumn("clash", clash).withColumn("real", F.col("base") | (F.col("source") == 1)).select(
        "row", "doc_id", "source", "kind", "start", "end", "base", "same", "clash", "real", *FEATURES)


class Boosted:
    """Boosted trees of depth two over a table of (feature values, positives, negatives)."""

    def __init__(self, cells: list[tuple[tuple[int, ...], int, int]]):
        self.names = list(FEATURES)
        self.cells = cells
        positives, total = sum(p for _, p, _ in cells), sum(p + n for _, p, n in cells)
        self.base = math.log((positives + 0.5) / (total - positives + 0.5))
        self.trees: list[tuple] = []
        score = [self.base] * len(cells)
        for _ in range(ROUNDS):
            slope, bend = [], []
            for s, (_, p, n) in zip(score, cells, strict=True):
                q = 1 / (1 + math.exp(-s))
                slope.append(p - (p + n) * q)
                bend.append((p + n) * q * (1 - q))
            tree = self._grow(list(range(len(cells))), slope, bend, 2)
            self.trees.append(tree)
            score = [s + self._value(tree, x) for s, (x, _, _) in zip(score, cells, strict=True)]
        self.limit = self._calibrate(score)

    def _grow(self, rows: list[int], slope: list[float], bend: list[float], depth: int) -> tuple:
        def gain(g: float, h: float) -> float:
            return g * g / (h + SMOOTH)

        g, h = sum(slope[r] for r in rows), sum(bend[r] for r in rows)
        best = (gain(g, h) + 1e-9, None, None)
        for f in range(len(self.names)) if depth else []:
            by_value: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for r in rows:
                x = by_value[self.cells[r][0][f]]
                x[0] += slope[r]
                x[1] += bend[r]
            a = b = 0.0
            for v in sorted(by_value)[:-1]:
                a, b = a + by_value[v][0], b + by_value[v][1]
                best = max(best, (gain(a, b) + gain(g - a, h - b), f, v), key=lambda t: t[0])
        _, f, v = best
        if f is None:
            return (RATE * g / (h + SMOOTH),)
        low = [r for r in rows if self.cells[r][0][f] <= v]
        high = [r for r in rows if self.cells[r][0][f] > v]
        return (f, v, self._grow(low, slope, bend, depth - 1), self._grow(high, slope, bend, depth - 1))

    def _value(self, tree: tuple, x: tuple[int, ...]) -> float:
        while len(tree) > 1:
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    def _calibrate(self, score: list[float]) -> float:
        """Least score whose isotonic probability is at least CALIBRATED."""
        by_score: dict[float, list[int]] = defaultdict(lambda: [0, 0])
        for s, (_, p, n) in zip(score, self.cells, strict=True):
            by_score[round(s, 6)][0] += p
            by_score[round(s, 6)][1] += p + n
        pools: list[list[float]] = []
        for s in sorted(by_score):
            pools.append([s, *by_score[s]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, p, n = pools.pop()
                pools[-1][1] += p
                pools[-1][2] += n
        return next((s - 1e-5 for s, p, n in pools if p >= CALIBRATED * n), math.inf)

    def score(self) -> Column:
        def column(tree: tuple) -> Column:
            if len(tree) == 1:
                return F.lit(tree[0])
            return F.when(F.col(self.names[tree[0]]) <= tree[1], column(tree[2])).otherwise(column(tree[3]))

        return sum((column(t) for t in self.trees), F.lit(self.base))


def _against() -> Column:
    """What speaks against a proposal of the corpus, whether or not the strict pattern can match its form."""
    touching = F.col("left").isin(1, 2) | F.col("right").isin(1, 2)
    return (
        F.when(F.col("kind") == 0, F.col("tld") == 0).when(F.col("kind") == 1, True)  # the strict pattern has every IP form
        .when(F.col("kind") == 2, touching | ((F.col("luhn") == 0) & (F.col("cue") == 0))).otherwise(touching)
    )


def sample(spark: SparkSession) -> DataFrame:
    """Feature vectors of the labelled sample: kind, features, _yes."""
    rows = [
        (before + found + behind, KINDS.index(kind), len(before), len(before + found), i < PERSONAL[kind])
        for kind, entries in SAMPLE.items() for i, (befores, founds, behinds) in enumerate(entries)
        for before in befores for found in founds for behind in behinds
    ]
    names = ("text", "_kind", "_start", "_end", "_yes")
    texts = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]))
    marked = spark.range(1).select(texts.alias("r")).select("r.*")
    id_ = F.concat_ws(":", "_kind", "_start", "_end", "_yes", "text")
    found = spans(marked.select(id_.alias("doc_id"), "text")).filter("source = 1")
    part = F.split("doc_id", ":")
    here = (part[0] == F.col("kind")) & (part[1] == F.col("start")) & (part[2] == F.col("end"))
    return found.filter(here).select("kind", *FEATURES, (part[3] == "true").alias("_yes"))


def _table(labelled: DataFrame) -> dict[int, dict[tuple[int, ...], tuple[int, int]]]:
    by_kind: dict[int, dict] = defaultdict(dict)
    for r in labelled.groupBy("kind", *FEATURES).agg(
            F.count(F.when(F.col("_yes"), 1)).alias("_p"), F.count(F.when(~F.col("_yes"), 1)).alias("_n")).collect():
        by_kind[r["kind"]][tuple(r[f] for f in FEATURES)] = (r["_p"], r["_n"])
    return by_kind


def train(found: DataFrame) -> dict[int, Boosted]:
    """A model per kind from the feature tables (at most ``CELLS`` rows) of the corpus and the sample."""
    label = F.when(F.col("same"), True).when(~F.col("clash") & _against(), False)
    corpus = _table(found.filter("source = 1").withColumn("_yes", label).filter("_yes IS NOT NULL"))
    known = _table(sample(found.sparkSession))
    models = {}
    for kind in sorted(corpus.keys() | known.keys()):
        a, b = corpus.get(kind, {}), known.get(kind, {})
        size = [sum(p + n for p, n in t.values()) for t in (a, b)]
        weight = max(1, -(-size[0] // max(1, size[1])))
        models[kind] = Boosted([
            (x, a.get(x, (0, 0))[0] + weight * b.get(x, (0, 0))[0], a.get(x, (0, 0))[1] + weight * b.get(x, (0, 0))[1])
            for x in sorted(a.keys() | b.keys())])
    return models


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = materialise(spans(docs), "pii-spans")
    chosen = F.lit(False)
    for kind, model in train(found).items():
        if model.limit < math.inf:
            chosen = chosen | ((F.col("kind") == kind) & (model.score() >= model.limit))
    added = F.coalesce((F.col("source") == 1) & ~F.col("clash") & chosen, F.lit(False))
    df = found.withColumn("_added", added)
    # of overlapping additions the first stays
    before = F.expr("max(CASE WHEN _added THEN end END) OVER (PARTITION BY row ORDER BY start, end, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    df = df.withColumn("_before", before)
    df = df.withColumn("_added", F.col("_added") & (F.coalesce(F.col("_before"), F.lit(-1)) <= F.col("start")))
    name = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    return (
        df.groupBy("row", "doc_id").agg(
            *[F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
            F.collect_list(F.when(F.col("base"), span)).alias("_base"),
            F.collect_list(F.when(F.col("base") | F.col("_added"), span)).alias("_all"))
        .select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"))
    )
