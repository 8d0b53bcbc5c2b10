"""Quality rules by robust multivariate outliers.

Per document the word, symbol, duplicate-line and repeated-window counts are taken from
the whole text.  Documents that break a base rule fail.  Of the rest, four transformed
statistics form a vector, and for every language and source the minimum-covariance-
determinant estimate of its mean and covariance is sought from several starts at once: the
medians with interquartile scales, the covariances of tanh-squashed vectors and of their
spatial signs, and ``HANDFULS`` handfuls of hash-chosen rows.  A C-step keeps the share
``SUPPORT`` of rows with the smallest distance and re-estimates.  After two steps the
``FINALISTS`` starts of least determinant go on, each until its log determinant stops
falling; the least one of a group is its estimate, followed by one reweighting step over
the rows within the ``REWEIGHT`` quantile.  Starts are rows of one table and every step
reads all rows of the groups that still improve.

A document is rejected when its squared Mahalanobis distance exceeds the chi-square
quantile at 1 - ``TAIL``.  The covariance it is held against is its group's plus the
sampling variance of its own statistics (one symbol, equal line or repeated window of a
short text is chance), so short documents are not outliers for one event.

All steps are DataFrame aggregations of the narrow statistics table; the Cholesky factors
and the distances are column expressions.  Standard deviations have a floor (``FLOORS``)
that guards against a zero variance: most documents have no symbol, equal line or repeated
window at all.  Groups of fewer than ``SMALL`` rows share the estimate of the small groups
of their language.

Defined cases: null text has no words and fails the base rules; null language or source
is a group of its own; rows repeated in full count as often as they occur and share one
verdict; a very long text is one vector like any other; an empty table gives an empty
result; other columns, whatever their names, pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import lookup_join, materialise, words

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"

FEATURES = ("_x0", "_x1", "_x2", "_x3")
FLOORS = (0.05, 0.05, 0.05, 0.05)
SUPPORT = 0.75
HANDFULS = 6
HANDFUL_ROWS = 12
FINALISTS = 3
REWEIGHT = 0.975
LEAST_FALL = 1e-6  # of a log determinant; smaller falls end a search
WORD_SPREAD = 0.3  # squared coefficient of variation of word lengths
TAIL = 1e-4
SMALL = 30
ACCURACY = 10_000


def _chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function for even degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, d // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def _chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, d) < p else (low, mid)
    return high


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _n_lines, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_w", words(F.col("text")))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    window = F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
        lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(WINDOW)]),
    )
    df = df.withColumn("_h", F.when(F.col("n_words") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    # positions of windows found twice or more: sort (hash, position), compare neighbours
    df = df.withColumn("_s", F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.transform("_s", lambda x, i: F.when(
            (F.get(F.col("_s"), i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(F.col("_s"), F.greatest(i - 1, F.lit(0)))["h"] == x["h"])), x["i"])),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(twice)))
    cover = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    df = df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long"))
    return df.withColumns({
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT),
    }).drop("_w", "_h", "_s", "_p", "_lines")


def _vector(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")
    return df.withColumns({
        "_x0": F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))),
        "_x1": F.log1p(F.col("n_symbols") * 10 / n),
        "_x2": F.sqrt(F.col("n_dup_lines") / lines),
        "_x3": F.sqrt(F.col("n_repeat_words") / n),
    })


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector from columns _m*, _l** (Cholesky factor)."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * z[j]
        z.append(rest / F.col(f"_l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians, floored interquartile scales as a diagonal factor, and the number of rows _n."""
    quart = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.percentile_approx(x, [0.25, 0.5, 0.75], ACCURACY).alias(f"_q{i}") for i, x in enumerate(FEATURES)])
    cols = []
    for i in range(len(FEATURES)):
        cols.append(F.get(f"_q{i}", F.lit(1)).alias(f"_m{i}"))
        for j in range(i):
            cols.append(F.lit(0.0).alias(f"_l{i}{j}"))
        cols.append(F.greatest((F.get(f"_q{i}", F.lit(2)) - F.get(f"_q{i}", F.lit(0))) / 1.349, F.lit(FLOORS[i])).alias(f"_l{i}{i}"))
    return quart.select(*keys, "_n", *cols)


def _starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Starting estimates: one row per ``keys`` and _start with _m*, _l**."""
    medians = materialise(_medians(rows, keys).coalesce(8), "mcd")
    d = range(len(FEATURES))
    z = [(F.col(x) - F.col(f"_m{i}")) / F.col(f"_l{i}{i}") for i, x in enumerate(FEATURES)]
    norm = F.sqrt(F.greatest(sum((v * v for v in z[1:]), z[0] * z[0]), F.lit(1e-12)))

    def entry(start: int, values: list[Column]) -> Column:
        return F.struct(F.lit(start).alias("_start"), *[v.alias(x) for v, x in zip(values, FEATURES, strict=True)])

    tries = [
        entry(1, [F.col(f"_m{i}") + F.col(f"_l{i}{i}") * F.tanh(z[i]) for i in d]),
        entry(2, [F.col(f"_m{i}") + F.col(f"_l{i}{i}") * z[i] / norm for i in d]),
    ]
    own = [c for c in rows.columns if c not in keys]
    for k in range(HANDFULS):
        chance = F.pmod(F.xxhash64(F.lit(k), *own), F.lit(1 << 31)) * F.col("_n") < F.lit(HANDFUL_ROWS << 31)
        tries.append(F.when(chance, entry(3 + k, [F.col(x) for x in FEATURES])))
    each = lookup_join(rows, medians, keys).select(*keys, F.explode(F.filter(F.array(*tries), lambda t: t.isNotNull())).alias("_t")).select(*keys, "_t.*")
    found = _estimate(each, [*keys, "_start"], 1.0).drop("_det")
    return medians.drop("_n").withColumn("_start", F.lit(0)).unionByName(found)


def _estimate(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean, Cholesky factor of the covariance (times ``factor``, variances floored) and its log determinant _det per group."""
    d = len(FEATURES)
    aggs = [F.avg(x).alias(f"_m{i}") for i, x in enumerate(FEATURES)]
    aggs += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"_c{i}{j}") for i in range(d) for j in range(i + 1)]
    df = rows.groupBy(*keys).agg(*aggs)
    for i in range(d):
        for j in range(i + 1):
            cov = F.col(f"_c{i}{j}") * factor
            if i == j:
                cov = F.greatest(cov, F.lit(FLOORS[i] ** 2))
            for k in range(j):
                cov = cov - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            # rounding must not take a pivot below a small part of its floor
            value = F.sqrt(F.greatest(cov, F.lit((FLOORS[i] / 10) ** 2))) if i == j else cov / F.col(f"_l{j}{j}")
            df = df.withColumn(f"_l{i}{j}", value)
    logs = [F.log(f"_l{i}{i}") for i in range(d)]
    return df.withColumn("_det", 2 * sum(logs[1:], logs[0])).drop(*[f"_c{i}{j}" for i in range(d) for j in range(i + 1)])


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal vectors consistent."""
    d = len(FEATURES)
    return share / _chi2_cdf(_chi2_quantile(share, d), d + 2)


def _far(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with _start and _d2, once per estimate that ``params`` holds of their group (none: left out)."""
    values = [c for c in params.columns if c not in keys]
    tries = params.groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias("_t"))  # at most 3 + HANDFULS a group
    each = lookup_join(rows.select(*keys, *FEATURES), tries, keys).select(*keys, *FEATURES, F.explode("_t").alias("_t"))
    return each.select(*keys, *FEATURES, "_t.*").withColumn("_d2", _distance()).select(*keys, "_start", *FEATURES, "_d2")


def _concentrate(rows: DataFrame, params: DataFrame, keys: list[str], support: float) -> DataFrame:
    """One C-step of every estimate in ``params``."""
    one = [*keys, "_start"]
    far = _far(rows, params, keys)
    cut = materialise(far.groupBy(*one).agg(F.percentile_approx("_d2", support, ACCURACY).alias("_cut")).coalesce(8), "mcd-cut")
    near = lookup_join(far, cut, one).filter("_d2 <= _cut")
    return materialise(_estimate(near, one, _consistency(support)).coalesce(8), "mcd")


def raw_mcd(rows: DataFrame, keys: list[str], support: float = SUPPORT) -> DataFrame:
    """Estimate of least determinant per ``keys``: one row a group with _m*, _l**, _det, _start."""
    params = materialise(_starts(rows, keys).coalesce(8), "mcd")
    for _ in range(2):
        params = _concentrate(rows, params, keys, support)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_det", "_start"))
    state = materialise(params.withColumn("_place", place).filter(F.col("_place") <= FINALISTS).drop("_place").coalesce(8), "mcd")
    state = state.withColumn("_falls", F.lit(True))
    values = [c for c in state.columns if c not in (*keys, "_start", "_falls")]
    rank = ["_det", *[c for c in values if c != "_det"]]
    # ends: a search goes on only while its determinant falls by LEAST_FALL, and FLOORS bound it below
    while not (active := state.filter("_falls").drop("_falls")).isEmpty():
        after = _concentrate(rows, active, keys, support)
        both = state.select(*keys, "_start", *values).withColumn("_new", F.lit(False)).unionByName(after.withColumn("_new", F.lit(True)))
        least = F.min(F.struct(*rank)).alias("_best")
        before, now = (F.min(F.when(F.col("_new") == new, F.col("_det"))) for new in (False, True))
        falls = F.coalesce(before - now > LEAST_FALL, F.lit(False))  # a search at rest has no new row
        state = materialise(both.groupBy(*keys, "_start").agg(least, falls.alias("_falls")).select(*keys, "_start", "_best.*", "_falls").coalesce(8), "mcd")
    best = F.min(F.struct(*rank[:1], "_start", *rank[1:])).alias("_best")
    return materialise(state.groupBy(*keys).agg(best).select(*keys, "_best.*").coalesce(8), "mcd")


def mcd(rows: DataFrame, keys: list[str], support: float = SUPPORT) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate per ``keys``: one row a group with _m*, _l**, _det."""
    far = _far(rows, raw_mcd(rows, keys, support), keys)
    near = far.filter(F.col("_d2") <= _chi2_quantile(REWEIGHT, len(FEATURES)))
    return materialise(_estimate(near, keys, _consistency(REWEIGHT)).coalesce(8), "mcd")


KEYS = ["_lang", "_source", "_small"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it and wherever the optimiser moves the column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _own_distance() -> Column:
    """Squared distance of the row's vector under its group's covariance plus the sampling variance of its own statistics.

    A factor's entry uses those before it twice and more; as plain columns a filter on the distance
    would unfold them into an expression too large to be compiled, so every entry is bound once.
    """
    n, lines = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")
    symbol = 10 / n / (1 + F.col("n_symbols") * 10 / n)
    own = [
        WORD_SPREAD / n,
        symbol * symbol * (F.col("n_symbols") + 1),  # a count varies by itself
        1 / (4 * lines),  # square root of a share of L
        2 / (4 * n),  # the same for words, which repeat in pairs of places
    ]
    d = len(FEATURES)
    l, z = {}, []  # noqa: E741

    def entry(i: int, j: int) -> Column:
        rest = sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j + 1)), F.lit(0.0))
        if i == j:
            rest = rest + own[i]
        for k in range(j):
            rest = rest - l[i, k] * l[j, k]

        def following(value: Column) -> Column:
            l[i, j] = value
            return entry(i, j + 1) if j < i else solved(i)

        return _let(F.sqrt(rest) if i == j else rest / l[j, j], following)

    def solved(i: int) -> Column:
        rest = F.col(FEATURES[i]) - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - l[i, j] * z[j]

        def following(value: Column) -> Column:
            z.append(value)
            return entry(i + 1, 0) if i + 1 < d else sum((v * v for v in z[1:]), z[0] * z[0])

        return _let(rest / l[i, i], following)

    return entry(0, 0)


class Estimates:
    """Group sizes and MCD estimates of a corpus, both one row per language and source."""

    def __init__(self, stats: DataFrame):
        passed = stats.filter(~F.col("base_failed"))
        self.sizes = materialise(
            passed.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n")).coalesce(8), "quality-groups")
        self.params = mcd(self._grouped(passed).select(*KEYS, *FEATURES, F.xxhash64("doc_id").alias("_r")), KEYS)

    def _grouped(self, df: DataFrame) -> DataFrame:
        # a row whose group has no row that passes goes with the small groups
        small = F.coalesce(F.col("_n"), F.lit(0)) < SMALL
        return (
            lookup_join(df, self.sizes, ["_lang", "_source"]).withColumn("_small", small)
            .withColumn("_source", F.when(~F.col("_small"), F.col("_source"))).drop("_n")
        )

    def judge(self, stats: DataFrame) -> DataFrame:
        """``stats`` with distance2 and kept."""
        limit = _chi2_quantile(1 - TAIL, len(FEATURES))
        far = lookup_join(self._grouped(stats), self.params.drop("_det"), KEYS)
        far = far.withColumn("distance2", F.when(~F.col("base_failed"), _own_distance()))
        # one CASE over both sides of the join: a conjunct on base_failed alone would be pushed below
        # the statistics, and the optimiser would unfold them there for every window of a text
        good = F.when(F.coalesce(F.col("distance2"), F.lit(0.0)) > limit, False).otherwise(~F.col("base_failed"))
        return far.withColumn("kept", F.when(F.col("_l00").isNull(), ~F.col("base_failed")).otherwise(good))


def _statistics(docs: DataFrame, *carry: Column) -> DataFrame:
    plain = docs.select(*carry, "doc_id", "text", F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    return _vector(text_statistics(plain)).drop("text")


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, distance2."""
    stats = materialise(_statistics(docs), "quality")
    return Estimates(stats).judge(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged.

    Rows and statistics are written together once; the estimates read the statistics only.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    stats = materialise(_statistics(docs, row), "quality")
    return Estimates(stats).judge(stats).filter("kept").select("_row.*")
