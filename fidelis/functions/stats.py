"""Distribution functions as Column expressions (no scipy on executors) and numpy twins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS_TERMS = 50
KS_SMALL = 0.2  # below this the Kolmogorov survival function equals 1 to 1e-12


def kolmogorov_sf(lam: Column) -> Column:
    """P(K > lam) = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lam^2)."""
    total = None
    for k in range(1, KS_TERMS + 1):
        term = F.exp(F.lit(-2.0 * k * k) * lam * lam)
        term = term if k % 2 == 1 else -term
        total = term if total is None else total + term
    return F.when(lam < KS_SMALL, F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(2.0) * total, F.lit(0.0)), F.lit(1.0)))


def kolmogorov_sf_sql(lam: str) -> str:
    parts = []
    for k in range(1, KS_TERMS + 1):
        term = f"exp(CAST({-2.0 * k * k!r} AS DOUBLE) * ({lam}) * ({lam}))"
        parts.append(term if k == 1 else (f" + {term}" if k % 2 == 1 else f" - {term}"))
    series = "".join(parts)
    return f"(CASE WHEN ({lam}) < {KS_SMALL} THEN 1.0 ELSE least(greatest(2.0 * ({series}), 0.0), 1.0) END)"


def kolmogorov_sf_np(lam: float) -> float:
    if lam < KS_SMALL:
        return 1.0
    s = sum((1 if k % 2 else -1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, KS_TERMS + 1))
    return min(max(2.0 * s, 0.0), 1.0)


ERFC_SPLIT = 3.0
ERFC_TERMS = 60


def erfc(x: Column) -> Column:
    """Complementary error function to double precision: Kummer's series of erf up to
    ``ERFC_SPLIT``, Laplace's continued fraction beyond it."""
    z = F.abs(x)
    return _erfc(x, z, F.lit(2.0) * z * z)


def _erfc(x: Column, z: Column, y: Column) -> Column:
    """``erfc`` from x, |x| and 2 x^2; either branch is taken only on its own side of the split."""
    series = F.lit(1.0)
    for n in range(ERFC_TERMS, 0, -1):
        series = F.lit(1.0) + y / F.lit(2.0 * n + 1) * series
    small = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * z * F.exp(-z * z) * series
    tail = z
    for n in range(ERFC_TERMS, 0, -1):
        tail = z + F.lit(n / 2.0) / tail
    large = F.exp(-z * z) / (F.lit(math.sqrt(math.pi)) * tail)
    ans = F.when(z <= ERFC_SPLIT, small).otherwise(large)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def with_normal_cdf(df: DataFrame, columns: Sequence[str], also: Sequence[Column]) -> DataFrame:
    """``also`` and ``normal_cdf`` of each of ``columns``, under their names.  What every term of the series uses is a column of an
    earlier step, so it is computed once and not once a term."""
    rest = [c for c in df.columns if c not in columns]
    out = df.select(*rest, *[(-F.col(c) / F.lit(math.sqrt(2.0))).alias(f"_x_{c}") for c in columns])
    out = out.select("*", *[f for c in columns for x in [F.col(f"_x_{c}")] for f in (F.abs(x).alias(f"_a_{c}"), (F.lit(2.0) * x * x).alias(f"_y_{c}"))])
    return out.select(*also, *[(F.lit(0.5) * _erfc(*[F.col(f"_{n}_{c}") for n in "xay"])).alias(c) for c in columns])


def normal_cdf(x: Column) -> Column:
    """Phi(x) = erfc(-x / sqrt 2) / 2."""
    return F.lit(0.5) * erfc(-x / F.lit(math.sqrt(2.0)))


def two_sided_p(t: Column) -> Column:
    """p = 2 (1 - Phi(|t|)) = erfc(|t| / sqrt 2), which keeps its digits in the tail."""
    return erfc(F.abs(t) / F.lit(math.sqrt(2.0)))


def erfc_np(x: float) -> float:
    return math.erfc(x)


def chi2_quantile_wh(p: float, df: int) -> float:
    """Wilson-Hilferty approximation of the chi-square quantile."""
    z = normal_quantile(p)
    a = 2.0 / (9.0 * df)
    return df * (1.0 - a + z * math.sqrt(a)) ** 3


def normal_quantile(p: float) -> float:
    """Acklam's rational approximation refined by one Newton step (|err| < 1e-12)."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
         -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
         -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
         4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
    lo, hi = 0.02425, 1 - 0.02425
    if p < lo:
        q = math.sqrt(-2 * math.log(p))
        x = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    elif p > hi:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    else:
        q = p - 0.5
        r = q * q
        x = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / \
            (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    e = 0.5 * math.erfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)
