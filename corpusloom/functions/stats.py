"""Closed-form statistics as Column expressions: Welch's test, Cohen's d and their labels."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def perplexity(loss: Column, cap: float = 100.0) -> Column:
    """exp(loss) below the cap, else infinity."""
    return F.when(loss < cap, F.exp(loss)).otherwise(F.lit(float("inf")))


def pooled_std(n1, s1, n2, s2) -> Column:
    return F.sqrt(F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, (n1 + n2 - 2).cast("double")))


def cohens_d(n1, m1, s1, n2, m2, s2) -> Column:
    return F.try_divide(m1 - m2, pooled_std(n1, s1, n2, s2))


def welch_t(n1, m1, s1, n2, m2, s2) -> Column:
    return F.try_divide(m1 - m2, F.sqrt(s1 * s1 / n1 + s2 * s2 / n2))


def welch_df(n1, s1, n2, s2) -> Column:
    a, b = s1 * s1 / n1, s2 * s2 / n2
    return F.try_divide((a + b) * (a + b), F.try_divide(a * a, (n1 - 1).cast("double")) + F.try_divide(b * b, (n2 - 1).cast("double")))


def two_sided_p(t: Column, df: Column, panels: int = 2000) -> Column:
    """P(|T| >= |t|) of Student's t: with u = atan(|t| / sqrt(df)) it is the share of the integral
    of cos(x)^(df - 1) over 0..pi/2 that lies beyond u. Both integrals by Simpson's rule, over the
    range in which the integrand isn't negligible."""
    half = 1.5707963267948966 - 1e-12
    reach = 10 / F.sqrt(df)
    u = F.atan(F.abs(t) / F.sqrt(df))

    def simpson(a: Column, width: Column) -> Column:
        h = width / panels
        f = lambda i: F.exp((df - 1) * F.ln(F.cos(a + i * h)))
        weight = lambda i: F.when((i == 0) | (i == panels), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(panels)), F.lit(0.0), lambda s, i: s + weight(i) * f(i)) * h / 3

    beyond = simpson(u, F.least(F.lit(half) - u, reach))
    return F.when(t == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), beyond / simpson(F.lit(0.0), F.least(F.lit(half), reach))))


def significance(p: Column, alpha: float = 0.05) -> Column:
    """Null and NaN are not significant."""
    return F.when((p < alpha) & ~F.isnan(p), "significant").otherwise("not_significant")


def effect_class(d: Column) -> Column:
    """Null and NaN are large, as every comparison with them is false."""
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def stars(p: Column) -> Column:
    return F.when((p < 0.05) & ~F.isnan(p), "***").otherwise("ns")


def hash32(c: Column) -> Column:
    """A stable 32-bit number of a value: the leading eight digits of its MD5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")
