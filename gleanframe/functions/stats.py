"""Statistical expressions that keep null, constant and tiny inputs from raising."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleanframe.session import local_frame


def sample_std(c: Column) -> Column:
    """Sample deviation, 0.0 for a single value, null without values."""
    return F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))


def skewness_adjusted(c: Column) -> Column:
    """Bias-corrected skewness, 0.0 up to two values or without variation."""
    n = F.count(c).cast("double")
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.coalesce(F.skewness(c), F.lit(0.0)) * factor).when(n > 0, F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over complete pairs, null when one side does not vary.

    ``corr`` raises on a constant column in ANSI mode, this form does not.
    """
    return F.try_divide(F.regr_sxy(b, a), F.sqrt(F.regr_sxx(b, a) * F.regr_syy(b, a)))


def correlation_strength(r: Column, strong: float = 0.7, moderate: float = 0.4) -> Column:
    return (
        F.when(F.abs(r) >= strong, "strong").when(F.abs(r) >= moderate, "moderate").otherwise("weak")
    )


def fit_from_moments(n: Column, sxx: Column, syy: Column, sxy: Column) -> dict[str, Column]:
    """Slope, R², standard error and t of a least-squares line from centred sums.

    A constant y has R² 0; an exact fit has a standard error of 0.  Sums that infinite values
    made infinite or NaN give null.
    """
    sound = ~F.isnan(sxy - sxy) & ~F.isnan(syy - syy)
    sxx, syy, sxy = (F.when(sound, c) for c in (sxx, syy, sxy))
    slope = F.try_divide(sxy, sxx)
    share = F.coalesce(F.try_divide(sxy * sxy, sxx * syy), F.when(syy.isNotNull(), F.lit(0.0)))
    r2 = F.when(share.isNotNull(), F.least(share, F.lit(1.0)))
    stderr = F.sqrt(F.greatest(F.try_divide((1 - r2) * syy, sxx * (n - 2)), F.lit(0.0)))
    return {"slope": slope, "r2": r2, "stderr": stderr}


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Lentz continued fraction for the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t, exact for small df, normal for huge df."""
    from math import erfc, lgamma

    t = np.abs(np.asarray(t, dtype=float))
    df = np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    for i, (ti, ni) in enumerate(zip(t.flat, df.flat)):
        if np.isnan(ti) or not ni > 0:
            continue
        if np.isinf(ti):
            out.flat[i] = 0.0
            continue
        if ni > 1e7:
            out.flat[i] = erfc(ti / np.sqrt(2.0))
            continue
        a, b, x = ni / 2.0, 0.5, ni / (ni + ti * ti)
        log_front = (
            lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)
            if 0.0 < x < 1.0 else -np.inf
        )
        if x < (a + 1.0) / (a + b + 2.0):
            frac = _beta_fraction(np.array([a]), b, np.array([x]))[0]
            out.flat[i] = np.exp(log_front) * frac / a
        else:
            frac = _beta_fraction(np.array([b]), a, np.array([1.0 - x]))[0]
            out.flat[i] = 1.0 - np.exp(log_front) * frac / b
    return np.clip(out, 0.0, 1.0)


def slope_p_values(slope: Sequence[float], stderr: Sequence[float], n: Sequence[int]) -> list[float]:
    """1 for a flat line, 0 for an exact one, Student's t with n - 2 degrees of freedom in between."""
    slope, stderr = np.asarray(slope, dtype=float), np.asarray(stderr, dtype=float)
    t = np.divide(slope, stderr, out=np.full(slope.shape, np.inf), where=stderr != 0)
    p = student_two_sided(t, np.asarray(n, dtype=float) - 2)
    return [float(v) for v in np.where(slope == 0, 1.0, np.where(stderr == 0, 0.0, p))]


def with_p_value(fits: DataFrame, name: str = "p_value") -> DataFrame:
    """Add the p-value of ``slope`` to fitted lines, of which there is one per column.

    Neither SQL nor Spark has Student's distribution; the few rows are finished on the
    driver, which is quicker than a Python worker for each of them.
    """
    rows = fits.collect()
    p = slope_p_values([r["slope"] for r in rows], [r["stderr"] for r in rows], [r["n"] for r in rows])
    schema = StructType([*fits.schema.fields, StructField(name, DoubleType())])
    return local_frame(fits.sparkSession, [(*r, v) for r, v in zip(rows, p)], schema)
