"""Column expressions shared by the operators. Missing is NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826  # consistent with the standard deviation of normal data


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x) -> Column:
    """NaN becomes NULL."""
    x = col(x)
    return F.when(~F.isnan(x), x)


def share(condition: Column, over_known: Column | None = None) -> Column:
    """Share of rows for which condition holds; NULL counts as false. over_known: only rows where it is not NULL count."""
    hit = F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)
    return F.avg(hit if over_known is None else F.when(over_known.isNotNull(), hit))


def clip(x, low=None, high=None) -> Column:
    """x held between two bounds; NULL stays NULL (greatest and least alone would skip it)."""
    x = col(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return F.when(x.isNotNull(), out)


def mean_of(*columns) -> Column:
    """Mean across columns that skips NULL; NULL if all are."""
    cs = [col(c) for c in columns]
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs]), n)


def quantile(x, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(col(x), F.lit(q))


def hours_between(late, early) -> Column:
    return (F.unix_micros(col(late).cast("timestamp")) - F.unix_micros(col(early).cast("timestamp"))) / F.lit(3_600_000_000.0)


def season(ts) -> Column:
    """core winter (Dec-Feb), spring (Mar, Apr), summer (May-Aug), autumn (Sep-Nov)."""
    m = F.month(col(ts))
    return F.when(m.isin(12, 1, 2), "core_winter").when(m.isin(3, 4), "spring").when(m.isin(5, 6, 7, 8), "summer").when(m.isNotNull(), "autumn")


def winter_label(ts) -> Column:
    """'23/24' for December 2023 to February 2024; an empty string outside the core winter and for NULL."""
    m, y = F.month(col(ts)), F.year(col(ts))
    end = y + (m == 12).cast("int")
    return F.when(m.isin(12, 1, 2), F.format_string("%02d/%02d", (end - 1) % 100, end % 100)).otherwise("")


def winter_end_year(label) -> Column:
    return (F.lit(2000) + F.split(col(label), "/")[1].cast("int")).cast("int")


def degree_hours(t, base: float = 15.0) -> Column:
    t = col(t)
    return F.when(t.isNotNull(), F.greatest(F.lit(base) - t, F.lit(0.0)))


def ladder(x, bounds: list[tuple[float, str]], beyond: str, unknown: str) -> Column:
    """Class of the first bound that x does not exceed (upper bounds belong to their class)."""
    x = col(x)
    out = F.when(x.isNull(), unknown)
    for bound, name in bounds:
        out = out.when(x <= bound, name)
    return out.otherwise(beyond)


def normal_quantile(p) -> Column:
    """Inverse of the normal distribution function by Acklam's rational approximation (relative error below 1.2e-9).
    NULL outside (0, 1)."""
    # fixed values of the approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
    poly = lambda cs, x: reduce(lambda acc, k: acc * x + F.lit(k), cs[1:], F.lit(cs[0]))
    p = col(p)
    q = p - 0.5
    r = q * q
    mid = poly(a, r) * q / (poly(b, r) * r + 1)
    tail = lambda u: poly(c, F.sqrt(F.lit(-2.0) * F.ln(u))) / (poly(d, F.sqrt(F.lit(-2.0) * F.ln(u))) * F.sqrt(F.lit(-2.0) * F.ln(u)) + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(mid)


def hash32(*parts) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the parts' texts: the first eight hexadecimal digits of the MD5 of the parts joined by ':'. Any SQL engine has it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")
