"""Tests on counts and ranks in plain Python: inputs are the few numbers that Spark has summed up."""

from __future__ import annotations

from math import comb, erfc, exp, lgamma, log, sqrt


def binomial_tail(hits: int, n: int, p: float) -> float:
    """P(X >= hits) for n trials of chance p."""
    if hits <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    term = lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))
    return min(1.0, sum(term(k) for k in range(hits, n + 1)))


def normal_tail(z: float) -> float:
    """P(Z >= z)."""
    return erfc(z / sqrt(2)) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz steps)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def t_quantile(p: float, dof: float) -> float:
    """Upper quantile by bisection: P(T <= q) = p for p > 0.5."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, dof) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: all tables of the same margins that are no more likely."""
    n, r, k = a + b + c + d, a + b, a + c
    p = lambda x: comb(r, x) * comb(n - r, k - x) / comb(n, k)
    seen = p(a)
    return min(1.0, sum(q for x in range(max(0, k - (n - r)), min(r, k) + 1) if (q := p(x)) <= seen * (1 + 1e-9)))


def mcnemar(only_a: int, only_b: int) -> float:
    """Exact two-sided test of discordant pairs."""
    n = only_a + only_b
    return 1.0 if not n else min(1.0, 2 * binomial_tail(max(only_a, only_b), n, 0.5))


def mann_whitney(rank_sum: float, n: int, m: int, ties: float = 0.0) -> float:
    """Two-sided p from the rank sum of the first group by the normal approximation with continuity; ties: sum of t^3 - t."""
    u = rank_sum - n * (n + 1) / 2
    s2 = n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1)))
    return 1.0 if s2 <= 0 else min(1.0, 2 * normal_tail((abs(u - n * m / 2) - 0.5) / sqrt(s2)))


def cliffs_delta(rank_sum: float, n: int, m: int) -> float:
    """Chance that a value of the first group is above one of the second, minus the reverse."""
    return 2 * (rank_sum - n * (n + 1) / 2) / (n * m) - 1


def wilcoxon(positive_rank_sum: float, n: int) -> float:
    """Two-sided signed-rank test by the normal approximation with continuity."""
    m, s = n * (n + 1) / 4, sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return 1.0 if not n else min(1.0, 2 * normal_tail((abs(positive_rank_sum - m) - 0.5) / s))
