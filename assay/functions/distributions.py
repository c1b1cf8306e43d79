"""Distribution functions on the driver: tails, quantiles and exact small-sample laws, from their series and recursions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

TINY = 1e-300


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by a continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / _away(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 20000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _away(1 + term * d)
            c = _away(1 + term / c)
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, front * h)


def _away(x: float) -> float:
    return x if abs(x) > TINY else TINY


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 20000):
        an = -i * (i - a)
        b += 2
        d = 1 / _away(an * d + b)
        c = _away(b + an / c)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_cdf(z: float) -> float:
    return norm_sf(-z)


def solve(f: Callable[[float], float], low: float, high: float, rounds: int = 200) -> float:
    """Root of an increasing or decreasing function by bisection."""
    at_low = f(low)
    for _ in range(rounds):
        mid = 0.5 * (low + high)
        at = f(mid)
        if at == 0 or high - low <= 1e-13 * max(1.0, abs(mid)):
            return mid
        if (at > 0) == (at_low > 0):
            low, at_low = mid, at
        else:
            high = mid
    return 0.5 * (low + high)


@lru_cache(maxsize=4096)
def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    return -norm_ppf(1 - p) if p > 0.5 else solve(lambda z: norm_sf(-z) - p, -40.0, 0.0)


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else (math.nan if math.isnan(t) else 0.0)


def t_ppf(p: float, df: float) -> float:
    return -t_ppf(1 - p, df) if p < 0.5 else solve(lambda t: 1 - t_sf(t, df) - p, 0.0, 1e8 if df < 2 else 1e5)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def f_ppf(p: float, d1: float, d2: float) -> float:
    high = 1.0
    while f_sf(high, d1, d2) > 1 - p:
        high *= 2
    return solve(lambda x: 1 - f_sf(x, d1, d2) - p, 0.0, high)


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def chi2_ppf(p: float, df: float) -> float:
    high = 1.0
    while chi2_sf(high, df) > 1 - p:
        high *= 2
    return solve(lambda x: 1 - chi2_sf(x, df) - p, 0.0, high)


def nct_cdf(t: float, df: float, nc: float) -> float:
    """Non-central t, as a Poisson mixture of incomplete betas."""
    if t < 0:
        return 1 - nct_cdf(-t, df, -nc)
    total, x, half = norm_cdf(-nc), t * t / (t * t + df), nc * nc / 2
    if x <= 0:
        return total
    centre = int(half)

    def term(j: int) -> float:
        logp = -half + j * math.log(half) - math.lgamma(j + 1) if half else (0.0 if j == 0 else -math.inf)
        logq = -half + j * math.log(half) - math.lgamma(j + 1.5) if half else (-math.lgamma(1.5) if j == 0 else -math.inf)
        return 0.5 * (math.exp(logp) * beta_inc(j + 0.5, df / 2, x) + nc / math.sqrt(2) * math.exp(logq) * beta_inc(j + 1, df / 2, x))

    for step in (1, -1):
        j = centre if step == 1 else centre - 1
        while j >= 0:
            add = term(j)
            total += add
            if abs(add) < 1e-15 and abs(j - centre) > 10:
                break
            j += step
    return min(1.0, max(0.0, total))


def ncf_cdf(f: float, d1: float, d2: float, nc: float) -> float:
    """Non-central F, as a Poisson mixture of incomplete betas."""
    if f <= 0:
        return 0.0
    x, half = d1 * f / (d1 * f + d2), nc / 2
    centre, total = int(half), 0.0
    for step in (1, -1):
        j = centre if step == 1 else centre - 1
        while j >= 0:
            weight = math.exp(-half + j * math.log(half) - math.lgamma(j + 1)) if half else float(j == 0)
            add = weight * beta_inc(d1 / 2 + j, d2 / 2, x)
            total += add
            if weight < 1e-16 and abs(j - centre) > 10:
                break
            j += step
    return min(1.0, total)


@lru_cache(maxsize=4)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def _phi_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(-z / math.sqrt(2))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) for k means and df degrees of freedom: a double integral on Gauss-Legendre nodes."""
    if q <= 0:
        return 1.0
    x, w = _nodes(128)
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - 1.3 * spread), 1 + 1.6 * spread
    s, ws = 0.5 * (high - low) * x + 0.5 * (high + low), 0.5 * (high - low) * w
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    z, wz = 8.5 * x, 8.5 * w
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = _phi_cdf(z)
    inner = np.array([(wz * phi * (upper - _phi_cdf(z - q * v)) ** (k - 1)).sum() * k for v in s])
    return float(min(1.0, max(0.0, 1 - (ws * np.exp(log_density) * inner).sum())))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    return solve(lambda q: 1 - studentized_range_sf(q, k, df) - p, 0.0, 200.0, 60)


def shapiro_wilk(values: list[float]) -> tuple[float, float] | None:
    """(W, p) by Royston's AS R94 approximation; None below three values or without spread."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return None
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm2, root = float(m @ m), 1 / math.sqrt(n)
    # fixed values of AS R94
    c1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
    c2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    poly = lambda c, v: sum(a * v**k for k, a in enumerate(c))
    a = np.empty(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = m[-1] / math.sqrt(norm2) + poly(c1, root)
        if n > 5:
            before = m[-2] / math.sqrt(norm2) + poly(c2, root)
            scale = (norm2 - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = m / math.sqrt(scale)
            a[-2], a[1] = before, -before
        else:
            scale = (norm2 - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(scale)
        a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-19))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y = -math.log(g - y)
        mu, sigma = poly([0.544, -0.39978, 0.025054, -0.0006714], n), math.exp(poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
    else:
        v = math.log(n)
        mu, sigma = poly([-1.5861, -0.31082, -0.083751, 0.0038915], v), math.exp(poly([-0.4803, -0.082676, 0.0030302], v))
    return w, norm_sf((y - mu) / sigma)


def mann_whitney_p(u1: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of U: exact for small samples without ties, else normal with tie and continuity corrections."""
    if min(n1, n2) <= 8 and ties == 0:
        counts = _u_counts(n1, n2)
        u = max(u1, n1 * n2 - u1)
        return min(1.0, 2 * float(counts[int(math.ceil(u - 1e-9)) :].sum() / counts.sum()))
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if sigma == 0:
        return 1.0
    return min(1.0, 2 * norm_sf((max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sigma))


def _u_counts(n1: int, n2: int) -> np.ndarray:
    """How many arrangements give each U: coefficients of the Gaussian binomial."""
    small, large = min(n1, n2), max(n1, n2)
    out = np.zeros(n1 * n2 + 1)
    out[0] = 1.0
    for k in range(1, small + 1):
        up = large + k
        step = out.copy()
        step[up:] -= out[:-up] if up < len(out) else 0
        for i in range(k, len(step)):
            step[i] += step[i - k]
        out = step
    return out


def ks_p(d: float, n: int, m: int) -> float:
    """Two-sided p of the two-sample statistic: exact by lattice paths while they are few, else the asymptotic series."""
    if d <= 0:
        return 1.0
    if max(n, m) <= 10_000 and n * m <= 4_000_000:
        # chance that a random path stays strictly inside the band |i/n - j/m| < d
        limit = d - 1e-12
        j = np.arange(m + 1)
        inside = np.abs(j / m) < limit
        row = np.where(np.cumprod(inside), 1.0, 0.0)
        for i in range(1, n + 1):
            inside = np.abs(i / n - j / m) < limit
            new = np.zeros(m + 1)
            left = 0.0
            for k in np.flatnonzero(inside).tolist():
                left = new[k - 1] if k else 0.0
                new[k] = (i * row[k] + k * left) / (i + k)
            row = new
        return float(min(1.0, max(0.0, 1 - row[m])))
    en = n * m / (n + m)
    x = d * math.sqrt(en)
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def hypergeometric_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact p: all tables with these margins that are no likelier than the one seen."""
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    logc = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    pmf = lambda x: math.exp(logc(r1, x) + logc(r2, c1 - x) - logc(n, c1))
    seen = pmf(a)
    return min(1.0, sum(p for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (p := pmf(x)) <= seen * (1 + 1e-7)))


def digamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 8).any():
        low = x < 8
        out = out - np.where(low, 1 / x, 0.0)
        x = x + low
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 8).any():
        low = x < 8
        out = out + np.where(low, 1 / (x * x), 0.0)
        x = x + low
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + (1 / x) * i * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def log_gamma(x: np.ndarray | float) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(np.asarray(x, float))
