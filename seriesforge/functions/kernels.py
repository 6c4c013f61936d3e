"""Series kernels in numpy: decomposition, change points, matrix profile, smoothing, stationarity.

Each takes one series; the operators run them once per series in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np


def _tricube(d: np.ndarray) -> np.ndarray:
    return np.clip(1 - np.abs(d) ** 3, 0, None) ** 3


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local linear fits over the ``span`` nearest points, at positions ``at`` (by default the points').

    Positions are equally spaced, so every window is a shift of one kernel except at the ends.
    """
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    w0 = np.ones(n) if weights is None else weights
    q = min(span, n)
    left = np.clip(np.round(at).astype(int) - q // 2, 0, n - q)
    idx = left[:, None] + np.arange(q)
    d = idx - at[:, None]
    reach = np.abs(d).max(axis=1, keepdims=True) * (span / q if span > n else 1) + 1e-12
    w = _tricube(d / (reach * 1.001)) * w0[idx]
    s0, s1, s2 = w.sum(1), (w * d).sum(1), (w * d * d).sum(1)
    t0, t1 = (w * y[idx]).sum(1), (w * d * y[idx]).sum(1)
    det = s0 * s2 - s1 * s1
    flat = np.where(s0 > 0, t0 / np.where(s0 > 0, s0, 1), np.nan)
    fit = np.where(np.abs(det) > 1e-12 * np.maximum(1, s0 * s2), (s2 * t0 - s1 * t1) / np.where(det == 0, 1, det), flat)
    return np.where(np.isnan(fit), np.interp(at, np.arange(n), y), fit)


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    c = np.cumsum(np.r_[0.0, x])
    return (c[n:] - c[:-n]) / n


def stl(y: np.ndarray, period: int, seasonal: int = 11, robust: bool = True, inner: int = 2, outer: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and residual by seasonal-trend decomposition with local fits."""
    n = len(y)
    trend_span = int(math.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    low = period | 1
    trend, season, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range((outer if outer is not None else 5 if robust else 0) + 1):
        for _ in range(inner):
            raw = y - trend
            cycle = np.empty(n + 2 * period)
            for p in range(period):
                sub = raw[p::period]
                if len(sub):
                    cycle[p::period] = loess(sub, seasonal, rho[p::period], np.arange(-1, len(sub) + 1))[: len(cycle[p::period])]
            smooth = loess(_moving(_moving(_moving(cycle, period), period), 3), low)
            season = cycle[period : period + n] - smooth[:n]
            trend = loess(y - season, trend_span, rho)
        rest = np.abs(y - trend - season)
        if not robust:
            break
        h = 6 * np.median(rest)
        rho = np.clip(1 - (rest / h) ** 2, 0, None) ** 2 if h > 0 else np.ones(n)
    return trend, season, y - trend - season


def mstl(y: np.ndarray, periods: list[int], rounds: int = 2) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Several seasons, each refined in turn against what the others leave; shorter periods first.

    Periods of which two do not fit are left out; with none, a smoothed trend remains.
    """
    fit = sorted(p for p in periods if p >= 2 and 2 * p <= len(y))
    if not fit:
        n = len(y)
        span = max(3, (n // 4) | 1)
        trend = savgol(y, min(span, n if n % 2 else n - 1), 2) if n >= 5 else np.full(n, y.mean() if n else 0.0)
        return trend, {}, y - trend
    seasons = {p: np.zeros(len(y)) for p in fit}
    trend = np.zeros(len(y))
    for _ in range(rounds if len(fit) > 1 else 1):
        for i, p in enumerate(fit):
            rest = y - sum(seasons[q] for q in fit if q != p)
            trend, seasons[p], _ = stl(rest, p, seasonal=7 + 4 * (i + 1))
    return trend, seasons, y - trend - sum(seasons.values())


def savgol(y: np.ndarray, window: int, degree: int = 2) -> np.ndarray:
    """Least-squares smoothing over a window; polynomials fitted to the first and last windows make the ends."""
    n, h = len(y), window // 2
    x = np.arange(-h, h + 1)
    basis = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    out = np.convolve(y, basis[0][::-1], "same")
    for part, at in ((slice(0, window), np.arange(h)), (slice(n - window, n), np.arange(window - h, window))):
        fit = np.polynomial.polynomial.polyfit(np.arange(window), y[part], degree)
        out[at if part.start == 0 else n - window + at] = np.polynomial.polynomial.polyval(at, fit)
    return out


def _pair_distance(x: np.ndarray, nth: int) -> float:
    """The nth smallest (from 0) distance of two of the sorted values ``x``, found by counting."""
    low, high = 0, int(np.float64(x[-1] - x[0]).view(np.int64))  # floats from 0 on are in the order of their bits
    own = np.arange(1, len(x) + 1)
    while low < high:
        mid = (low + high) // 2
        if (np.searchsorted(x, x + np.int64(mid).view(np.float64), "right") - own).sum() > nth:
            high = mid
        else:
            low = mid + 1
    return float(np.int64(low).view(np.float64))


def pelt(y: np.ndarray, penalty: float, min_size: int = 2, jump: int = 1) -> list[int]:
    """Change points of a series under a kernel cost (Gaussian, width by the median distance).

    The cost of a segment needs the sum over a square of the kernel matrix; the sums of all open
    starts grow by a column of the matrix at each point, so memory is in proportion to the length.
    """
    n = len(y)
    if n < 2 * min_size:
        return []
    x, pairs = np.sort(y), n * (n - 1) // 2
    med = (_pair_distance(x, (pairs - 1) // 2) ** 2 + _pair_distance(x, pairs // 2) ** 2) / 2 if pairs else 0.0
    best, last, open_, square = np.zeros(n + 1), {0: 0}, np.array([0]), np.zeros(n)
    best[0] = -penalty
    for b in range(1, n + 1):
        low = open_[0]
        column = np.exp(-((y[low:b] - y[b - 1]) ** 2) / med) if med > 0 else np.ones(b - low)
        square[low:b] += 2 * column[::-1].cumsum()[::-1] - 1
        if b < min_size or (b % jump and b != n):
            continue
        a = open_[b - open_ >= min_size]
        if not len(a):
            continue
        total = best[a] + (b - a) - square[a] / (b - a) + penalty
        i = int(total.argmin())
        best[b], last[b] = total[i], int(a[i])
        gone = a[total - penalty > best[b]]
        open_ = np.r_[open_[~np.isin(open_, gone)], b]
    points, at = [], n
    while at in last and last[at] > 0:
        at = last[at]
        points.append(at)
    return points[::-1]


def matrix_profile(y: np.ndarray, m: int) -> np.ndarray:
    """Distance of each window to its nearest other window (at least m / 4 apart), both standardised."""
    n = len(y) - m + 1
    if n < 2:
        return np.zeros(max(n, 0))
    c, c2 = np.cumsum(np.r_[0.0, y]), np.cumsum(np.r_[0.0, y * y])
    mean = (c[m:] - c[:-m]) / m
    std = np.sqrt(np.clip((c2[m:] - c2[:-m]) / m - mean**2, 1e-18, None))
    first = np.array([y[:m] @ y[i : i + m] for i in range(n)])
    dots, out, apart = first.copy(), np.full(n, np.inf), max(1, m // 4)
    for i in range(n):
        if i:
            dots[1:] = dots[:-1] - y[: n - 1] * y[i - 1] + y[m : m + n - 1] * y[i + m - 1]
            dots[0] = first[i]
        r = (dots - m * mean * mean[i]) / (m * std * std[i])
        d = np.sqrt(np.clip(2 * m * (1 - r), 0, None))
        d[max(0, i - apart) : i + apart + 1] = np.inf
        out[i] = d.min()
    return np.where(np.isinf(out), 0.0, out)


def discords(y: np.ndarray, most: int = 5000) -> list[tuple[int, float]]:
    """Windows whose distance is over the 95th percentile, as (start, distance over the largest), largest of each cluster.

    Only the last ``most`` points are profiled; starts count from the whole series' first point.
    """
    before = max(0, len(y) - most)
    y = np.asarray(y, float)[before:]
    m = max(len(y) // 20, 4)
    if len(y) < 2 * m + 2:
        return []
    p = matrix_profile(y, m)
    limit, top = np.quantile(p, 0.95), p.max()
    out: list[tuple[int, float]] = []
    for i in np.argsort(-p):
        if p[i] <= limit or top <= 0:
            break
        if all(abs(int(i) - j) >= m for j, _ in out):
            out.append((int(i), float(p[i] / top)))
    return sorted((before + i, s) for i, s in out)


def adf(y: np.ndarray, lags: int | None = None) -> tuple[float, bool]:
    """Statistic of the augmented Dickey-Fuller test with a constant, and whether it is below the 5 % value.

    The critical value is MacKinnon's response surface.
    """
    n = len(y)
    k = lags if lags is not None else int(12 * (n / 100) ** 0.25)
    k = max(0, min(k, n // 2 - 3))
    dy = np.diff(y)
    rows = len(dy) - k
    if rows < k + 4 or np.ptp(y) == 0:
        return 0.0, False
    x = np.column_stack([y[k : k + rows], np.ones(rows)] + [dy[k - j : k - j + rows] for j in range(1, k + 1)])
    target = dy[k:]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    rest = target - x @ beta
    var = rest @ rest / max(1, rows - x.shape[1])
    cov = var * np.linalg.pinv(x.T @ x)
    t = float(beta[0] / math.sqrt(max(cov[0, 0], 1e-300)))
    return t, t < -2.86154 - 2.8903 / rows - 4.234 / rows**2 - 40.04 / rows**3
