"""Seasonal-trend decomposition by loess (Cleveland et al. 1990) of one short, regular series."""

from __future__ import annotations

import numpy as np


def loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Local lines with tricube weights over the `span` nearest points; where they have no weight, the nearest value."""
    n, x = len(y), np.arange(len(y), dtype=float)
    out = np.empty(len(at))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        reach = np.sort(d)[min(span, n) - 1] * max(1.0, span / n)
        w = weights * np.clip(1 - (d / max(reach, 1e-12)) ** 3, 0, None) ** 3
        total = w.sum()
        if total <= 0:
            out[i] = y[d.argmin()]
            continue
        mx, my = (w * x).sum() / total, (w * y).sum() / total
        spread = (w * (x - mx) ** 2).sum()
        out[i] = my + ((a - mx) * (w * (x - mx) * (y - my)).sum() / spread if spread > 1e-9 * total else 0.0)
    return out


def _moving_mean(y: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(y, np.ones(k) / k, "valid")


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + 1 - n % 2


def stl(y, period: int, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part and remainder, which add up to y. Needs two whole periods, of at least 2 steps each."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if period < 2 or n < 2 * period:
        raise ValueError("fewer than two periods")
    trend_span, low_span = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1)
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    ones, every = np.ones(n), np.arange(n, dtype=float)
    for outer in range(16 if robust else 1):
        if outer:
            rest = np.abs(y - trend - season)
            scale = 6 * np.median(rest)
            weights = np.clip(1 - (rest / scale) ** 2, 0, None) ** 2 if scale > 0 else (rest <= 0).astype(float)
        for _ in range(2 if robust else 5):
            cycles = np.empty(n + 2 * period)
            for phase in range(period):
                part = (y - trend)[phase::period]
                cycles[phase::period] = loess(part, seasonal, np.arange(-1.0, len(part) + 1), weights[phase::period])
            low = _moving_mean(_moving_mean(_moving_mean(cycles, period), period), 3)
            season = cycles[period : period + n] - loess(low, low_span, every, ones)
            trend = loess(y - season, trend_span, every, weights)
    return trend, season, y - trend - season
