"""Statistical tests on arrays: for groups that fit one task, after the distributed aggregation."""

from __future__ import annotations

import math

import numpy as np

from lacuna.functions.special import chi2_sf, f_sf, normal_cdf, normal_ppf, normal_sf, studentized_range_sf, t_ppf, t_sf

#: Pairs of values that `pair_budget` keeps unless told otherwise.
MOST_PAIRS, SEED = 25_000_000, 42
#: Differences that a selection among all pairs lists at once.
LISTED_PAIRS = 1_000_000


def logit_parts(b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear predictors b0 x0 + b1 x1 + … and their logistic function. Added up one after another, so that equal columns of x give equal results wherever they stand."""
    z = b[0] * x[0]
    for own, values in zip(b[1:], x[1:]):
        z = z + own * values
    e = np.exp(-np.abs(z))
    return z, np.where(z >= 0, 1.0, e) / (1 + e)


def clean(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return np.sort(x[~np.isnan(x)])


def average_rank(x: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[inverse]


def tie_term(x: np.ndarray) -> float:
    _, t = np.unique(x, return_counts=True)
    return float((t.astype(float) ** 3 - t).sum())


def mann_whitney(x, y, exact_below: int = 9) -> dict:
    """Two-sided: exact where both groups are small and untied, else normal with tie and continuity corrections. u is x's."""
    x, y = clean(x), clean(y)
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return {"u": None, "p_value": None, "rank_biserial": None, "n1": n1, "n2": n2}
    both = np.concatenate([x, y])
    u = float(average_rank(both)[:n1].sum() - n1 * (n1 + 1) / 2)
    n, ties = n1 + n2, tie_term(both)
    if min(n1, n2) < exact_below and not ties:
        p = _exact_u(u, n1, n2)
    else:
        var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
        p = 1.0 if var <= 0 else min(1.0, 2 * normal_sf((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(var)))
    return {"u": u, "p_value": p, "rank_biserial": 2 * u / (n1 * n2) - 1, "n1": n1, "n2": n2}


def _exact_u(u: float, n1: int, n2: int) -> float:
    counts = {(0, 0): np.ones(1)}
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if (i, j) == (0, 0):
                continue
            out = np.zeros(i * j + 1)
            if i:
                a = counts[(i - 1, j)]
                out[j : j + len(a)] += a  # the largest is an x: it beats all j
            if j:
                b = counts[(i, j - 1)]
                out[: len(b)] += b
            counts[(i, j)] = out
    ways = counts[(n1, n2)]
    top = int(round(max(u, n1 * n2 - u)))
    return float(min(1.0, 2 * ways[top:].sum() / ways.sum()))


def dominance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each x the mean over y of sign(x - y), by binary search in sorted y."""
    y = np.sort(y)
    return (np.searchsorted(y, x, "left") + np.searchsorted(y, x, "right") - len(y)) / len(y)


def cliffs_delta(x, y, confidence: float = 0.95) -> dict:
    """P(x > y) - P(x < y) with Cliff's (1993) asymmetric interval."""
    x, y = clean(x), clean(y)
    n1, n2 = len(x), len(y)
    none = {"delta": None, "low": None, "high": None}
    if not n1 or not n2:
        return none
    di, dj = dominance(x, y), -dominance(y, x)
    d = float(di.mean())
    if n1 < 2 or n2 < 2:
        return none | {"delta": d}
    ties = float((np.searchsorted(y, x, "right") - np.searchsorted(y, x, "left")).sum())
    ss_all = n1 * n2 - ties - n1 * n2 * d * d
    var = max(0.0, (n2 * n2 * ((di - d) ** 2).sum() + n1 * n1 * ((dj - d) ** 2).sum() - ss_all) / (n1 * n2 * (n1 - 1) * (n2 - 1)))
    z, s = normal_ppf(0.5 + confidence / 2), math.sqrt(var)
    den = 1 - d * d + z * z * var
    if den <= 0:
        return {"delta": d, "low": d, "high": d}
    reach = z * s * math.sqrt((1 - d * d) ** 2 + z * z * var)
    return {"delta": d, "low": max(-1.0, (d - d**3 - reach) / den), "high": min(1.0, (d - d**3 + reach) / den)}


def pair_budget(x: np.ndarray, y: np.ndarray, most: int = MOST_PAIRS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both groups, sampled in proportion if they have more than `most` pairs. Sorted input makes the draw independent of row order."""
    if len(x) * len(y) <= most:
        return x, y
    shrink, rng = math.sqrt(most / (len(x) * len(y))), np.random.default_rng(seed)
    n1, n2 = max(1, int(len(x) * shrink)), max(1, int(len(y) * shrink))
    if n1 == 1:
        n2 = min(len(y), most)
    if n2 == 1:
        n1 = min(len(x), most)
    return np.sort(rng.choice(x, n1, replace=False)), np.sort(rng.choice(y, n2, replace=False))


def _order_bits(x: float) -> int:
    """Doubles as whole numbers of the same order."""
    b = int(np.array(x + 0.0).view(np.int64))
    return b if b >= 0 else -(b & 0x7FFFFFFFFFFFFFFF)


def _of_bits(b: int) -> float:
    return float(np.array(abs(b), dtype=np.int64).view(np.float64)) * (1 if b >= 0 else -1)


class Differences:
    """All differences x - y of two sorted arrays in order, without holding them: memory grows with the distinct values."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.nx = np.unique(x, return_counts=True)
        self.y, ny = np.unique(y, return_counts=True)
        self.ny, self.above = ny, np.concatenate([np.cumsum(ny[::-1])[::-1], [0]])  # values of y from each place on
        self.ends = _order_bits(float(self.x[0] - self.y[-1])) - 1, _order_bits(float(self.x[-1] - self.y[0]))

    def starts(self, t: float) -> np.ndarray:
        """For each x the first place in y whose difference is at most t, by the differences themselves as they round."""
        at, m = np.searchsorted(self.y, self.x - t, "left"), len(self.y)
        while True:
            back = (at > 0) & (self.x - self.y[np.maximum(at - 1, 0)] <= t)
            on = (at < m) & (self.x - self.y[np.minimum(at, m - 1)] > t)
            if not (back | on).any():
                return at
            at = at - back + on

    def ranked(self, k: int) -> float:
        """The k-th smallest, from 0: halves the range until few enough pairs are left to list."""
        low, high = self.ends
        at_low, at_high = np.full(len(self.x), len(self.y)), self.starts(_of_bits(high))
        while high - low > 1 and int((at_low - at_high).sum()) > LISTED_PAIRS:
            mid = (low + high) // 2
            at = self.starts(_of_bits(mid))
            if int(self.nx @ self.above[at]) > k:
                high, at_high = mid, at
            else:
                low, at_low = mid, at
        if high - low <= 1:
            return _of_bits(high)
        each = at_low - at_high
        i = np.repeat(np.arange(len(self.x)), each)
        j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + at_high[i]
        d, n = self.x[i] - self.y[j], self.nx[i] * self.ny[j]
        order = np.argsort(d, kind="stable")
        before = int(self.nx @ self.above[at_low])
        return float(d[order][np.searchsorted(np.cumsum(n[order]), k - before, "right")])


def hodges_lehmann(x, y, confidence: float = 0.95, most: int | None = None) -> dict:
    """Median of all pairwise differences x - y and its rank interval; of a seeded choice of at most `most` pairs where that is given."""
    x, y = clean(x), clean(y)
    if most is not None:
        x, y = pair_budget(x, y, most)
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return {"shift": None, "low": None, "high": None}
    k = math.floor(n1 * n2 / 2 - normal_ppf(0.5 + confidence / 2) * math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    k, d, n = max(k, 0), Differences(x, y), n1 * n2
    return {"shift": float(np.mean([d.ranked((n - 1) // 2), d.ranked(n // 2)])), "low": d.ranked(k), "high": d.ranked(n - 1 - k)}


def kruskal(groups: list) -> dict:
    """Tie-corrected H, its chi-squared tail and eta squared (H - k + 1) / (n - k)."""
    groups = [g for g in map(clean, groups) if len(g)]
    k = len(groups)
    if k < 2:
        return {"h": None, "p_value": None, "eta_squared": None}
    both = np.concatenate(groups)
    n, r = len(both), average_rank(both)
    at = np.cumsum([0, *map(len, groups)])
    h = 12 / (n * (n + 1)) * sum(r[i:j].sum() ** 2 / (j - i) for i, j in zip(at, at[1:])) - 3 * (n + 1)
    fix = 1 - tie_term(both) / (n**3 - n) if n > 1 else 0
    if fix <= 0:
        return {"h": None, "p_value": None, "eta_squared": None}
    h /= fix
    return {"h": float(h), "p_value": chi2_sf(h, k - 1), "eta_squared": float((h - k + 1) / (n - k)) if n > k else None}


def bootstrap(groups: list, statistic, draws: int = 1000, confidence: float = 0.95, seed: int = SEED) -> tuple[float | None, float | None]:
    """Percentile interval of a statistic over resampled groups; values are sorted first, so row order does not matter."""
    groups, rng = [clean(g) for g in groups], np.random.default_rng(seed)
    found = [s for _ in range(draws) if (s := statistic([rng.choice(g, len(g)) for g in groups])) is not None]
    if not found:
        return None, None
    return tuple(float(q) for q in np.quantile(found, [0.5 - confidence / 2, 0.5 + confidence / 2]))


def dunn(groups: list) -> list[tuple[int, int, float, float]]:
    """(i, j, z, p) by Dunn's test with ties, p adjusted by Holm."""
    groups = [clean(g) for g in groups]
    both = np.concatenate(groups)
    n, r = len(both), average_rank(both)
    at = np.cumsum([0, *map(len, groups)])
    mean = [r[i:j].mean() for i, j in zip(at, at[1:])]
    var = n * (n + 1) / 12 - tie_term(both) / (12 * (n - 1))
    out = []
    for i in range(len(groups)):
        for j in range(i + 1, len(groups)):
            se = math.sqrt(var * (1 / len(groups[i]) + 1 / len(groups[j])))
            z = (mean[i] - mean[j]) / se if se > 0 else 0.0
            out.append((i, j, float(z), 2 * normal_sf(abs(z))))
    order, worst, m = sorted(range(len(out)), key=lambda k: out[k][3]), 0.0, len(out)
    adjusted = {}
    for k, o in enumerate(order):
        worst = max(worst, min(1.0, (m - k) * out[o][3]))
        adjusted[o] = worst
    return [(*out[o][:3], adjusted[o]) for o in range(m)]


def dscf(groups: list) -> list[tuple[int, int, float, float]]:
    """(i, j, statistic, p) by Dwass, Steel, Critchlow and Fligner."""
    groups, out = [clean(g) for g in groups], []
    for i in range(len(groups)):
        for j in range(i + 1, len(groups)):
            a, b = groups[i], groups[j]
            both = np.concatenate([a, b])
            n = len(both)
            w = average_rank(both)[len(a) :].sum()
            var = len(a) * len(b) / 12 * ((n + 1) - tie_term(both) / (n * (n - 1)))
            s = math.sqrt(2) * (w - len(b) * (n + 1) / 2) / math.sqrt(var) if var > 0 else 0.0
            out.append((i, j, float(s), studentized_range_sf(abs(s), len(groups))))
    return out


def benjamini_hochberg(p: list[float | None]) -> list[float | None]:
    order = sorted((k for k, x in enumerate(p) if x is not None and not math.isnan(x)), key=lambda k: -p[k])
    out, least, m = [None] * len(p), 1.0, len(order)
    for k, o in enumerate(order):
        least = min(least, p[o] * m / (m - k))
        out[o] = least
    return out


def chi2_2x2(n00: int, n01: int, n10: int, n11: int) -> dict:
    """Yates-corrected; undefined where an expected count is 0."""
    table = np.array([[n00, n01], [n10, n11]], dtype=float)
    n = table.sum()
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / n if n else np.zeros((2, 2))
    if not (expected > 0).all():
        return {"chi2": None, "p_value": None, "cramers_v": None}
    off = np.abs(table - expected)
    chi2 = float(((off - np.minimum(0.5, off)) ** 2 / expected).sum())
    return {"chi2": chi2, "p_value": chi2_sf(chi2, 1), "cramers_v": math.sqrt(chi2 / n)}


def chi2_table(table) -> dict:
    """Independence in an r x c table, Yates-corrected if 2 x 2; undefined if a row or column is empty."""
    t = np.asarray(table, dtype=float)
    if t.shape == (2, 2):
        return {k: v for k, v in chi2_2x2(*t.ravel()).items() if k != "cramers_v"}
    n, df = t.sum(), (t.shape[0] - 1) * (t.shape[1] - 1)
    expected = np.outer(t.sum(axis=1), t.sum(axis=0)) / n if n else np.zeros_like(t)
    if df < 1 or not (expected > 0).all():
        return {"chi2": None, "p_value": None}
    chi2 = float(((t - expected) ** 2 / expected).sum())
    return {"chi2": chi2, "p_value": chi2_sf(chi2, df)}


def t_test(x, y, confidence: float = 0.95) -> dict:
    """Two-sample t: pooled if the standard deviations agree within a relative 1e-5, else Welch's."""
    x, y = clean(x), clean(y)
    n1, n2 = len(x), len(y)
    if n1 < 2 or n2 < 2:
        return {"t": None, "p_value": None, "low": None, "high": None, "cohens_d": None, "equal_var": None}
    v1, v2, d = x.var(ddof=1), y.var(ddof=1), x.mean() - y.mean()
    equal = bool(np.isclose(math.sqrt(v1), math.sqrt(v2), rtol=1e-5))
    if equal:
        df, pooled = n1 + n2 - 2, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        se, sd = math.sqrt(pooled * (1 / n1 + 1 / n2)), math.sqrt(pooled)
    else:
        a, b = v1 / n1, v2 / n2
        df, se, sd = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) if a + b else n1 + n2 - 2, math.sqrt(a + b), math.sqrt((v1 + v2) / 2)
    if se == 0:
        return {"t": None, "p_value": None, "low": None, "high": None, "cohens_d": None, "equal_var": equal}
    reach = t_ppf(0.5 + confidence / 2, df) * se
    return {"t": d / se, "p_value": 2 * t_sf(abs(d / se), df), "low": d - reach, "high": d + reach, "cohens_d": d / sd, "equal_var": equal}


def levene(groups: list) -> dict:
    """Brown-Forsythe: deviations from the median."""
    z = [np.abs(g - np.median(g)) for g in map(clean, groups) if len(g)]
    n, k = sum(map(len, z)), len(z)
    mean = np.concatenate(z).mean()
    within = sum(((g - g.mean()) ** 2).sum() for g in z)
    if n <= k or within == 0:
        return {"w": None, "p_value": None}
    w = (n - k) / (k - 1) * sum(len(g) * (g.mean() - mean) ** 2 for g in z) / within
    return {"w": float(w), "p_value": f_sf(w, k - 1, n - k)}


#: Royston (1995), algorithm AS R94: fixed coefficients, constant term first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_C3 = (0.544, -0.39978, 0.025054, -0.0006714)
_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_C6 = (-0.4803, -0.082676, 0.0030302)
_G = (-2.273, 0.459)


def _poly(c, x: float) -> float:
    return sum(a * x**k for k, a in enumerate(c))


def shapiro_wilk(x) -> dict:
    x = clean(x)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return {"w": None, "p_value": None, "n": n}
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        mm, u = float(m @ m), 1 / math.sqrt(n)
        c = m / math.sqrt(mm)
        last = c[-1] + _poly(_C1, u)
        a = np.empty(n)
        if n > 5:
            second = c[-2] + _poly(_C2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = float(min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return {"w": w, "p_value": max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))), "n": n}
    y, ln = math.log(1 - w) if w < 1 else -745.0, math.log(n)
    if n <= 11:
        gamma = _poly(_G, n)
        if y >= gamma:
            return {"w": w, "p_value": 1e-99, "n": n}
        y, mean, sd = -math.log(gamma - y), _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        mean, sd = _poly(_C5, ln), math.exp(_poly(_C6, ln))
    return {"w": w, "p_value": normal_sf((y - mean) / sd), "n": n}


def henze_zirkler(rows: np.ndarray) -> dict:
    """Multivariate normality (Henze and Zirkler 1990) with its lognormal approximation; block by block, O(n) memory."""
    rows = np.asarray(rows, dtype=float)
    rows = rows[~np.isnan(rows).any(axis=1)]
    n, d = rows.shape
    if d < 2 or n <= d:
        return henze_zirkler_of(n, d, None, None)
    centred = rows - rows.mean(axis=0)
    cov = np.atleast_2d(centred.T @ centred / n)
    if np.linalg.matrix_rank(cov) < d:
        return henze_zirkler_of(n, d, None, None)
    b, inv, each = henze_zirkler_width(n, d), np.linalg.pinv(cov), np.ones(n)
    return henze_zirkler_of(n, d, henze_zirkler_pairs(centred, each, centred, each, inv, b), henze_zirkler_centre(centred, each, inv, b))


def henze_zirkler_width(n: int, d: int) -> float:
    return 1 / math.sqrt(2) * ((2 * d + 1) / 4) ** (1 / (d + 4)) * n ** (1 / (d + 4))


def henze_zirkler_pairs(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, inv: np.ndarray, b: float) -> float:
    """The sum over all pairs of rows of x and y (centred, with their counts)."""
    white = x @ inv
    dx, dy = np.einsum("ij,ij->i", white, x), np.einsum("ij,ij->i", y @ inv, y)
    return float(sum(nx[i : i + 512] @ np.exp(-b * b / 2 * (dx[i : i + 512, None] + dy[None, :] - 2 * white[i : i + 512] @ y.T)) @ ny for i in range(0, len(x), 512)))


def henze_zirkler_centre(x: np.ndarray, nx: np.ndarray, inv: np.ndarray, b: float) -> float:
    """The sum over rows (centred, with their counts) against the centre."""
    return float(nx @ np.exp(-b * b / (2 * (1 + b * b)) * np.einsum("ij,ij->i", x @ inv, x)))


def henze_zirkler_of(n: int, d: int, pairs: float | None, centre: float | None) -> dict:
    """The test from its sums; without them, of a singular covariance."""
    if d < 2 or n <= d:
        return {"hz": None, "p_value": None, "normal": None, "n": n}
    b = henze_zirkler_width(n, d)
    hz = 4.0 * n if pairs is None else n * (pairs / n**2 - 2 * (1 + b * b) ** (-d / 2) * centre / n + (1 + 2 * b * b) ** (-d / 2))
    wb = (1 + b * b) * (1 + 3 * b * b)
    a = 1 + 2 * b * b
    mu = 1 - a ** (-d / 2) * (1 + d * b * b / a + d * (d + 2) * b**4 / (2 * a * a))
    si2 = 2 * (1 + 4 * b * b) ** (-d / 2) + 2 * a ** (-d) * (1 + 2 * d * b**4 / a**2 + 3 * d * (d + 2) * b**8 / (4 * a**4)) - 4 * wb ** (-d / 2) * (1 + 3 * d * b**4 / (2 * wb) + d * (d + 2) * b**8 / (2 * wb**2))
    pmu, psi = math.log(math.sqrt(mu**4 / (si2 + mu**2))), math.sqrt(math.log((si2 + mu**2) / mu**2))
    p = 1 - normal_cdf((math.log(hz) - pmu) / psi)
    return {"hz": float(hz), "p_value": p, "normal": p > 0.05, "n": n}


def little_mcar(patterns: list[tuple[tuple[int, ...], int, list[float | None]]], mean: np.ndarray, cov: np.ndarray, n: int) -> dict:
    """Little's test from per-pattern counts and means. patterns: (mask bits, rows, means); mean and cov come from complete rows."""
    m, stat, observed, used = len(mean), 0.0, 0, 0
    for mask, rows, means in patterns:
        own = [i for i in range(m) if not mask[i]]
        if rows < 2 or not own:
            continue
        d = np.array([means[i] for i in own], dtype=float) - mean[own]
        stat += rows * float(d @ np.linalg.pinv(cov[np.ix_(own, own)]) @ d)
        observed += len(own)
        used += 1
    df = observed - m
    j = min(used - 1, m - 1)
    return {"statistic": stat, "df": df, "p_value": chi2_sf(stat, df) if df > 0 else None, "phi": math.sqrt(stat / n), "cramers_v": math.sqrt(stat / (n * j)) if j > 0 else None, "n_patterns": used}


def spearman_interval(rho: float | None, n: int, confidence: float = 0.95) -> tuple[float | None, float | None]:
    if rho is None or n < 4 or abs(rho) >= 1:
        return None, None
    reach = normal_ppf(0.5 + confidence / 2) * math.sqrt(1.06 / (n - 3))
    return math.tanh(math.atanh(rho) - reach), math.tanh(math.atanh(rho) + reach)


def auc(label: np.ndarray, score: np.ndarray) -> float | None:
    label = np.asarray(label, dtype=bool)
    n1, n0 = int(label.sum()), int((~label).sum())
    return float((average_rank(np.asarray(score))[label].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else None
