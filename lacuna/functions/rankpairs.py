"""Rank correlations of many pairs of columns, each over its complete rows, without a row for each pair.

Columns are cut at approximate quantiles. A value that is a cut has a bucket of its own, so its rank follows from the
buckets' totals and its rows, however many, meet nowhere; the others are ranked bucket by bucket, first by x and then by y. Results are exact whatever the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.ranksums import BUCKETS, GATHERED, approximate_cuts, cut_points
from lacuna.sources.store import stored

#: Rows that a bucket should have at least.
BUCKET_ROWS = 20_000
#: Where packed rows go: to be ranked by x, to be ranked by y (with x's rank), nowhere (sums of products and of squares).
BY_X, BY_Y, SUMS = 0, 1, 2
DEALT = "pair int, side int, bucket int, a binary, b binary"
_NAMES = [x.split()[0] for x in DEALT.split(", ")]
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def rank_correlations(df: DataFrame, pairs: list[tuple[int, int]]) -> list[tuple[int, float | None]]:
    """(complete rows, Spearman's correlation) of each pair of columns (by place) of doubles; null if a side is constant or n < 3."""
    if not pairs:
        return []
    df, width = stored(df, "rank-columns"), len(df.columns)  # read thrice
    found = df.agg(F.count(F.lit(1)).alias("n"), *(approximate_cuts(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns))).collect()[0]  # one row
    step = max(1, BUCKETS // max(1, found["n"] // BUCKET_ROWS))
    cuts = [cut_points((found[f"_c{i}"] or [])[step - 1 :: step]) for i in range(width)]

    def count(batches):
        sums = [[np.zeros(2 * len(cuts[c]) + 1, dtype=np.int64) for c in pair] for pair in pairs]
        for batch in batches:
            x = _matrix(batch)
            b, seen = _buckets(x, cuts), ~np.isnan(x)
            for own, pair in zip(sums, pairs):
                both = seen[pair[0]] & seen[pair[1]]
                for s, c in zip(own, pair):
                    s += np.bincount(b[c][both], minlength=len(s))
        rows = [(k, side, int(at), int(s[at])) for k, own in enumerate(sums) for side, s in enumerate(own) for at in np.flatnonzero(s)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["pair", "side", "bucket", "n"])

    totals = [[np.zeros(2 * len(cuts[c]) + 1, dtype=np.int64) for c in pair] for pair in pairs]
    for r in df.mapInArrow(count, "pair int, side int, bucket int, n long").groupBy("pair", "side", "bucket").agg(F.sum("n").alias("n")).collect():  # at most twice the buckets for each side of a pair
        totals[r["pair"]][r["side"]][r["bucket"]] = r["n"]
    # ranks from the middle: of what lies below a bucket, and of the value of a bucket that has one
    start = [[np.cumsum(s) - s - (s.sum() + 1) / 2 for s in own] for own in totals]
    alone = [[b + (s + 1) / 2 for b, s in zip(*own)] for own in zip(start, totals)]

    def deal(batches):
        held, n = [], 0
        for batch in batches:
            held.append(_matrix(batch))
            n += batch.num_rows
            if n >= GATHERED:
                yield from dealt(np.concatenate(held, axis=1))
                held, n = [], 0
        if held:
            yield from dealt(np.concatenate(held, axis=1))

    def dealt(x):
        b, seen = _buckets(x, cuts), ~np.isnan(x)
        for k, (i, j) in enumerate(pairs):
            both = seen[i] & seen[j]
            bx, by, vx, vy = b[i][both], b[j][both], x[i][both], x[j][both]
            own = bx % 2 == 1
            rows = list(_parted(k, BY_X, bx[~own], vx[~own], vy[~own]))
            rows += _by_y(k, by[own], vy[own], alone[k][0][bx[own]], alone[k][1])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    def by_x(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k, bucket = key
        vx, vy = _read(pdf["a"]), _read(pdf["b"])
        ranks = start[k][0][bucket] + _local_ranks(vx)
        rows = _by_y(k, _buckets(vy[None, :], [cuts[pairs[k][1]]])[0], vy, ranks, alone[k][1])
        return pd.DataFrame([*rows, _sums(k, 0.0, (ranks * ranks).sum(), 0.0)], columns=_NAMES)

    def by_y(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k, side, bucket = key
        if side == SUMS:
            s = _read(pdf["a"]).reshape(-1, 3).sum(axis=0)
        else:
            vy, rx = _read(pdf["a"]), _read(pdf["b"])
            ry = start[k][1][bucket] + _local_ranks(vy)
            s = ((rx * ry).sum(), 0.0, (ry * ry).sum())
        return pd.DataFrame([[k, *map(float, s)]], columns=["pair", "xy", "xx", "yy"])

    first = stored(df.mapInArrow(deal, DEALT), "rank-pairs")
    second = first.where(F.col("side") == BY_X).groupBy("pair", "bucket").applyInPandas(by_x, DEALT)
    sums = first.where(F.col("side") != BY_X).unionByName(second).groupBy("pair", "side", "bucket").applyInPandas(by_y, "pair int, xy double, xx double, yy double")
    got = {r["pair"]: (r["xy"], r["xx"], r["yy"]) for r in sums.groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("xy", "xx", "yy"))).collect()}  # one row a pair
    out = []
    for k, own in enumerate(totals):
        n, (xy, xx, yy) = int(own[0].sum()), got.get(k, (0.0, 0.0, 0.0))
        xx, yy = (v + float((own[i][1::2] * alone[k][i][1::2] ** 2).sum()) for i, v in enumerate((xx, yy)))  # and buckets of one value
        out.append((n, float(xy / (np.sqrt(xx) * np.sqrt(yy))) if n >= 3 and xx > 1e-9 and yy > 1e-9 else None))
    return out


def _matrix(batch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


def _buckets(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Odd: the value is a cut; even: it lies between two."""
    return [np.searchsorted(c, v) + np.searchsorted(c, v, side="right") for v, c in zip(x, cuts)]


def _read(blobs: pd.Series) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, dtype=np.float64) for b in blobs])


def _local_ranks(v: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - n + (n + 1) / 2)[at]


def _sums(pair: int, xy: float, xx: float, yy: float) -> tuple:
    return pair, SUMS, 0, np.array([xy, xx, yy], dtype=np.float64).tobytes(), b""


def _parted(pair: int, side: int, bucket: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, a, b = bucket[order], a[order], b[order]
    ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1 if len(bucket) else []
    lo = 0
    for hi in ends:
        yield pair, side, int(bucket[lo]), a[lo:hi].tobytes(), b[lo:hi].tobytes()
        lo = hi


def _by_y(pair: int, by: np.ndarray, vy: np.ndarray, rx: np.ndarray, alone: np.ndarray) -> list[tuple]:
    """Rows whose x has its rank: products where y has its own too, the others to y's buckets."""
    own = by % 2 == 1
    rows = list(_parted(pair, BY_Y, by[~own], vy[~own], rx[~own]))
    return rows + [_sums(pair, float((rx[own] * alone[by[own]]).sum()), 0.0, 0.0)] if own.any() else rows
