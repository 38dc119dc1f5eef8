"""Rank sums of many nested sets of rows at once, without a row for each set.

A row has a value and a code of two bits a cell: whether it is seen by the cell's set, and whether it counts as one
of the set's first group. Tasks deal packed rows to buckets by value, a bucket ranks its own, and bucket totals are
added up. Equal values that are many in a task travel as their totals, so a bucket of one value stays small. Results are exact whatever the cuts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells of a 64-bit code, rows that a task gathers before it deals them, equal values in them that travel as totals.
CELLS, GATHERED, MANY = 31, 200_000, 64
SEEN, ONE = 2, 3  # codes of a cell: in the set, in its first group (0: not in the set)
BUCKETS = 256
DEALT = "key int, bucket int, v binary, codes binary, tv binary, totals binary"
_NAMES = [x.split()[0] for x in DEALT.split(", ")]
_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def cut_points(found) -> np.ndarray:
    """Approximate quantiles (a list, or null where there are no values) as distinct ascending cuts."""
    return np.unique(np.array([x for x in found or [] if x is not None], dtype=np.float64))


def approximate_cuts(value) -> "F.Column":
    return F.percentile_approx(F.when(~F.isnan(value), value), [i / BUCKETS for i in range(1, BUCKETS)], 2000)


def _bits(codes: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    own = codes[:, cell // CELLS] >> (2 * (cell % CELLS))
    return (own >> 1) & 1, own & 1


class Gathered:
    """Rows of one key in a task, dealt out whenever they are GATHERED."""

    def __init__(self, key: int, cells: int, cuts: np.ndarray):
        self.key, self.cells, self.cuts, self.values, self.codes, self.n = key, cells, cuts, [], [], 0

    def add(self, values: np.ndarray, codes: np.ndarray) -> list[tuple]:
        self.values.append(values)
        self.codes.append(codes)
        self.n += len(values)
        return self.deal() if self.n >= GATHERED else []

    def deal(self) -> list[tuple]:
        if not self.n:
            return []
        v, codes = np.concatenate(self.values), np.concatenate(self.codes)
        self.values, self.codes, self.n = [], [], 0
        order = np.argsort(v, kind="stable")
        v, codes = v[order], codes[order]
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        many = np.diff(np.r_[starts, len(v)]) >= MANY
        in_many = np.repeat(many, np.diff(np.r_[starts, len(v)]))
        tv, hot, at = v[starts[many]], codes[in_many], np.cumsum(np.r_[0, np.diff(np.r_[starts, len(v)])[many]])[:-1]
        totals = np.zeros((len(tv), self.cells, 2), dtype=np.int64)
        for cell in range(self.cells if len(tv) else 0):
            for i, bits in enumerate(_bits(hot, cell)):
                totals[:, cell, i] = np.add.reduceat(bits, at)
        v, codes = v[~in_many], codes[~in_many]
        b, tb = np.searchsorted(self.cuts, v), np.searchsorted(self.cuts, tv)
        out = []
        for k in np.union1d(b, tb):
            (lo, hi), (tlo, thi) = (np.searchsorted(x, [k, k + 1]) for x in (b, tb))
            out.append((self.key, int(k), v[lo:hi].tobytes(), codes[lo:hi].tobytes(), tv[tlo:thi].tobytes(), totals[tlo:thi].tobytes()))
        return out


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def rank_sums(dealt: DataFrame, cells: int) -> DataFrame:
    """key, cell, n, n1, ranks (the sum of the first group's average ranks within the cell's set) from what `Gathered` dealt; cells without rows give none."""
    chunks = -(-cells // CELLS)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in pdf[c]])
        v, codes, tv, totals = read("v", np.float64), read("codes", np.int64).reshape(-1, chunks), read("tv", np.float64), read("totals", np.int64).reshape(-1, cells, 2)
        known, at = np.unique(np.concatenate([v, tv]), return_inverse=True)
        own, hot = at[: len(v)], at[len(v) :]
        count = lambda w, i: np.bincount(i, w, len(known)).astype(np.int64)
        out = []
        for cell in range(cells):
            n, n1 = (count(bits, own) + count(totals[:, cell, i], hot) for i, bits in enumerate(_bits(codes, cell)))
            if n.any():
                out.append((key[0], cell, key[1], int(n.sum()), int(n1.sum()), int((n1 * (2 * (np.cumsum(n) - n) + n + 1)).sum())))
        return pd.DataFrame(out, columns=["key", "cell", "bucket", "n", "n1", "twice"])

    # a row for each cell and bucket from here
    own = dealt.groupBy("key", "bucket").applyInPandas(run, "key int, cell int, bucket int, n long, n1 long, twice long")
    below = F.sum("n").over(W.partitionBy("key", "cell").orderBy("bucket")) - F.col("n")
    return own.withColumn("_below", below).groupBy("key", "cell").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), (F.sum(F.col("twice") + 2 * F.col("n1") * F.col("_below")) / 2).alias("ranks"))
