"""What the operators share: row keys, dealing rows to partitions, tables in the shared folder, word splitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.store import cut, drop_table, scratch, shared_dir  # noqa: F401  for the operators

#: Missing ids sort after all others.
LAST_ID = 2**63 - 1
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


KEYS = ["_k1", "_k2", "_k3"]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """KEYS, all longs: the id, missing ids last; two 32-bit digests of the text, the CRC-32 before part of its XXH64; where the id is missing, another XXH64.

    Rows that agree in all are one document repeated: texts are told apart by 64 bits under one id, and by 128 bits without an id.
    """
    number, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = F.shiftleft(F.crc32(text.cast("binary")) - F.lit(1 << 31), 32)  # signed, in the order of the CRC-32
    second = F.when(number.isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(F.lit(0).cast("long"))
    return [c.alias(k) for c, k in zip((F.coalesce(number, F.lit(LAST_ID)), first.bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))), second), KEYS)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_bytes(df: DataFrame, col: str) -> int:
    """Bytes of a text column: one aggregate over one column."""
    return int(df.agg(F.sum(F.octet_length(col)).alias("n")).collect()[0]["n"] or 0)


def partitions_for(spark: SparkSession, n_bytes: float, target: float) -> int:
    """As many partitions as keep each near target bytes, and no fewer than the session's."""
    return max(shuffle_partitions(spark), int(n_bytes // target) + 1)


# splitmix64
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chunks(batches, size_of, most: int):
    """Regroups lists of rows so that each group has about `most` bytes."""
    rows, held = [], 0
    for batch in batches:
        for row in batch:
            rows.append(row)
            held += size_of(row)
            if held >= most:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows
