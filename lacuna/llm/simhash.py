"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at most `radius` bits apart share a variant that differs from each by at most radius / 2 bits.
Every distinct fingerprint therefore emits all variants in that ball, and fingerprints that share a variant
are linked; each such pair is at most `radius` apart by the triangle inequality. The variants are not sent one
by one: those of a fingerprint that agree in their leading `prefix` bits travel as one row (fingerprint, group of
variants) and are listed where they arrive. There, a sort of the variants finds the collisions, the
pairs found are verified, and a forest that connects the same fingerprints is kept instead of all pairs.
Rounds of large-star and small-star steps join the forests to components; each is a table in the shared folder.

Cases: texts with fewer words than a shingle are one shingle; null or wordless text has fingerprint zero and is linked
like any other; equal texts and repeated rows share a fingerprint; a missing id is no candidate for
component_id unless no other is there; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import ascii_lower, cut, drop_table, mix64, row_key, shuffle_partitions

BITS = 64
#: Variants that a task lists and sorts at a time.
MOST_VARIANTS = 4_000_000
LINKS = "a long, b long"


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes (unsigned 64-bit)."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    words = text.encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begin = np.concatenate([[0], ends[: -size]]).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[i:j], seed) for i, j in zip(begin, (ends[size - 1 :] - 1).tolist())), dtype=np.uint64, count=len(begin))


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keys: list[Column] | None = None) -> DataFrame:
    """(doc_id, fp) of every row, or, where keys are given, these (longs) in place of doc_id; fp holds the 64 bits as a signed long."""
    rows = docs.select(*(keys or [F.col(id_col).cast("long").alias("doc_id")]), ascii_lower(F.col(text_col)).alias("text"))
    names = [*rows.columns[:-1], "fp"]

    def run(batches):
        for b in batches:
            *own, text = b.columns
            fp = np.array([fingerprint(shingle_hashes(x.as_py() or "", size, seed)) for x in text], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*own, pa.array(fp.view(np.int64))], names=names)

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def masks(bits: int, most: int) -> np.ndarray:
    """All words of up to `most` set bits among the lowest `bits`."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


def _forest(a: np.ndarray, b: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (indices a, b) connect, each with the least fingerprint of its component in this task."""
    top = np.arange(len(fps))
    while len(a):
        lo, hi = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        rows = lo != hi
        a, b = a[rows], b[rows]
        np.minimum.at(top, hi[rows], lo[rows])
        while (up := top[top]).tobytes() != top.tobytes():
            top = up
    own = np.flatnonzero(top != np.arange(len(fps)))
    return fps[top[own]], fps[own]


def linked(fps: np.ndarray, flipped: np.ndarray, prefix: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints whose variants share leading bits. fps: sorted by (value as signed); flipped: how many leading bits differ from the group's."""
    half, parts = radius // 2, []
    for k in range(half + 1):
        rows = np.flatnonzero(flipped == k)
        if len(rows):
            parts.append((rows, masks(BITS - prefix, half - k)))
    total = sum(len(r) * len(m) for r, m in parts)
    low = np.uint64((1 << (BITS - prefix)) - 1)
    rounds = max(1, -(-total // MOST_VARIANTS))
    index_bits = np.uint64(max(1, int(len(fps) - 1).bit_length()))
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for turn in range(rounds):  # variants by hash, so that each round's fit in memory
        keys = []
        for rows, m in parts:
            for i in range(0, len(rows), 4096):
                r = rows[i : i + 4096]
                v = mix64((fps[r, None] & low) ^ m[None, :])
                idx = np.broadcast_to(r[:, None].astype(np.uint64), v.shape)
                if rounds > 1:
                    mine = (v & np.uint64(0xFFFF)) % np.uint64(rounds) == turn
                    v, idx = v[mine], idx[mine]
                keys.append((((v >> index_bits) << index_bits) | idx).ravel())
        keys = np.sort(np.concatenate(keys))
        idx = (keys & ((np.uint64(1) << index_bits) - np.uint64(1))).astype(np.int64)
        hashed = keys >> index_bits
        same = hashed[1:] == hashed[:-1]
        x, y = idx[:-1][same], idx[1:][same]
        near = np.bitwise_count(fps[x] ^ fps[y]) <= radius
        for group in np.unique(hashed[1:][same][~near]):  # unequal variants with one hash break a chain: compare its members
            own = np.unique(idx[np.searchsorted(hashed, group) : np.searchsorted(hashed, group, side="right")])
            for i in own:
                to = own[(own > i) & (np.bitwise_count(fps[own] ^ fps[i]) <= radius)]
                a, b = np.concatenate([a, np.full(len(to), i)]), np.concatenate([b, to])
        near &= x != y  # one fingerprint's own variants
        x, y = x[near], y[near]
        pairs = np.unique(np.minimum(x, y) * len(fps) + np.maximum(x, y))
        a, b = np.concatenate([a, pairs // len(fps)]), np.concatenate([b, pairs % len(fps)])
    return a, b


def prefix_for(n: int) -> int:
    """Leading bits by which variants are grouped: some tens of thousands of fingerprints a group at any size."""
    return int(np.clip(n // 10_000, 1 << 9, 1 << 18)).bit_length() - 1


def links(fps: DataFrame, radius: int = 4, prefix: int = 9) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp, unique): connects all that are at most `radius` bits apart."""
    spark, half = fps.sparkSession, radius // 2
    heads = F.shiftrightunsigned("fp", BITS - prefix)
    groups = F.array(*(F.struct(heads.bitwiseXOR(F.lit(int(m)).cast("long")).alias("head"), F.lit(int(m).bit_count()).alias("flipped")) for m in masks(prefix, half)))
    sent = fps.select("fp", F.explode(groups).alias("g")).select("fp", F.col("g.head").alias("head"), F.col("g.flipped").alias("flipped"))

    def meet(batches):
        held, of = [], None

        def flush():
            f, flipped = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(f)
            f, flipped = f[by], flipped[by]
            x, y = _forest(*linked(f.view(np.uint64), flipped, prefix, radius), np.arange(len(f))) if len(f) > 1 else ([], [])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(f[x]), pa.array(f[y])], names=["a", "b"])

        for b in batches:
            fp, head, flipped = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
            for i, j in zip([0, *cuts], [*cuts, len(head)]):
                if i == j:
                    continue
                if held and head[i] != of:
                    yield from flush()
                    held.clear()
                held.append((fp[i:j], flipped[i:j]))
                of = head[i]
        if held:
            yield from flush()

    n = shuffle_partitions(spark)
    return sent.repartitionById(n, (F.col("head") % n).cast("int")).sortWithinPartitions("head").mapInArrow(meet, LINKS)


def _star(edges: DataFrame, least: DataFrame, node: str, other: str) -> DataFrame:
    """Edges with `node` replaced by its least neighbour where that is smaller, as (a, b) with a > b."""
    moved = edges.join(least.select(F.col("a").alias(node), "m"), node, "left")
    return moved.select(F.col(other).alias("a"), F.coalesce("m", node).alias("b")).where("a <> b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable over the links (a, b), for every node of a link but the roots.

    Large-star and small-star steps by turns (Kiveris et al. 2014). A node's least neighbour is a minimum,
    combined before the shuffle; only nodes that have a smaller neighbour are joined back, from a stored
    table, so that Spark can split a node with very many links.
    """
    spark = edges.sparkSession
    now, path = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        # now: a > b. Small star: a node's smaller neighbours, and the node, go to the least of them
        least, at = cut(now.groupBy("a").agg(F.min("b").alias("m")), "small")
        small, to = cut(_star(now, least, "a", "b").unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        drop_table(spark, path)
        drop_table(spark, at)
        # large star: a node's larger neighbours go to its least neighbour
        least, at = cut(small.groupBy("a").agg(F.min("b").alias("m")), "large")
        now, path = cut(_star(small, least, "b", "a").distinct(), "large-star")
        drop_table(spark, to)
        drop_table(spark, at)
        last, mark = mark, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def _rooted(least: DataFrame, radius: int) -> DataFrame:
    """Adds each fingerprint's root (column fp, unique): the least fingerprint of its component."""
    roots = components(links(least.select("fp"), radius, prefix_for(least.count())))
    return least.join(roots, F.col("fp") == F.col("node"), "left").select(*least.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints, _ = cut(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    least, _ = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "least")
    # the least document of each component, over its fingerprints
    member, _ = cut(_rooted(least, radius), "members")
    first, _ = cut(member.groupBy("root").agg(F.min("doc").alias("component_id")), "first")
    component = member.join(first, "root").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_components(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row_key of one document of each component: the smallest id, missing ids last, and among equal ids the least digest."""
    prints, _ = cut(fingerprints(docs, size, seed, id_col, text_col, row_key(id_col, text_col)), "fingerprints")
    least, _ = cut(prints.groupBy("fp").agg(F.min(F.struct(*prints.columns[:-1])).alias("key")), "least")
    return _rooted(least, radius).groupBy("root").agg(F.min("key").alias("key")).select("key.*")
