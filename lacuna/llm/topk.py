"""Exact top-k inner-product search by norm-bucketed retrieval.

Candidates are grouped by length: blocks of similar length, and within a block buckets sorted by length. A query
holds the k-th best score found so far; divided by its own and a bucket's greatest length it becomes a local cosine
threshold. Above 1 the bucket is skipped; near 1 the bucket is pruned by coordinates (a vector so close to the query must
agree with it in the query's largest coordinates); below, by length alone. What is left is verified by exact
products. The first thresholds come from the `seeds` longest candidates, a bounded sample of the table.

Queries get their first thresholds before anything meets. Divided by its own length, a threshold is the length that a candidate must
have at least, its reach: candidates are dealt to blocks of like length (a common length to as many blocks as its rows need), queries to blocks of like
reach, and only those blocks meet, one task a pair, whose longest candidate is as long as the least reach. Each task returns k rows a query. Components are whole numbers floor(scale * x); products are exact (float arithmetic while all
sums stay below 2^53, else Python's integers). Cases: vectors that are null or hold null or non-finite components, and rows without id,
take no part; vectors of another dimension than the query's are no candidates; ties go to the smaller id; a query's own
rows are those with its id; repeated candidate rows count each, a repeated query is answered once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.llm.common import cut, shuffle_partitions

FOUND = "query_id long, query_key long, vec_id long, score long"
BUCKET = 512
BLOCK = 16_384
QUERY_BLOCK = 8_192
#: Local cosine thresholds from which coordinates prune, and how many of them.
COORDINATES_FROM, COORDINATES = 0.8, 3


def _valid(col: Column) -> Column:
    return col.isNotNull() & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def vectors(table: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """(id, vec, length) of the rows that take part; length is that of the whole numbers."""
    vec = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & _valid(F.col("vec")))
    return rows.withColumn("length", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))))


def _matrix(column: pa.ChunkedArray | pa.Array, scale: float) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.reshape(len(column), -1))


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (a @ b.T).astype(np.int64)
    lo, hi = -(2**63), 2**63 - 1
    x, y = ([[int(v) for v in r] for r in m] for m in (a, b))
    return np.array([[min(hi, max(lo, sum(p * q for p, q in zip(r, s)))) for s in y] for r in x], dtype=np.int64).reshape(len(a), len(b))


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        q, v, s = np.concatenate([self.query, query]), np.concatenate([self.vec, vec]), np.concatenate([self.score, score])
        by = np.lexsort((v, -s.astype(object) if len(s) and s.min() == -(2**63) else -s, q))
        q, v, s = q[by], v[by], s[by]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.query, self.vec, self.score = q[keep], v[keep], s[keep]
        full = np.flatnonzero(np.arange(len(self.query)) - np.searchsorted(self.query, self.query) == self.k - 1)
        self.least[self.query[full]] = self.score[full].astype(float)


def search(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> Best:
    """q, v: whole numbers as float. least: scores that the k best of each query are known to reach."""
    best = Best(len(q), k)
    floor = np.full(len(q), -np.inf) if least is None else least
    q_len, v_len = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    exact = bool(q_len.max(initial=0) * v_len.max(initial=0) < 2**52)
    order = np.argsort(-v_len, kind="stable")
    v, v_ids, v_len = v[order], v_ids[order], v_len[order]
    unit = q / np.where(q_len > 0, q_len, 1)[:, None]
    slack = 1 + 1e-9
    for i in range(0, len(v), BUCKET):
        bv, bi, bl = v[i : i + BUCKET], v_ids[i : i + BUCKET], v_len[i : i + BUCKET]
        need = np.maximum(floor, best.least)
        reach = q_len * bl[0] * slack
        active = np.flatnonzero((reach >= need) | (need <= 0))
        if not len(active):
            continue
        cosine = np.where(reach[active] > 0, need[active] / np.where(reach[active] > 0, reach[active], 1), -1.0)
        close = cosine >= COORDINATES_FROM
        near = bv / np.where(bl > 0, bl, 1)[:, None]
        for a, t in zip(active[close], cosine[close]):
            rows = np.arange(len(bv))
            for c in np.argsort(-np.abs(unit[a]))[:COORDINATES]:
                x = unit[a, c]
                spread = np.sqrt(max(0.0, (1 - min(t, 1.0) ** 2) * (1 - x * x))) + 1e-9
                side = near[rows, c]
                rows = rows[(side >= x * min(t, 1.0) - spread) & ((side <= x * min(t, 1.0) + spread) | (x > 0))] if x > 0 else rows[side <= x * min(t, 1.0) + spread]
            if len(rows):
                s = _products(q[a : a + 1], bv[rows], exact)[0]
                ok = (s >= need[a]) & (bi[rows] != q_ids[a])
                best.add(np.full(int(ok.sum()), a), bi[rows][ok], s[ok])
        rest = active[~close]
        if len(rest):
            # the lengths that can reach the threshold are a prefix of the bucket
            shortest = np.where(need[rest] > 0, need[rest] / np.where(q_len[rest] > 0, q_len[rest], 1) / slack, 0)
            m = int(np.searchsorted(-bl, -shortest.min(), side="right"))
            s = _products(q[rest], bv[:m], exact)
            x, y = np.nonzero((s >= need[rest][:, None]) & (bi[None, :m] != q_ids[rest][:, None]))
            best.add(rest[x], bi[y], s[x, y])
    return best


def _position(cuts: Column, x: Column, n: int) -> Column:
    """How many of the n sorted cuts are at most x, by halving."""
    steps = F.array(*(F.lit(1 << j) for j in reversed(range(max(1, n.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(cuts, at + step - 1) <= x, F.lit(False)), step).otherwise(0))


def dealt(rows: DataFrame, by: str, n: int, size: int, name: str) -> DataFrame:
    """Adds the column `name`: the number of a block of about `size` rows with like values of `by` (n blocks, about, are rows / size). Equal values are spread by id over as many blocks as they fill."""
    if n <= 1:
        return rows.withColumn(name, F.lit(0))
    cuts = rows.agg(F.array_sort(F.array_distinct(F.percentile_approx(by, [i / n for i in range(1, n)], 10_000))).alias("_cuts"))
    kept = rows.crossJoin(F.broadcast(cuts)).withColumn("_at", _position(F.col("_cuts"), F.col(by), n)).drop("_cuts")  # one row of fewer than n cuts
    counts = kept.groupBy("_at").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("_k"))  # at most n rows
    first = counts.select("_at", "_k", (F.sum("_k").over(W.orderBy("_at")) - F.col("_k")).cast("int").alias("_first"))
    return kept.join(F.broadcast(first), "_at").withColumn(name, F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")).select(*rows.columns, name)


def with_reach(asked: DataFrame, seed: list, k: int, scale: float) -> DataFrame:
    """(id, vec, key, need, reach): need is the score that the k best are known to reach among the seeds (null: none), reach the length a candidate must have for it."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["vec"]) for r in seed}:
        own = [r for r in seed if len(r["vec"]) == d]
        by_dim[d] = np.floor(scale * np.array([r["vec"] for r in own])), np.array([r["id"] for r in own], dtype=np.int64)

    def run(batches):
        for b in batches:
            ids, vec = b.column("id").to_numpy(), b.column("vec")
            dims = np.diff(vec.offsets.to_numpy())
            need, reach = np.full(len(ids), -np.inf), np.full(len(ids), 0.0)
            for d in np.unique(dims):
                if d == 0 or int(d) not in by_dim:
                    continue
                rows = np.flatnonzero(dims == d)
                q = _matrix(vec.take(pa.array(rows)), scale)
                need[rows] = search(q, ids[rows], *by_dim[int(d)], k).least
                length = np.linalg.norm(q, axis=1)
                reach[rows] = np.where((need[rows] > 0) & (length > 0), need[rows] / np.where(length > 0, length, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(need, mask=~np.isfinite(need)), pa.array(reach)], names=[*b.schema.names, "need", "reach"])

    return asked.mapInArrow(run, "id long, vec array<double>, key long, need double, reach double")


def top_k(table: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, seeds: int = 512, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products. queries: a condition on the id (column `id`)."""
    spark = table.sparkSession
    rows, _ = cut(vectors(table, id_col, vec_col, scale), "vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(queries, 1)).alias("q")).collect()[0]
    n_blocks = max(shuffle_partitions(spark), -(-sizes["n"] // BLOCK))
    q_blocks = max(1, -(-sizes["q"] // QUERY_BLOCK))
    seed = rows.orderBy(F.desc("length"), "id").limit(seeds).collect()  # bounded
    asked = rows.where(queries).select("id", "vec").distinct().withColumn("key", F.xxhash64("id", "vec"))
    asked, _ = cut(dealt(with_reach(asked, seed, k, scale), "reach", q_blocks, QUERY_BLOCK, "q_block"), "queries")
    own, _ = cut(dealt(rows, "length", n_blocks, max(1, -(-sizes["n"] // n_blocks)), "block"), "candidates")
    # which blocks meet: at most one row a pair of blocks
    least = asked.groupBy("q_block").agg(F.min("reach").alias("_least"))
    most = own.groupBy("block").agg(F.max("length").alias("_most"))
    pairs, _ = cut(most.join(least, F.col("_most") * (1 + 1e-9) >= F.col("_least")).select("block", "q_block"), "pairs")
    cells = own.join(pairs.groupBy("block").agg(F.collect_list("q_block").alias("_to")), "block").select("id", "vec", "block", F.explode("_to").alias("q_block"))
    asked = asked.join(pairs.groupBy("q_block").agg(F.collect_list("block").alias("_to")), "q_block").select("id", "vec", "key", "need", "q_block", F.explode("_to").alias("block"))

    def meet(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        dims = [np.diff(t.column("vec").combine_chunks().offsets.to_numpy()) if t.num_rows else np.zeros(0, int) for t in (candidates, queries)]
        for d in np.unique(dims[1]):
            own, asked = candidates.filter(pa.array(dims[0] == d)), queries.filter(pa.array(dims[1] == d))
            if d == 0 or not own.num_rows:
                continue
            q, q_ids = _matrix(asked.column("vec"), scale), asked.column("id").to_numpy()
            need = asked.column("need").to_numpy()
            best = search(q, q_ids, _matrix(own.column("vec"), scale), own.column("id").to_numpy(), k, np.where(np.isnan(need), -np.inf, need))
            for to, x in zip(found, (q_ids[best.query], asked.column("key").to_numpy()[best.query], best.vec, best.score)):
                to.append(x)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in found], names=[x.split()[0] for x in FOUND.split(", ")])

    found = cells.groupBy("block", "q_block").cogroup(asked.groupBy("block", "q_block")).applyInArrow(meet, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
