"""Exact substring deduplication by super-k-mer partitioning.

A window is `width` consecutive words. Its minimiser is the least mixed hash among its shorter runs of words
(`grain`); consecutive windows with the same minimiser form a super-k-mer and travel as one packed string of
words, so a word is sent about three times instead of `width` times. Equal windows have equal minimisers and
meet in one bucket, where windows are sorted by a rolling hash and equal hashes are compared word by word.

Each task first settles the windows that repeat within its own rows, and sends only the first of each: a
passage that every document holds reaches its bucket once per task and batch, not once per document. A bucket settles
what it holds each time that passes MOST_BYTES and keeps the first of each window; one whose different windows alone are
more than half of that deals them out again, by minimisers of another order (by whole windows from level WHOLE_FROM on),
to buckets of the next level. So neither copies nor a frequent minimiser decide what a task holds.
The intervals of repeated windows then go back to their documents, where the covered words are dropped.

Windows are judged on the input: a window goes if the same words start earlier (smaller id, or same document and
earlier start). Cases: null or wordless text has no words (digest of the empty string); a missing id sorts
last and is kept; rows that agree in id and text are one document repeated, and all get the same result; with
equal ids and other text, the text's digest orders them; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import KEYS, chunks, cut, mix64, partitions_for, row_key, shuffle_partitions, text_bytes

#: Bytes of text that a task settles at a time, and that a bucket gets on average.
CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 3 << 20
#: Of the compression of what is sent.
LEVEL = 5
#: Most partitions; beyond, a partition takes several buckets, sorted, one after the other.
MOST_PARTITIONS = 50_000
#: Bytes that a bucket holds before it settles them, into how many a full one is split, and from which level on by whole windows.
MOST_BYTES = 32 << 20
SPLIT = 1024
WHOLE_FROM = 4
#: Bytes of text that are hashed at a time.
HASHED_BYTES = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C55)
_Q = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SENT = "bucket int, kind int, payload binary"
REPEATS = "_k1 long, _k2 long, _k3 long, start int, n int"
MET = REPEATS + ", bucket int, payload binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
KEPT_TEXT = KEPT + ", kept_text string"


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _Q and of its inverse, modulo 2**64."""
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * HASHED_BYTES, x, dtype=np.uint64))]) for x in (_Q, pow(_Q, -1, 2**64)))


def word_hashes(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of each word raw[begin:end], from prefix sums of blocks; words longer than a block by XXH64."""
    data, out, i = np.frombuffer(raw, dtype=np.uint8), np.empty(len(begin), dtype=np.uint64), 0
    up, down = _powers()
    while i < len(begin):
        at = int(begin[i])
        if end[i] - at > HASHED_BYTES:
            out[i] = xxhash.xxh64_intdigest(raw[at : end[i]])
            i += 1
            continue
        j = int(np.searchsorted(begin, at + HASHED_BYTES))
        j -= j - 1 > i and end[j - 1] - begin[j - 1] > HASHED_BYTES
        part = data[at : end[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        b = begin[i:j] - at
        out[i:j] = (sums[end[i:j] - at] - sums[b]) * down[b]
        i = j
    return mix64(out)


class Words:
    """The words of some texts, one after the other in `raw`, as hashes, with what the windows need. sizes: words of each text; or bounds: where each begins in raw."""

    def __init__(self, raw: bytes, width: int, sizes: np.ndarray | None = None, bounds: np.ndarray | None = None):
        space = np.concatenate([[True], _SPACE[np.frombuffer(raw, dtype=np.uint8)], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.raw, self.begin, self.end = raw, edges[::2], edges[1::2]
        self.hashed = word_hashes(raw, self.begin, self.end)
        if sizes is None:
            sizes = np.diff(np.append(np.searchsorted(self.begin, bounds), len(self.begin)))
        first = (np.cumsum(sizes) - sizes).astype(np.int32)
        n = np.maximum(sizes - width + 1, 0)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), n)
        self.start = np.arange(int(n.sum()), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)  # in its text
        self.at = self.start + np.repeat(first, n)  # among all words

    def rolled(self, k: int) -> np.ndarray:
        """The hash of the k words from each place on (of fewer at the end)."""
        n, out = len(self.hashed), np.zeros(len(self.hashed), dtype=np.uint64)
        for j in range(k):
            out *= _P
            out[: n - j] += self.hashed[j:]
        return out

    def numbers(self, at: np.ndarray, width: int) -> np.ndarray:
        """For the words of the windows from `at` on, numbers that are equal only for equal words."""
        n = len(self.begin) + width
        rows = np.flatnonzero(np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + width, minlength=n)))
        raw, known = self.raw, {}
        out = np.full(n, -1, dtype=np.int32)
        out[rows] = [known.setdefault(raw[i:j], len(known)) for i, j in zip(self.begin[rows].tolist(), self.end[rows].tolist())]
        return out


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of the k values from each place on."""
    out, have = x.copy(), 1
    while have < k:
        step = min(have, k - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _same(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(a), dtype=bool)
    for j in range(width):
        out &= numbers[a + j] == numbers[b + j]
    return out


def repeated(words: Words, order: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    """Which windows have an earlier equal one. order: keys of each window, the last the most important, as for lexsort."""
    n = len(words.at)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    hashed = words.rolled(width)[words.at]
    ordered = np.sort(hashed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return out
    rows = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashed), len(twice) - 1)] == hashed)  # few, in ordinary text
    rows = rows[np.lexsort((*(k[rows] for k in order), hashed[rows]))]
    near, numbers = hashed[rows[1:]] == hashed[rows[:-1]], words.numbers(words.at[rows], width)
    if not _same(numbers, words.at[rows[1:]][near], words.at[rows[:-1]][near], width).all():  # unequal windows with one hash: sort by the words
        rows = rows[np.lexsort((*(k[rows] for k in order), *(numbers[words.at[rows] + j] for j in range(width))))]
        near = _same(numbers, words.at[rows[1:]], words.at[rows[:-1]], width)
    earlier = np.concatenate([[False], near])
    # the same occurrence (a repeated row) is no repeat of itself
    group = np.cumsum(~earlier)
    head = rows[np.searchsorted(group, group)]
    out[rows] = earlier & np.logical_or.reduce([k[rows] != k[head] for k in order])
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of rows with equal keys begin."""
    n = len(keys[0])
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _intervals(keys: tuple[np.ndarray, ...], start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows, as keys, start and count, in the order of (document, start)."""
    rows = np.lexsort((start, *keys[::-1]))
    keys, start = tuple(k[rows] for k in keys), start[rows]
    begin = _runs(*keys, start - np.arange(len(start)))
    return *(k[begin] for k in keys), start[begin].astype(np.int32), np.diff(np.append(begin, len(start))).astype(np.int32)


def _pack(*arrays: np.ndarray, words: bytes = b"") -> bytes:
    """Arrays and a text in one compressed block, each array with its length and type before it."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        parts += [struct.pack("<cBI", a.dtype.kind.encode(), a.dtype.itemsize, len(a)), a.tobytes()]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([*parts, words]))


def _unpack(payload: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,), at, arrays = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size, length = struct.unpack_from("<cBI", raw, at)
        at += 6
        arrays.append(np.frombuffer(raw, dtype=f"<{kind.decode()}{size}", count=length, offset=at))
        at += size * length
    return arrays, raw[at:]


def _buckets(words: Words, level: int, width: int, grain: int) -> np.ndarray:
    """What a window's bucket goes by: its minimiser in the order of the level, or its whole hash."""
    salt = mix64(np.array([level], dtype=np.uint64)) if level else np.uint64(0)
    if level >= WHOLE_FROM:
        return mix64(words.rolled(width) ^ salt)[words.at]
    return mix64(_least(mix64(words.rolled(grain) ^ salt), width - grain + 1)[words.at])


def _dealt(words: Words, keys: tuple[np.ndarray, ...], start: np.ndarray, stay: np.ndarray, bucket: np.ndarray, width: int):
    """(bucket, payload) of the windows `stay`; consecutive ones with one bucket travel as one text."""
    bucket, at, owner = bucket[stay], words.at[stay], words.owner[stay]
    begin = _runs(bucket, at - np.arange(len(at)), owner)
    n = np.diff(np.append(begin, len(at)))
    first, last, raw = words.begin[at[begin]].tolist(), words.end[at[begin] + n + width - 2].tolist(), words.raw
    order = np.argsort(bucket[begin], kind="stable")
    for group in np.split(order, _runs(bucket[begin][order])[1:]) if len(order) else ():
        b = begin[group]
        spans = b"\n".join([raw[first[i] : last[i]] for i in group.tolist()])
        yield int(bucket[b[0]]), _pack(*(k[stay[b]] for k in keys), start[stay[b]].astype(np.int32), (n[group] + width - 1).astype(np.uint32), words=spans)


def _settled(rows: list, width: int, grain: int, buckets: int):
    """(bucket, kind, payload) of some rows (KEYS, text): kind 0 holds super-k-mers, kind 1 intervals that repeat within these rows."""
    texts = [(r[-1] or "").encode("utf-8", "replace") for r in rows]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    words = Words(b"\n".join(texts), width, bounds=bounds)
    del texts
    if not len(words.at):
        return
    keys = tuple(np.array([r[i] for r in rows], dtype=np.int64)[words.owner] for i in range(len(KEYS)))
    start = words.start.astype(np.int64)
    again = repeated(words, (start, *keys[::-1]), width)
    if again.any():
        gone = np.flatnonzero(again)
        yield int(keys[1][gone[0]] % buckets), 1, _pack(*_intervals(tuple(k[gone] for k in keys), start[gone]))
    bucket = (_buckets(words, 0, width, grain) % np.uint64(buckets)).astype(np.int64)
    for b, payload in _dealt(words, keys, start, np.flatnonzero(~again), bucket, width):
        yield b, 0, payload


def _judged(payloads: list[bytes], width: int) -> tuple[Words, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The words of a bucket, the keys and starts of its windows, and which windows have an earlier equal one."""
    arrays, own = zip(*map(_unpack, payloads))
    *keys, base, m = (np.concatenate(x) for x in zip(*arrays))
    words = Words(b"\n".join(own), width, sizes=m.astype(np.int64))
    keys, start = tuple(k[words.owner] for k in keys), base[words.owner] + words.start
    return words, keys, start, repeated(words, (start, *keys[::-1]), width)


class _Bucket:
    """Payloads of one bucket as they arrive; gives batches of MET."""

    def __init__(self, bucket: int, level: int, width: int, grain: int, most: int):
        self.bucket, self.level, self.width, self.grain, self.most = bucket, level, width, grain, most
        self.held: list[bytes] = []
        self.size, self.full = 0, False

    def add(self, payload: bytes):
        self.held.append(payload)
        self.size += zstandard.frame_content_size(payload)
        if self.size >= self.most and len(self.held) > 1:
            yield from self.settle()

    def settle(self, last: bool = False):
        if not self.held:
            return
        words, keys, start, again = _judged(self.held, self.width)
        self.held, self.size = [], 0
        gone = np.flatnonzero(again)
        yield met(_intervals(tuple(k[gone] for k in keys), start[gone]))
        if last and not self.full:
            return
        stay = np.flatnonzero(~again)
        if not self.full:
            for _, payload in _dealt(words, keys, start, stay, np.zeros(len(again), dtype=np.int64), self.width):
                self.held.append(payload)
            self.size = sum(map(zstandard.frame_content_size, self.held))
            self.full = self.size > self.most // 2
        if self.full:
            self.held, self.size = [], 0
            own = mix64(np.array([self.bucket], dtype=np.uint64))
            bucket = (mix64(_buckets(words, self.level + 1, self.width, self.grain) % np.uint64(SPLIT) + own) >> np.uint64(33)).astype(np.int64)
            for b, payload in _dealt(words, keys, start, stay, bucket, self.width):
                yield met(bucket=b, payload=payload)


def met(intervals=None, bucket: int | None = None, payload: bytes | None = None) -> pa.RecordBatch:
    types, names = [*[pa.int64()] * len(KEYS), pa.int32(), pa.int32()], [x.split()[0] for x in MET.split(", ")]
    n = 1 if intervals is None else len(intervals[0])
    cols = [pa.nulls(n, t) for t in types] if intervals is None else [pa.array(a, t) for a, t in zip(intervals, types)]
    return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(n, t) if x is None else pa.array([x], t) for x, t in ((bucket, pa.int32()), (payload, pa.binary())))], names=names)


def repeats(docs: DataFrame, width: int = 20, grain: int = 4, id_col: str = "doc_id", text_col: str = "text", n_bytes: int | None = None) -> DataFrame:
    """(KEYS, start, n): n consecutive windows from word `start` on have an earlier equal one. Intervals may come twice."""
    spark = docs.sparkSession
    n_bytes = text_bytes(docs, text_col) if n_bytes is None else n_bytes
    buckets = partitions_for(spark, n_bytes, BUCKET_BYTES)
    parts = min(buckets, max(MOST_PARTITIONS, shuffle_partitions(spark)))

    def send(batches):
        rows = (zip(*(b.column(i).to_pylist() for i in range(len(KEYS))), (x.as_py() for x in b.column(len(KEYS)))) for b in batches)
        for chunk in chunks(rows, lambda r: len(r[-1] or ""), CHUNK_BYTES):
            out = list(_settled(chunk, width, grain, buckets))
            for i in range(0, len(out), 512):
                bucket, kind, payload = zip(*out[i : i + 512])
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "kind", "payload"])

    def meet(level):
        def run(batches):
            now = None
            for b in batches:
                for bucket, kind, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if kind == 1:
                        yield met(_unpack(payload)[0])
                        continue
                    if now is None or bucket != now.bucket:
                        if now:
                            yield from now.settle(last=True)
                        now = _Bucket(bucket, level, width, grain, MOST_BYTES)
                    yield from now.add(payload)
            if now:
                yield from now.settle(last=True)

        return run

    sent = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string")).mapInArrow(send, SENT)
    out, level = None, 0
    while True:
        dealt = sent.repartitionById(parts, F.col("bucket") % parts)
        if level or parts < buckets:
            dealt = dealt.sortWithinPartitions("bucket")
        found, _ = cut(dealt.mapInArrow(meet(level), MET), "repeats")
        own = found.where("n is not null").select(*(x.split()[0] for x in REPEATS.split(", ")))
        out = own if out is None else out.unionByName(own)
        sent = found.where("n is null").select("bucket", F.lit(0).alias("kind"), "payload")
        size = sent.agg(F.sum(F.length("payload")).alias("n")).collect()[0]["n"]
        if not size:
            return out
        parts, level = min(max(MOST_PARTITIONS, shuffle_partitions(spark)), partitions_for(spark, size, BUCKET_BYTES)), level + 1


def drop_repeats(docs: DataFrame, width: int = 20, grain: int = 4, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Every document without the words that a repeated window covers: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    gone = repeats(docs, width, grain, id_col, text_col).groupBy(*KEYS).agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_key(id_col, text_col))

    def keep(batches):
        for b in batches:
            out = []
            for doc, text, spans in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), b.column(2).to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                keep = words
                if spans:
                    covered = np.zeros(len(words) + 1, dtype=np.int32)
                    for x in spans:
                        covered[x["start"]] += 1
                        covered[x["start"] + x["n"] + width - 1] -= 1
                    keep = [words[i] for i in np.flatnonzero(np.cumsum(covered)[:-1] == 0)]
                kept = b" ".join(keep)
                row = (doc, len(words), len(words) - len(keep), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode()) if with_text else row)
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in (KEPT_TEXT if with_text else KEPT).split(", ")])

    return rows.join(gone, KEYS, "left").select("doc_id", "text", "gone").mapInArrow(keep, KEPT_TEXT if with_text else KEPT)
