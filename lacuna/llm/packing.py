"""Best-fit packing of token sequences, after a dominance reduction of the instance.

The instance is small however many documents there are: piece lengths are whole numbers up to the capacity, so
a histogram of lengths (at most `capacity` rows) is all the solver sees. It follows Martello and Toth: sets
of one, two or three pieces that provably dominate every other set with the same largest piece are fixed
for good, the instance shrinks, and best-fit decreasing packs what remains. Its plan says, for each length,
which ranks go to which sequences and offsets; every task applies it to its own pieces.

Cases: null text is empty (one end token); equal texts and repeated rows are pieces of their own; an empty
table gives no rows; extra columns are ignored; texts of any length are cut into whole pieces.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.llm.common import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Words of a generation that a worker keeps with their ids (two generations of whole words, and two of half as many parts), and the length up to which it keeps one.
CACHED_WORDS = 300_000
CACHED_LENGTH = 64
#: Marks that end words, and the first character above those that are letters to every version of the pattern.
MARKS = frozenset(".,;:!?")
PLAIN = "\u0250"


class _Unsafe(Exception):
    """A space beside other white space: the text cannot be cut at single spaces."""


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)}


class _Recent(dict):
    """What `make` gives for a key; keys used lately are kept, in two generations of at most `most`."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class _Words(_Recent):
    """Words by the same. One that ends in a mark is the word before it, looked up here, and the mark; one with a line end between other characters is a word, the line end, and a word that no space precedes."""

    def __init__(self, make, most: int, parts: _Recent, bare: "_Words | None" = None):
        super().__init__(make, most)
        self.parts, self.bare = parts, bare

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            if key[-1:] in MARKS and (own := key[:-1]).isalpha() and (own.isascii() or max(own) < PLAIN):
                value = self[own] + self.parts[key[-1]]
            elif key.count("\n") == 1 and not (key[0].isspace() or key[-1].isspace()) and not (key[(at := key.index("\n")) - 1].isspace() or key[at + 1].isspace()):
                bare = self if self.bare is None else self.bare
                value = self[key[:at]] + self.parts["\n"] + bare[key[at + 1 :]]
            else:
                value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TokenBytes:
    """Texts to little-endian 32-bit ids by a byte-level tokenizer, word by word with a bounded cache.

    The pretokenizer's pattern always starts a new word at a single space between other characters, so the
    parts between such spaces can be encoded alone; texts with other runs of white space are cut by the
    pattern itself. A text that holds the string of an added token (the end of text, say) goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        import regex
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        tokenize, letters, words_of = self.tokenizer.model.tokenize, _byte_letters(), regex.compile(public_tokenizers.PATTERN).findall

        # closures, so that nothing here refers back to self: a cycle would outlive its task
        def spell(w: str) -> bytes:
            if w.isascii() and (w.isalpha() or w[0] == " " and w[1:].isalpha()):
                spelled = w.replace(" ", letters[32])
            else:
                spelled = w.encode("utf-8", "replace").decode("latin-1").translate(letters)
            return pack_ids([t.id for t in tokenize(spelled)])

        parts = _Recent(spell, CACHED_WORDS // 2)

        def after(space: str):
            spelled_space = letters[32] if space else ""

            def chunk(w: str) -> bytes:
                if w.isalpha():  # kept as a word, so not as a part besides
                    if w.isascii():
                        return pack_ids([t.id for t in tokenize(spelled_space + w)])
                    if max(w) < PLAIN:
                        return spell(space + w)
                if not w:
                    if space:
                        raise _Unsafe
                    return b""
                if w[0].isspace() or w[-1].isspace():
                    raise _Unsafe
                return b"".join(map(parts.__getitem__, words_of(space + w)))

            return chunk

        first = _Words(after(""), CACHED_WORDS // 2, parts)
        self.first, self.words, self.parts, self.words_of = first, _Words(after(" "), CACHED_WORDS, parts, first), parts, words_of

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.split(" ")
        try:
            return self.first[words[0]] + b"".join(map(self.words.__getitem__, words[1:]))
        except _Unsafe:
            return b"".join(map(self.parts.__getitem__, self.words_of(text)))


def pack_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=1)
def token_bytes(path: str) -> TokenBytes:
    """One for all tasks of a worker, so that its words are kept from task to task, and held once."""
    return TokenBytes(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its rank (nth) among the pieces of its length in its task (part)."""

    def run(batches):
        to_ids = token_bytes(tokenizer)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = pack_ids([end_id])
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = to_ids(text.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    length = (n % capacity or capacity) if k == 0 else capacity
                    out.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, seen[length]))
                    seen[length] += 1
                    at, k = at + length, k + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


class _Stock:
    """Lengths with pieces left, in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v}
        self.keys = sorted(self.left)

    def add(self, length: int, n: int) -> None:
        """n may be negative; a length without pieces goes."""
        if length not in self.left:
            self.left[length] = 0
            self.keys.insert(bisect_right(self.keys, length), length)
        self.left[length] += n
        if not self.left[length]:
            del self.left[length]
            self.keys.pop(bisect_right(self.keys, length) - 1)

    def largest(self, most: int) -> int | None:
        """The largest length with a piece left, up to most."""
        k = bisect_right(self.keys, most)
        return self.keys[k - 1] if k else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixes dominating sets; returns [(lengths of a set, how many such sequences)] and the counts left.

    For each piece j, the largest first, and the room r beside it: {j} dominates if nothing fits; {j, i} with i the largest
    that fits dominates if i fills r, or if no two pieces fit together; {j, a, b} dominates if no three fit
    and every pair that fits is matched piece by piece by (a, b). Lengths at which no set dominates stay, and smaller pieces may still go with them.
    """
    stock, fixed = _Stock(counts), []
    for j in sorted(counts, reverse=True):
        while stock.left.get(j):
            stock.add(j, -1)
            group = _dominating(stock, j, capacity - j)
            stock.add(j, 1)
            if group is None:
                break
            n = min(stock.left[x] // k for x, k in Counter(group).items())  # the set dominates for as long as it lasts
            fixed.append((group, n))
            for x in group:
                stock.add(x, -n)
    return fixed, stock.left


def _dominating(stock: _Stock, j: int, r: int) -> tuple[int, ...] | None:
    i = stock.largest(r)
    if i is None:
        return (j,)
    least = stock.keys[0]
    second = least if stock.left[least] > 1 else stock.keys[1] if len(stock.keys) > 1 else r
    if i == r or least + second > r:
        return (j, i)
    return _triple(stock, j, i, r)


def _triple(stock: _Stock, j: int, i: int, r: int) -> tuple[int, ...] | None:
    """(j, i, b) if no three pieces fit beside j and every pair that fits is matched by (i, b)."""
    smallest = stock.keys[0]
    if 3 * smallest <= r:
        return None
    own = stock.left[i]
    if own == 1:
        b = stock.largest(min(r - i, i - 1))
    else:
        b = stock.largest(r - i)
    if b is None or b > i:
        return None
    at = bisect_right(stock.keys, i) - 1
    for a in stock.keys[: at + 1]:
        if a < b:
            continue
        best = stock.largest(min(a if stock.left[a] > 1 else a - 1, r - a))
        if best is not None and best > b:
            return None
    return (j, i, b)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: sequences that look alike are held as one pattern and a count."""
    room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(pattern, n):
        r = capacity - sum(pattern)
        if not room[r]:
            rooms.insert(bisect_right(rooms, r), r)
        room[r].append([pattern, n])

    for length in sorted(counts, reverse=True):
        c = counts[length]
        while c:
            at = bisect_right(rooms, length - 1)
            r = rooms[at] if at < len(rooms) else capacity
            if r == capacity:
                pattern, have = (), c
            else:
                pattern, have = room[r].pop()
                if not room[r]:
                    rooms.pop(at)
            k = r // length
            full = min(have, c // k)
            if full:
                put((*pattern, *[length] * k), full)
                c, have = c - full * k, have - full
            if c and have and c < k:
                put((*pattern, *[length] * c), 1)
                c, have = 0, have - 1
            if have and pattern:
                put(pattern, have)
    return [(tuple(p), n) for groups in room.values() for p, n in groups]


def pack(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def plan(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset), by rank: rank q goes to sequence first sequence + q - first rank."""
    used, out, sequence = defaultdict(int), defaultdict(list), 0
    for lengths, n in patterns:
        at = 0
        for length in lengths:
            out[length].append((used[length], sequence, at))
            used[length] += n
            at += length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """sequence_id and offset for a table of pieces (read twice, so it should be a stored one)."""
    by_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_task, _ = cut(by_task, "packing-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(pack(counts, capacity))
    before = by_task.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def run(batches):
        for b in batches:
            length, nth = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for k in np.unique(length):
                rows, table = np.flatnonzero(length == k), slots[int(k)]
                at = np.searchsorted(table[:, 0], nth[rows], side="right") - 1
                sequence[rows], offset[rows] = table[at, 1] + nth[rows] - table[at, 0], table[at, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in PLACED.split(", ")])

    # both sides grow with the table: no broadcast
    joined = pieces.join(before.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "before")
    return joined.mapInArrow(run, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and place."""
    pieces, _ = cut(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "packing-pieces")
    return place(pieces, capacity)
