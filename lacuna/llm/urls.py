"""URL filters on a sorted digest array.

Every rule is a host and a path prefix. Its string goes into an array sorted by 64-bit xxhash, beside the offsets of the
full strings; the array lies in a file that Spark hands to the executors and every worker maps into memory. A URL
probes the suffixes of its host with the prefixes of its path whose lengths occur among the rules: vectorised binary
search finds equal digests and the stored strings confirm them, so a collision never decides.

A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins (of equally long ones, that with
the longer host). URLs that no rule fits get the default verdict. Cases: null and URLs without :// have an empty
host and path; hosts keep a port or user; repeated rows are judged alike; empty tables give no rows; extra
columns are ignored; long URLs are judged whole.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICTS = "page_id long, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host with A-Z lower-cased."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    path = rest[end:]
    cut = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host, path[:cut]


def write_index(rules: list[tuple[str, str]], to: str) -> None:
    """rules: (verdict, host + path). Layout: n, number of path lengths, the lengths, sorted keys, offsets, verdicts, strings."""
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v == "allow") for v, r in dict((r, (v, r)) for v, r in rules).values())
    lengths = sorted({len(r.decode()) - r.decode().index("/") for _, r, _ in rows})
    offsets = np.concatenate([[0], np.cumsum([len(r) for _, r, _ in rows])]).astype(np.int64)
    with open(to, "wb") as f:
        for part in (np.array([len(rows), len(lengths)], np.int64), np.array(lengths, np.int64), np.array([k for k, _, _ in rows], np.uint64), offsets, np.array([a for *_, a in rows], np.int64)):
            f.write(part.tobytes())
        f.write(b"".join(r for _, r, _ in rows))


class Index:
    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n, m = raw[:16].view(np.int64)
        at = 16
        self.lengths = raw[at : at + 8 * m].view(np.int64)
        at += 8 * m
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.allow = raw[at : at + 8 * n].view(np.int64)
        self.strings = raw[at + 8 * n :]

    def stored(self, row: int) -> bytes:
        return self.strings[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def best(self, pairs: list[tuple[str, str]]) -> list[tuple[str, bool] | None]:
        """For each (host, path) the longest rule that fits, and whether it allows."""
        probes, owner = [], []
        for k, (host, path) in enumerate(pairs):
            if not path:
                continue
            labels = host.split(".")
            fits = [path[:n] for n in self.lengths.tolist() if n <= len(path)]
            for i in range(len(labels)):
                suffix = ".".join(labels[i:])
                for p in fits:
                    probes.append(f"{suffix}{p}".encode("utf-8", "replace"))
                    owner.append((k, len(suffix) + len(p), len(suffix)))
        out: list = [None] * len(pairs)
        if not probes or not len(self.keys):
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.keys, digests)
        held: dict[int, tuple] = {}
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests):
            row = int(at[i])
            while row < len(self.keys) and self.keys[row] == digests[i]:  # equal digests of different strings lie side by side
                if self.stored(row) == probes[i]:
                    k, length, host_length = owner[i]
                    if k not in held or (length, host_length) > held[k][:2]:
                        held[k] = (length, host_length, probes[i].decode(), bool(self.allow[row]))
                row += 1
        for k, (_, _, rule, allow) in held.items():
            out[k] = (rule, allow)
        return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """rules: (verdict, "host/path"), verdict allow or block. One row per page."""
    spark = pages.sparkSession
    file = os.path.join(tempfile.mkdtemp(prefix="lacuna-urls-"), f"urls-{os.urandom(8).hex()}.idx")
    write_index(rules, file)
    spark.sparkContext.addFile(file)
    name = os.path.basename(file)

    def run(batches):
        index = Index(SparkFiles.get(name))
        for b in batches:
            pairs = [split_url(x.as_py()) for x in b.column(1)]
            found = index.best(pairs)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h for h, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string()), pa.array([x and x[0] for x in found], pa.string()), pa.array([("allow" if x[1] else "block") if x else default for x in found], pa.string())],
                names=[x.split()[0] for x in VERDICTS.split(", ")],
            )

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")).mapInArrow(run, VERDICTS)
