"""Secret scans by one combined deterministic automaton.

The rules' regular expressions (a subset: literals, escapes, classes, groups, alternation, ?, *, +, {m}, {m,}, {m,n}) are parsed to
an automaton with choices, made deterministic by subset construction over byte classes, minimised by partition
refinement, and laid out as transition rows of 256 bytes. One pass over a text's UTF-8 bytes tells where which rules
end a match; only round such an end, in the run of bytes that the rule can consume at all, that rule's own automaton finds the exact spans: leftmost,
not overlapping, longest head and then longest tail, with spans whose checked part is too short dropped.

Cases: null and empty texts have no spans; spans are in code points whatever the script; repeated rows are scanned
alike; an empty table gives no rows; extra columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    """head then tail; least: the fewest bytes of the tail (counted: "tail") or of the whole ("all"). probe: what the combined pass looks for, if it can be narrower."""

    name: str
    head: str
    tail: str
    least: int
    counted: str = "all"
    any_case: bool = False
    probe: str = ""


#: The base kinds, in the order in which they are listed, and then the kinds that the scan adds.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 8, "tail", any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]+", 32, probe="[0-9a-f]{32}"),
)
ADDED = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 40),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 39),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 20),
    Rule("stripe", "(sk|rk)_live_", "[A-Za-z0-9]+", 24),
    Rule("pem", "-----BEGIN ([A-Z]+ )?PRIVATE KEY", "-----", 5),
)


class _Parser:
    """A regular expression to a tree: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def tree(self):
        out = self.either()
        if self.i < len(self.p):
            raise ValueError(f"cannot read {self.p!r} at {self.i}")
        return out

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def either(self):
        parts = [self.run()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.run())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def run(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("cat", parts)

    def repeat(self, atom):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                lo, comma, hi = self.p[self.i : end].partition(",")
                self.i = end + 1
                least, most = int(lo), int(hi) if hi else None if comma else int(lo)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            atom = ("rep", atom, least, most)
        return atom

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            out = self.either()
            if self.peek() != ")":
                raise ValueError(f"no ) in {self.p!r}")
            self.i += 1
            return out
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.cased({self.byte(c)}))

    def byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c) or ord(c)

    def members(self) -> frozenset:
        out, negated = set(), self.peek() == "^"
        self.i += negated
        while (c := self.p[self.i]) != "]":
            self.i += 1
            lo = hi = self.byte(c)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 2
                hi = self.byte(self.p[self.i - 1])
            out |= set(range(lo, hi + 1))
        self.i += 1
        out = set(self.cased(out))
        return frozenset(range(256)) - out if negated else frozenset(out)

    def cased(self, members: set) -> frozenset:
        if not self.any_case:
            return frozenset(members)
        return frozenset(members) | {b ^ 32 for b in members if chr(b).isascii() and chr(b).isalpha()}


class _Choices:
    """Thompson's construction: free[s] are moves without input, on[s] moves on a set of bytes."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.free[start].append(middle)
            self.on[middle] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(part, own)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.free[start].append(end)
        return end


class Automaton:
    """Deterministic and minimal. moves[s][b] is the next state (-1: none), ends[s] a bit set of the patterns that end in s; 0 is the start."""

    def __init__(self, patterns: list[tuple[str, bool]], anywhere: bool):
        choices = _Choices()
        start, finals = choices.state(), {}
        for k, (pattern, any_case) in enumerate(patterns):
            own = choices.state()
            choices.free[start].append(own)
            finals[choices.add(_Parser(pattern, any_case).tree(), own)] = 1 << k
        classes = self._byte_classes({s[0] for s in choices.on if s})
        self.moves, self.ends = self._subsets(choices, start, finals, classes, anywhere)
        self._minimise(len(set(classes)), classes)

    @staticmethod
    def _byte_classes(sets: set[frozenset]) -> list[int]:
        """Bytes that no set tells apart share a class."""
        ordered = sorted(sets, key=sorted)
        signature = [tuple(b in s for s in ordered) for b in range(256)]
        number = {x: i for i, x in enumerate(dict.fromkeys(signature))}
        return [number[x] for x in signature]

    @staticmethod
    def _subsets(choices, start, finals, classes, anywhere):
        sample = {c: b for b, c in reversed(list(enumerate(classes)))}

        @lru_cache(maxsize=None)
        def closed(states: frozenset) -> frozenset:
            out, todo = set(states), list(states)
            while todo:
                for t in choices.free[todo.pop()]:
                    if t not in out:
                        out.add(t)
                        todo.append(t)
            return frozenset(s for s in out if choices.on[s] or s in finals)

        first = closed(frozenset({start}))
        number, todo, moves, ends = {first: 0}, [first], [], []
        while todo:
            now = todo.pop(0)
            ends.append(sum(finals[s] for s in now if s in finals))
            row = []
            for c in range(len(sample)):
                to = {choices.on[s][1] for s in now if choices.on[s] and sample[c] in choices.on[s][0]}
                to = closed(frozenset(to)) if to else frozenset()
                if anywhere:
                    to |= first
                if not to:
                    row.append(-1)
                    continue
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            moves.append(row)
        return moves, ends

    def _minimise(self, n_classes: int, classes: list[int]) -> None:
        """Partition refinement: states stay together while their ends and the blocks of all their moves agree."""
        names = {e: i for i, e in enumerate(dict.fromkeys(self.ends))}
        block = [names[e] for e in self.ends]
        while True:
            sign = [(block[s], *(block[t] if t >= 0 else -1 for t in self.moves[s])) for s in range(len(block))]
            names = {x: i for i, x in enumerate(dict.fromkeys(sign))}
            after = [names[x] for x in sign]
            if len(names) == len(set(block)):
                break
            block = after
        one = {b: s for s, b in reversed(list(enumerate(block)))}
        order = {b: i for i, b in enumerate(dict.fromkeys([block[0], *sorted(one)]))}
        rows = [None] * len(order)
        ends = [0] * len(order)
        for b, i in order.items():
            by_class = [order[block[t]] if t >= 0 else -1 for t in self.moves[one[b]]]
            rows[i] = [by_class[classes[x]] for x in range(256)]
            ends[i] = self.ends[one[b]]
        self.moves, self.ends = rows, ends

    def linked(self) -> list:
        """The start row; each row holds 256 rows and, last, the patterns that end there."""
        rows = [[] for _ in self.moves]
        for row, to, ends in zip(rows, self.moves, self.ends):
            row.extend(rows[t] if t >= 0 else None for t in to)
            row.append(ends)
        return rows[0]

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match from `at` on, or -1."""
        s, end = 0, at if self.ends[0] else -1
        for i in range(at, len(data)):
            s = self.moves[s][data[i]]
            if s < 0:
                break
            if self.ends[s]:
                end = i + 1
        return end


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.combined = Automaton([(r.probe or r.head + r.tail, r.any_case) for r in rules], anywhere=True)
        self.start = self.combined.linked()
        self.parts = [(Automaton([(r.head, r.any_case)], False), Automaton([(r.tail, r.any_case)], False)) for r in rules]
        self.firsts = [[head.moves[0][b] >= 0 or (bool(head.ends[0]) and tail.moves[0][b] >= 0) for b in range(256)] for head, tail in self.parts]
        self.own_bytes = [[any(row[b] >= 0 for a in both for row in a.moves) for b in range(256)] for both in self.parts]

    def ends(self, data: bytes) -> tuple[array, array]:
        """Places of last bytes of matches, and the bit sets of the rules that end there: one pass over the bytes."""
        row, places, rules = self.start, array("q"), array("q")
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                places.append(i)
                rules.append(row[256])
        return places, rules

    def spans_of(self, k: int, data: bytes, ends: Iterable[int]) -> list[tuple[int, int]]:
        """The rule's spans, from the runs of its bytes in which it ends."""
        own, out, done = self.own_bytes[k], [], 0
        for e in ends:
            if e < done:
                continue
            lo, done = e, e
            while lo > 0 and own[data[lo - 1]]:
                lo -= 1
            while done < len(data) and own[data[done]]:
                done += 1
            out += self.spans_within(k, data, lo, done)
        return out

    def spans_within(self, k: int, data: bytes, i: int, n: int) -> list[tuple[int, int]]:
        rule, (head, tail), first, out = self.rules[k], self.parts[k], self.firsts[k], []
        while i < n:
            if first[data[i]] and (middle := head.longest(data, i)) >= 0 and (end := tail.longest(data, middle)) > middle:
                if end - (middle if rule.counted == "tail" else i) >= rule.least:
                    out.append((i, end))
                i = end
            else:
                i += 1
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, sorted."""
        data = text.encode("utf-8", "replace")
        (places, rules), out = self.ends(data), []
        for k in range(len(self.rules) if places else 0):
            out += [(i, k, j) for i, j in self.spans_of(k, data, (i for i, r in zip(places, rules) if r >> k & 1))]
        if out and len(data) != len(text):
            out = [(len(data[:i].decode()), k, len(data[:j].decode())) for i, k, j in out]
        return sorted(out)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, n_base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans (kind:start:end) of every row."""
    names = [r.name for r in rules]

    def run(batches):
        scan = scanner(rules)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = scan.spans(text.as_py() or "")
                base = [x for x in found if x[1] < n_base]
                line = lambda spans: ",".join(f"{names[k]}:{i}:{j}" for i, k, j in spans)
                out.append((doc, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(line(base).encode()).hexdigest(), line(found)))
            if out:
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in SPANS.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SPANS)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each secret replaced by [kind]; overlapping spans are replaced as one, by the kind that starts first."""
    names, at = [r.name for r in rules], docs.columns.index(text_col)

    def run(batches):
        scan = scanner(rules)
        for b in batches:
            out = []
            for text in b.column(at):
                text = text.as_py()
                found = scan.spans(text) if text else []
                if found:
                    parts, done = [], 0
                    for i, k, j in found:
                        if i >= done:
                            parts += [text[done:i], f"[{names[k]}]"]
                        done = max(done, j)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 :]], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
