"""Language identification with interpolated Kneser-Ney character models.

A text is the sequence of its lower-cased words (runs of letters), each between boundary marks, so a word's probability does not
depend on its neighbours and is computed once per worker. For each language an n-gram model with absolute discounts
is trained: the highest order on counts, the lower ones on how many different characters precede. All
languages share one array of n-gram hashes per order, sorted, with their log probabilities and back-off weights
beside it; scoring is vectorised binary search. The language with the least cross-entropy per character wins.
Rejection is calibrated on labelled texts that the models were not trained on: a text is rejected if its
cross-entropy exceeds what such texts have by `far` standard errors, which depend on its length.

Training takes a sample of the labelled rows by a hash of their id, about `sample_docs` in all, evenly over
the languages; texts are used whole. Cases: null text or text without a letter is `und` with score 0; a row without
id or language is not learned from; repeated rows get equal results; an empty table gives no rows; if
nothing can be learned from, every text is `und`; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import mix64

ORDER = 4
UNDETERMINED = "und"
PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
#: Words that a worker keeps with their scores.
CACHED_WORDS = 400_000
#: Characters after which more text does not raise the score.
SCORE_CHARS = 40
_BEGIN, _END = 1, 2  # code points that no word holds: they separate words


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased: digits and marks say nothing of the language."""
    return _LETTERS.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of begin + word + end for all words, and where each word begins."""
    line = chr(_BEGIN) + f"{chr(_END)}{chr(_BEGIN)}".join(words) + chr(_END)
    codes = np.frombuffer(line.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)])


def _keys(codes: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """At each place, the hash of the `order` characters that end there; begin marks fill up what lies before a word."""
    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    key = np.zeros(len(codes), dtype=np.uint64)
    for j in range(order):
        c = np.full(len(codes), _BEGIN, dtype=np.uint64)
        own = place >= j
        c[own] = codes[np.flatnonzero(own) - j]
        key = mix64(key ^ (c + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)))
    return key


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]  # per order, sorted hashes
    logs: list[np.ndarray]  # per order, [n-gram, language]: log probability, nan where unseen
    backs: list[np.ndarray]  # per order, [n-gram as context, language]: log back-off weight, 0 where unseen
    unseen: float  # log probability of an unknown character
    typical: np.ndarray | None = None  # per language: mean, variance between texts, variance per character

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: summed log probabilities, and last the number of characters."""
        codes, starts = _codes(words)
        n_lang = len(self.languages)
        score = np.full((len(codes), n_lang), self.unseen)
        context = None
        for k in range(1, ORDER + 1):
            keys = _keys(codes, starts, k)
            at = np.minimum(np.searchsorted(self.keys[k - 1], keys), len(self.keys[k - 1]) - 1)
            seen = self.keys[k - 1][at] == keys
            if k > 1:
                score += context
            rows = np.flatnonzero(seen)
            logs = self.logs[k - 1][at[rows]]
            score[rows] = np.where(np.isnan(logs), score[rows], logs)
            context = np.zeros((len(codes), n_lang))
            if k < ORDER:  # the k-gram that ends one place before is the context of the next order
                after = rows[rows + 1 < len(codes)] + 1
                context[after] = self.backs[k - 1][at[after - 1]]
        score[codes == _BEGIN] = 0
        out = np.add.reduceat(score, starts[:-1], axis=0)
        return np.column_stack([out, np.diff(starts) - 1])


def train(texts: list[tuple[str, str]]) -> Models:
    """texts: (language, text)."""
    languages = sorted({x for x, _ in texts})
    grams = [[] for _ in range(ORDER)]  # per order: (key, key without its last, key without its first character, language, count)
    for number, language in enumerate(languages):
        counts = Counter(w for x, t in texts if x == language for w in words_of(t))
        if not counts:
            continue
        codes, starts = _codes(list(counts))
        weight = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), np.diff(starts))
        real = codes != _BEGIN
        keys = [_keys(codes, starts, k) for k in range(1, ORDER + 1)]
        before = [np.concatenate([np.zeros(1, np.uint64), k[:-1]]) for k in keys]  # the k-gram that ends one place before
        for k in range(ORDER, 0, -1):
            key = keys[k - 1][real]
            context = before[k - 2][real] if k > 1 else np.zeros(len(key), np.uint64)
            suffix = keys[k - 2][real] if k > 1 else context
            if k == ORDER:
                unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                count = np.bincount(inverse, weights=weight[real])
            else:  # different longer n-grams that end in this one
                longer, at = np.unique(keys[k][real], return_index=True)
                unique, first, inverse = np.unique(key[at], return_index=True, return_inverse=True)
                count = np.bincount(inverse)
                context, suffix = context[at], suffix[at]
            grams[k - 1].append((unique, context[first], suffix[first], number, count))
    n_lang, unseen = len(languages), float(np.log(1e-6))
    out = Models(languages, [], [], [], unseen)
    for k in range(1, ORDER + 1):
        # with the contexts of the next order: those that end in a begin mark are predicted by no n-gram but have a weight
        every = np.unique(np.concatenate([g[0] for g in grams[k - 1]] + ([g[1] for g in grams[k]] if k < ORDER else [])))
        logs, backs = np.full((len(every), n_lang), np.nan), np.zeros((len(every), n_lang))
        for key, context, suffix, number, count in grams[k - 1]:
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 + n2 else 0.5
            names, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, weights=count), np.bincount(inverse)
            weight = discount * kinds / total
            if k == 1:
                lower = np.full(len(key), 1e-6)
            else:
                lower = np.exp(out.logs[k - 2][np.searchsorted(out.keys[k - 2], suffix), number])
                at = np.searchsorted(out.keys[k - 2], names)
                at = np.minimum(at, len(out.keys[k - 2]) - 1)
                ok = out.keys[k - 2][at] == names
                out.backs[k - 2][at[ok], number] = np.log(weight[ok])
            p = np.maximum(count - discount, 0) / total[inverse] + weight[inverse] * lower
            logs[np.searchsorted(every, key), number] = np.log(p)
        out.keys.append(every)
        out.logs.append(logs)
        out.backs.append(backs)
    return out


def language_sample(docs: DataFrame, sample_docs: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """About sample_docs labelled texts, evenly over the languages, by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), held_out(id_col).alias("h")).where("not h and i is not null and l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(sample_docs).collect()}
    if not sizes:
        return []
    each = max(1, sample_docs // len(sizes))
    picked, spread = F.lit(False), 1 << 30
    for language, n in sizes.items():
        most = spread if n <= each else int(spread * each / n)
        picked = picked | ((F.col("l") == language) & (F.pmod(F.xxhash64("i"), F.lit(spread)) < most))
    return sorted((r["l"], r["t"]) for r in rows.where(picked).select("l", "t").toLocalIterator())


def fit(docs: DataFrame, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models | None:
    texts = [x for x in language_sample(docs, sample_docs, id_col, text_col, lang_col) if words_of(x[1])]
    if not texts:
        return None
    trained = [x for i, x in enumerate(texts) if i % 5] or texts
    models = train(trained)
    models.typical = calibrate(models, [x for i, x in enumerate(texts) if i % 5 == 0] or texts)
    return models


def calibrate(models: Models, texts: list[tuple[str, str]]) -> np.ndarray:
    """Per language: mean cross-entropy of texts in it, variance between texts, variance per character."""
    out = np.zeros((len(models.languages), 3))
    scorer = Scorer(models)
    for k, language in enumerate(models.languages):
        found = [scorer(t) for x, t in texts if x == language]
        ce, n = np.array([e[k] for e, _ in found]), np.array([m for _, m in found], dtype=float)
        if not len(ce):
            out[k] = (0, np.inf, 0)
            continue
        mean = float(np.average(ce, weights=n))
        long = n >= np.median(n)
        out[k] = (mean, float(np.mean((ce[long] - mean) ** 2)) + 1e-3, float(np.mean((ce - mean) ** 2 * n)) + 1.0)
    return out


class Scorer:
    def __init__(self, models: Models):
        self.models, self.row = models, {}
        self.table = np.zeros((1 << 12, len(models.languages) + 1))

    def learn(self, words) -> None:
        """Scores words that are not kept yet."""
        if len(self.row) > CACHED_WORDS:
            self.row.clear()
        new = [w for w in words if w not in self.row]
        for i in range(0, len(new), 20_000):
            own = new[i : i + 20_000]
            at = len(self.row)
            while len(self.table) < at + len(own):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(own)] = self.models.word_scores(own)
            self.row.update(zip(own, range(at, at + len(own))))

    def __call__(self, text: str, learned: bool = False) -> tuple[np.ndarray, int]:
        """Cross-entropy per character in each language, and the number of characters."""
        words = words_of(text)
        if not learned:
            self.learn(dict.fromkeys(words))
        total = self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return -total[:-1] / max(total[-1], 1), int(total[-1])

    def judge(self, text: str | None, far: float, learned: bool = False) -> tuple[str, float, float | None, bool]:
        if not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, None, True
        ce, n = self(text, learned)
        if not n:  # letters that no run holds, as lower-casing can leave
            return self.models.languages[0], 0.0, None, True
        k = int(np.argmin(ce))
        score = 1 / np.exp(np.minimum((ce[k] - ce) * min(n, SCORE_CHARS), 0)).sum()
        mean, between, each = self.models.typical[k]
        return self.models.languages[k], float(score), float(ce[k]), bool(ce[k] > mean + far * np.sqrt(between + each / n))


def identify(docs: DataFrame, models: Models | None, far: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every row."""
    judge = judge_batches(models, far)

    def run(batches):
        for b in batches:
            rows = judge(b.column(2))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names=[x.split()[0] for x in PREDICTIONS.split(", ")])

    return docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string")).mapInArrow(run, PREDICTIONS)


def judge_batches(models: Models | None, far: float):
    """A function of an Arrow array of texts; the models travel with the task, at most a few MB as the sample is bounded."""
    held: list[Scorer] = []

    def judge(column) -> list[tuple]:
        if models is None:
            return [(UNDETERMINED, 0.0, None, True)] * len(column)
        if not held:
            held.append(Scorer(models))
        out = []
        for i in range(0, len(column), 500):
            texts = column.slice(i, 500).to_pylist()
            held[0].learn({w: None for t in texts if t for w in words_of(t)})
            out += [held[0].judge(t, far, learned=True) for t in texts]
        return out

    return judge


def keep_identified(docs: DataFrame, models: Models | None, far: float = 8.0, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with the same columns."""
    judge, at = judge_batches(models, far), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not r[3] for r in judge(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
