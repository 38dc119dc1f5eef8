"""Main-text extraction from HTML by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score +1 and tags negative; a linear scan finds the contiguous part
with the largest sum, and its blocks are the text. Weights are learned from labelled pages, those that mark their content with
<article> or <main>, which serve as labels only: a tag costs as many words as the log ratio of its rates outside and inside
says, and at least a little; a word of a class, id or role weighs as the log ratio of the words beneath it, inside and outside.

Boxes that are menus, page headers, footers, sidebars, notices, adverts, forms or comments are left out wherever they lie, and the
scan passes over them, however long they are: by their tag, or where their class words weigh -1 or less together. Of class words, some are known beforehand (KNOWN);
compounds go by their last part, or by their first before a word for a container, and has-, with- or no- say nothing of the box itself.

Fitting takes `sample_pages` pages at most, by a hash of the id. Cases: null or empty html and pages without words
give an empty text; unclosed and stray tags are closed by the next block or end tag that needs it; repeated rows are
extracted alike; an empty table gives no rows; extra columns are ignored; long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS = "page_id long, url string, text string, n_chars long"
TOKENS = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+|<(?![a-zA-Z/!?]))", re.S)
#: Tags with quotes that do not match.
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>()|<[^>]*>")
ATTRIBUTES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
RAW = frozenset(["script", "style", "textarea", "noscript", "template", "iframe", "title", "noembed", "noframes", "xmp"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"])
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset(["article", "main"])
#: A header within one of these is its own, not the page's.
SECTIONS = frozenset(["article", "main", "section"])
AWAY = frozenset("nav header footer aside form button select option dialog menu head svg canvas object audio video label input datalist".split())
#: What words of class, id or role weigh beforehand: surely no content, perhaps none, content.
KNOWN = dict.fromkeys(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored cookie cookies consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead "
    "comment comments commentlist respond replies disqus newsletter subscribe subscription signup login popup modal overlay toolbar complementary contentinfo".split(), -3.0,
) | dict.fromkeys("promo promotion notice notices notification alert warning side aside reply share sharing social related recommended widget search skip".split(), -1.5) | dict.fromkeys("article post entry content main body story text blog page".split(), 2.0)
CONTAINERS = frozenset("area bar block box container form inner item items link links list panel row section slot thread unit wrap wrapper zone".split())
MODIFIERS = frozenset("has with without no not is".split())
AWAY_FROM, MOST_WEIGHT, SMOOTHING = -1.0, 3.0, 20.0


def class_words(value: str) -> list[str]:
    """The words of a class, id or role that say what a box is."""
    out = []
    for x in value.lower().split():
        parts = [y for y in re.split("[-_]+", x) if y]
        if not parts or parts[0] in MODIFIERS:
            continue
        if x not in KNOWN and parts[-1] in KNOWN:
            x = parts[-1]
        elif x not in KNOWN and parts[0] in KNOWN and parts[-1] in CONTAINERS:
            x = parts[0]
        out.append(x)
    return out


#: Closing costs of elements that a block's start or end closes.
CLOSED_BY_BLOCK = frozenset(["p", "li", "dt", "dd", "td", "th", "tr", "option", "h1", "h2", "h3", "h4", "h5", "h6"])
DEFAULT_COST, LEAST_COST, MOST_COST = 3.0, 0.05, 60.0


class Page:
    """scores_of: (a tag's name, 0) or ("", words of a piece of text); inside, away: whether the token lies in marked content, and in a box that is left out; under: class words of the boxes round it; blocks: (first token, last token + 1, text, away)."""

    def __init__(self, source: str, weights: dict[str, float] | None = None):
        self.scores_of: list[tuple[str, int]] = []
        self.inside: list[bool] = []
        self.away: list[bool] = []
        self.under: list[tuple[str, ...]] = []
        self.blocks: list[tuple[int, int, str, bool]] = []
        self.weights = weights or {}
        self._read(source)

    def _no_content(self, words: list[str]) -> bool:
        return bool(words) and sum(KNOWN[x] if x in KNOWN else self.weights.get(f".{x}", 0.0) for x in words) <= AWAY_FROM

    def _read(self, source: str) -> None:
        stack: list[tuple[str, bool, bool, tuple[str, ...]]] = []  # name, away, in content, class words
        parts: list[str] = []
        first, at, n = 0, 0, len(source)
        away, content, under = False, False, ()

        def flush():
            nonlocal first
            text = " ".join("".join(parts).split())
            if text:
                self.blocks.append((first, len(self.scores_of), text, away))
            parts.clear()
            first = len(self.scores_of)

        def note(gone: bool):
            self.inside.append(content)
            self.away.append(gone)
            self.under.append(under)

        def top():
            nonlocal away, content, under
            away, content, under = stack[-1][1:] if stack else (False, False, ())

        def close(name: str) -> None:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            top()

        while at < n:
            m = TOKENS.match(source, at) or LOOSE.match(source, at)
            if not m:  # an unfinished tag at the end
                break
            at = m.end()
            text = m[4]
            if text:
                text = entities.unescape(text)
                parts.append(text)
                count = len(text.split())
                if count:
                    self.scores_of.append(("", count))
                    note(away)
                continue
            if m[2] is None:
                continue
            name, end, attributes = m[2].lower(), bool(m[1]), m[3]
            block = name in BLOCKS
            if block:
                flush()
            elif name == "br":
                parts.append(" ")
            self.scores_of.append((name, 0))
            if end:
                gone = away
                if block or name in AWAY:
                    if any(s[0] == name for s in stack):
                        close(name)
                note(gone)
                if block:
                    first = len(self.scores_of)
                continue
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = found.end() if found else n
                note(away)
                continue
            if block and stack and stack[-1][0] in CLOSED_BY_BLOCK and (name not in ("ul", "ol", "p", "div", "blockquote", "table", "dl", "pre") or stack[-1][0] == "p" or stack[-1][0] == name):
                stack.pop()
                top()
            if (block or name in AWAY) and name not in VOID and not attributes.rstrip().endswith("/"):
                named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTES.findall(attributes)} if attributes.strip() else {}
                gone = away or (name in AWAY and not (name == "header" and any(x[0] in SECTIONS for x in stack))) or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
                words = [x for k in ("class", "id", "role") if k in named for x in class_words(named[k])] if name not in ("html", "body", *CONTENT) else []
                away = gone or self._no_content(words)
                content = content or (name in CONTENT and not away)
                under = (*under, *words)
                stack.append((name, away, content, under))
            note(away)
            if block:
                first = len(self.scores_of) - 1
        flush()

    def counts(self) -> tuple[Counter, Counter]:
        """Tags, words ("") and words beneath class words (".name") inside and outside of marked content."""
        out = Counter(), Counter()
        for (name, words), inside, under in zip(self.scores_of, self.inside, self.under):
            own = out[not inside]
            own[name] += words or 1
            if words:
                for x in set(under):
                    own[f".{x}"] += words
        return out


def learn_costs(pages: list[Page]) -> dict[str, float]:
    """What each tag costs, in words, and what each class word (".name") weighs."""
    inside, outside = Counter(), Counter()
    for page in pages:
        if any(page.inside):
            a, b = page.counts()
            inside += a
            outside += b
    tags = {x for x in {*inside, *outside} if x and x[0] != "."}
    n_in, n_out = (c[""] + sum(c[x] for x in tags) for c in (inside, outside))
    if not n_in or not n_out:
        return {}
    rate = lambda c, n, x: (c[x] + 0.5) / (n + 1)
    unit = max(0.1, float(np.log(rate(inside, n_in, "") / rate(outside, n_out, ""))))
    costs = {x: float(np.clip(np.log(rate(outside, n_out, x) / rate(inside, n_in, x)) / unit * 4, LEAST_COST, MOST_COST)) for x in tags}
    share = inside[""] / (inside[""] + outside[""])
    weigh = lambda a, b: float(np.clip(np.log((a + SMOOTHING * share) * (1 - share) / ((b + SMOOTHING * (1 - share)) * share)), -MOST_WEIGHT, MOST_WEIGHT))
    if 0 < share < 1:
        costs |= {x: weigh(inside[x], outside[x]) for x in {*inside, *outside} if x[:1] == "."}
    return costs


def best_region(page: Page, costs: dict[str, float]) -> tuple[int, int]:
    """First and one past the last token of the part with the largest sum. What is left out anyway neither adds nor costs."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, ((name, words), away) in enumerate(zip(page.scores_of, page.away)):
        if away:
            continue
        total += words or -costs.get(name, DEFAULT_COST)
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, at = total, (begin, i + 1)
    return at


def extract(source: str | None, costs: dict[str, float]) -> str:
    page = Page(source or "", costs)
    i, j = best_region(page, costs)
    return "\n\n".join(text for first, last, text, away in page.blocks if not away and min(j, last) > max(i, first))


def fit_costs(pages: DataFrame, sample_pages: int = 400, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    rows = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h"))
    n = rows.count()
    spread = 1 << 30
    most = spread if n <= sample_pages else int(spread * sample_pages / n)
    picked = rows.where(F.pmod(F.xxhash64("i"), F.lit(spread)) < most).where("h is not null").select("h")
    return learn_costs([Page(r["h"]) for r in picked.toLocalIterator()])


def extract_pages(pages: DataFrame, costs: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches):
        for b in batches:
            texts = [extract(x.as_py(), costs) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[x.split()[0] for x in TEXTS.split(", ")])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, TEXTS)
