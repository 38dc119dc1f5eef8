"""Substring dedup, SimHash, secrets, decontamination and packing against brute force, with the odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lacuna.llm import automaton, decontam, packing, queries, simhash, substrings

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def odd(make_docs, words):
    shared = words(60, 1)
    rows = [
        (5, words(80, 2) + " " + shared + " " + words(30, 3)), (1, words(40, 4) + "\n" + shared), (2, None), (3, ""), (4, "  \t "), (6, "one two"), (7, shared + " " + shared),
        (8, words(3000, 5)), (9, words(3000, 5)), (9, words(3000, 5)), (None, shared + " é ñ  x"), (10, "É " * 50), (11, words(25, 6).upper()), (12, words(25, 6)), (13, "a"), (14, "token = \"AbCdEfGh12\" AKIAABCDEFGHIJKL" + " 0123456789abcdef" * 3 + "0" * 32),
    ]
    return rows, make_docs(rows)


def _words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_substrings_match_brute_force(odd):
    rows, docs = odd
    first = {}
    big = 2**63 - 1
    key = lambda r: (r[0] if r[0] is not None else big, zlib.crc32((r[1] or "").encode()))
    for r in rows:
        w = _words(r[1])
        for i in range(len(w) - 19):
            s = tuple(w[i : i + 20])
            first[s] = min(first.get(s, (key(r), i)), (key(r), i))
    want = Counter()
    for r in rows:
        w, gone = _words(r[1]), set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (key(r), i):
                gone |= set(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    got = Counter(tuple(r) for r in substrings.drop_repeats(docs).collect())
    assert got == want


def test_substrings_in_many_buckets_and_chunks(odd, monkeypatch, spark):
    rows, docs = odd
    whole = Counter(tuple(r) for r in substrings.drop_repeats(docs).collect())
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 500)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(substrings, "MOST_PARTITIONS", 1)
    assert Counter(tuple(r) for r in substrings.drop_repeats(docs).collect()) == whole


@pytest.mark.parametrize("level_from", [4, 1])
def test_full_buckets_are_dealt_again(odd, make_docs, words, monkeypatch, level_from):
    """A run of words in every window's reach, and one bucket for all: what passes the limit goes to the next levels, copies do not."""
    import random

    rows = [(i, " ".join(random.Random(i).choice("abcdefgh") * 3 + str(random.Random(i * 7 + k).randint(0, 40)) if k % 9 else "the same four words" for k in range(120))) for i in range(40)]
    docs = make_docs(odd[0] + rows + [(100 + i, words(60, 1)) for i in range(50)] + [(200 + i, t) for i, t in rows[:5]])
    whole = Counter(tuple(r) for r in substrings.drop_repeats(docs).collect())
    levels, split = [], substrings.partitions_for
    monkeypatch.setattr(substrings, "MOST_BYTES", 20_000)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 5_000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1 << 40)
    monkeypatch.setattr(substrings, "WHOLE_FROM", level_from)
    monkeypatch.setattr(substrings, "partitions_for", lambda *a: levels.append(a[1]) or (1 if len(levels) == 1 else split(*a)))
    assert Counter(tuple(r) for r in substrings.drop_repeats(docs).collect()) == whole
    assert len(levels) >= 2


def test_a_bucket_holds_no_copies(words):
    """Chunks of one passage, one after the other: the bucket keeps one of each window, gives one row of intervals a chunk, and is never full."""
    sent = [p for i in range(300) for b, kind, p in substrings._settled([(i, 0, 0, words(400, 3))], 20, 4, 1) if kind == 0]
    own = substrings._Bucket(0, 0, 20, 4, 20_000)
    out = [r for p in sent for r in own.add(p)]
    assert own.size < 20_000 and not own.full
    out += own.settle(last=True)
    gone = sorted((d, s, n) for b in out for d, s, n in zip(*(b.column(i).to_pylist() for i in (0, 3, 4))))
    assert gone == [(i, 0, 381) for i in range(1, 300)]


def test_word_hashes_of_long_and_short_words(monkeypatch):
    monkeypatch.setattr(substrings, "HASHED_BYTES", 64)
    substrings._powers.cache_clear()
    raw = b"ab " * 50 + b"x" * 200 + b" ab " + b"y" * 64 + b" " + b"x" * 200 + b" ab"
    w = substrings.Words(raw, 2, bounds=np.array([0]))
    own = [raw[i:j] for i, j in zip(w.begin, w.end)]
    substrings._powers.cache_clear()
    assert own == raw.split()
    assert len(set(zip(own, w.hashed.tolist()))) == len(set(own)) == len(set(w.hashed.tolist()))


def test_substrings_survive_hash_collisions():
    w = substrings.Words(b" a b\tc\n\na b d ", 2, sizes=np.array([6]))
    w.rolled = lambda k: np.zeros(6, np.uint64)
    assert substrings.repeated(w, (w.start, w.owner * 0, w.owner), 2).tolist() == [False, False, False, True, False]


def _fingerprint(text):
    w = _words((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, fps, radius=4):
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[top(i)].append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[top(i)] for i in range(len(ids))]


def test_simhash_matches_brute_force(odd):
    rows, docs = odd
    fps = [_fingerprint(r[1]) for r in rows]
    comps = _components([r[0] for r in rows], fps)
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comps))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want


def test_links_connect_exactly_what_is_near():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in base], dtype=np.uint64) for k in (1, 2, 3, 4, 5, 6))]))
    a, b = simhash.linked(fps, np.zeros(len(fps), int), 0, 4)
    got = {(int(x), int(y)) for x, y in zip(a, b)}
    top = list(range(len(fps)))
    for x, y in got:
        assert (int(fps[x]) ^ int(fps[y])).bit_count() <= 4
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}

    def find(t, i):
        while t[i] != i:
            i = t[i]
        return i

    other = list(top)
    for t, links in ((top, got), (other, near)):
        for x, y in links:
            t[max(find(t, x), find(t, y))] = min(find(t, x), find(t, y))
    assert [find(top, i) for i in range(len(fps))] == [find(other, i) for i in range(len(fps))]


def test_links_in_rounds_and_with_collisions(monkeypatch):
    fps = np.array([0, 3, 15, 1 << 40, (1 << 40) | 7], dtype=np.uint64)
    want = {(i, j) for i in range(5) for j in range(i + 1, 5) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert (2, 3) not in want and len(want) == 9
    monkeypatch.setattr(simhash, "MOST_VARIANTS", 500)
    a, b = simhash.linked(fps, np.zeros(5, int), 0, 4)
    assert set(zip(a.tolist(), b.tolist())) <= want and {(3, 4)} <= set(zip(a.tolist(), b.tolist()))
    monkeypatch.setattr(simhash, "MOST_VARIANTS", 10**6)
    monkeypatch.setattr(simhash, "mix64", lambda x: x & np.uint64(0))
    a, b = simhash.linked(fps, np.zeros(5, int), 0, 4)
    assert set(zip(a.tolist(), b.tolist())) == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1100)] + [(-5, 1050)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == -5 for i in range(1000, 1100)) and 0 not in got


_BASE = [
    ("assign", re.compile("(?:%s)" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
_SECRETS = [
    None, "", "password:secret: abcdefgh1", "API_KEY='abcdefgh'", "apikey = = abcdefgh", "token==abcdefgh", "tokentoken=abcdefghi", "secret=short token=longenough1", "é" * 40 + "passwd=\"abcdefgh.=\" é AKIAAKIA0123456789 akia", "f" * 31, "f" * 32, "xf" + "0" * 64 + "g" + "a" * 33,
    "ghp_" + "a1" * 18, "token : 'ghp_" + "B2" * 18 + "'", "-----BEGIN RSA PRIVATE KEY-----", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "toKen=abcdefgh", "ſecret=abcdefgh", ("x" * 5000 + " token=abcdefgh1 ") * 30,
]


def _base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(_BASE) for m in p.finditer(text or "") if ok(m))


def test_secrets_match_brute_force(make_docs):
    got = {r["doc_id"]: r for r in automaton.find_secrets(make_docs(list(enumerate(_SECRETS)))).collect()}
    for i, text in enumerate(_SECRETS):
        spans = _base_spans(text)
        line = [f"{_BASE[k][0]}:{a}:{b}" for a, k, b in spans]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest(), text
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == x for _, x, _ in spans) for k in range(3))
        assert set(line) <= set(got[i]["spans"].split(",") if got[i]["spans"] else [])
    assert got[12]["spans"] == "github:0:40,hex:4:40" and "pem:0:" in got[14]["spans"]


def test_automaton_agrees_with_re():
    import random

    rng = random.Random(5)
    patterns = ["a(b|cd)*e?", "[a-c]{2,4}d", "(ab|a)(c|bcd)", "x+y{3}|z"]
    combined = automaton.Automaton([(p, False) for p in patterns], anywhere=True)
    for _ in range(500):
        s = "".join(rng.choice("abcdexyz") for _ in range(12)).encode()
        row, seen = combined.linked(), 0
        for b in s:
            row = row[b]
            seen |= row[256]
        for k, p in enumerate(patterns):
            # a{0} matches nowhere in these, so search tells whether any match ends somewhere
            assert bool(seen >> k & 1) == bool(re.search(p.encode(), s)), (p, s)
        for p in patterns:
            own = automaton.Automaton([(p, False)], False)
            longest = max((m.end() for n in range(len(s) + 1) if (m := re.compile(p.encode()).fullmatch(s, 0, n))), default=-1)
            assert own.longest(s, 0) == longest


def test_redaction(make_docs):
    out = {r["doc_id"]: r["text"] for r in automaton.redact_secrets(make_docs([(1, "a token=abcdefgh1 b"), (2, None), (3, "clean")])).collect()}
    assert out == {1: "a [assign] b", 2: None, 3: "clean"}


def _item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def _contaminated(rows, items):
    wins = defaultdict(set)
    for item, text in items:
        w = _item_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in rows:
        w, hit, found = _item_words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if t := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= t
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_decontamination_matches_brute_force(spark, odd, words, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    rows, docs = odd
    items = [(3, words(60, 1)[:200]), (11, words(25, 6)), (2, "É é"), (7, None), (8, "..."), (9, words(60, 1)[:200]), (None, words(12, 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontam.decontaminate(docs, bench).collect())
    assert got == _contaminated(rows, items)
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()} == {r[0] for r in _contaminated(rows, items) if not r[5]}


def test_decontamination_of_repetitive_texts(spark, make_docs):
    import random

    rng = random.Random(3)
    known = [f"w{i}" for i in range(300)]
    plain = [rng.choice(known) for _ in range(60)]
    rows = [(1, "ab " * 200), (2, "ab cd " * 50), (3, " ".join(plain)), (4, " ".join(plain[:30] + ["x"] * 97 + plain[30:])), (5, "a b c d e f g " * 20)]
    rows += [(10 + n, "y " + "ab " * n + "z") for n in range(9, 40)]
    items = [(1, "ab " * 12), (2, "ab cd " * 6), (3, " ".join(plain[5:50])), (4, "x " * 40), (5, "c d e f g a b c d e f g"), (6, "z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontam.decontaminate(make_docs(rows), bench).collect()) == _contaminated(rows, items)


def test_decontamination_of_and_against_nothing(spark, odd, make_docs):
    rows, docs = odd
    none = spark.createDataFrame([], "item_id long, text string")
    assert Counter(tuple(r) for r in decontam.decontaminate(docs, none).collect()) == _contaminated(rows, [])
    assert decontam.decontaminate(make_docs([]), none).collect() == []


def test_packing(make_docs, words):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "a  b", "x \n y", " lead", "trail ", "tab\t\tq", "é ü   z", "<|endoftext|> it's 1,234", "<|endoftext|>", "a <|endoftext|> b", "end <|endoftext|>", "<|endoftext|><|endoftext|> x<|endoftext|", "naïve, Straße. ŒUVRE; ªº µ ɐɐ, x" * 2, "w" * 5000, words(3000, 1), words(10, 2), words(10, 2), "\n\n", "日本語 テキスト", "don't I'LL we've  '''"] + [words(i * 17 % 400, i) for i in range(60)]
    got = packing.pack_documents(make_docs(list(enumerate(texts))), queries.tokenizer_path()).collect()
    t = Tokenizer.from_file(queries.tokenizer_path())
    by = defaultdict(dict)
    for r in got:
        by[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    for i, text in enumerate(texts):
        ids, at, want = t.encode(text or "", add_special_tokens=False).ids + [2], 0, {}
        while at < len(ids):
            n = (len(ids) % 1024 or 1024) if not want else 1024
            want[len(want)] = (at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes()))
            at += n
        assert by[i] == want, text
    _valid([(r["sequence_id"], r["offset"], r["length"]) for r in got])


def _valid(placed, capacity=1024):
    seqs = defaultdict(list)
    for s, o, n in placed:
        seqs[s].append((o, n))
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def _optimum(items, capacity):
    """By trying every placement of the largest pieces first."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for r in {*bins}:
            if r + items[i] <= capacity:
                k = bins.index(r)
                go(i + 1, [*bins[:k], r + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    import random

    rng = random.Random(11)
    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_by_dominance(dict(Counter(items)), 20)
        n_fixed = sum(n for _, n in fixed)
        left = [k for k, v in rest.items() for _ in range(v)]
        assert Counter(x for g, n in fixed for x in g * n) + Counter(left) == Counter(items)
        assert all(sum(g) <= 20 for g, _ in fixed)
        assert n_fixed + (_optimum(left, 20) if left else 0) == _optimum(items, 20), items
        packed = packing.pack(dict(Counter(items)), 20)
        assert Counter(x for g, n in packed for x in g * n) == Counter(items) and all(sum(g) <= 20 for g, _ in packed)


@pytest.mark.parametrize("op", ["substrings", "simhash", "secrets", "packing"])
def test_empty_tables(make_docs, op):
    docs = make_docs([])
    run = {"substrings": substrings.drop_repeats, "simhash": simhash.near_duplicates, "secrets": automaton.find_secrets, "packing": lambda d: packing.pack_documents(d, queries.tokenizer_path())}[op]
    assert run(docs).collect() == []


def test_pipeline_keeps_one_row_of_each_group(spark, make_docs):
    """Different texts without an id, or under one id, are groups of their own; near copies are not, whatever their id."""
    import corpus_pipeline

    texts = [" ".join(f"{x}{i}" for i in range(200)) for x in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[3]), (8, texts[4]), (None, texts[3]), (9, texts[2]), (5, texts[5]), (6, texts[5] + " "), (5, texts[0])]
    docs = make_docs(rows)
    got = corpus_pipeline.deduplicated(spark, docs, "")
    assert got.columns == docs.columns
    want = Counter([(5, texts[0]), (None, texts[1]), (9, texts[2]), (7, texts[3]), (7, texts[4]), (5, texts[5])])
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def _crc_twins(heads):
    """One text from each head whose CRC-32 agree."""
    text = lambda k, i: f"{heads[k]} {hashlib.md5(f'{k} {i}'.encode()).hexdigest()}"
    seen = {zlib.crc32(text(0, i).encode()): i for i in range(200_000)}
    j = next(j for j in range(2_000_000) if zlib.crc32(text(1, j).encode()) in seen)
    return text(0, seen[zlib.crc32(text(1, j).encode())]), text(1, j)


@pytest.mark.parametrize("doc", [None, 3])
def test_texts_with_one_crc_are_two_documents(make_docs, spark, doc):
    passage = " ".join(f"w{i}" for i in range(25))
    hit, clean = _crc_twins((passage, "four words of text"))
    assert zlib.crc32(hit.encode()) == zlib.crc32(clean.encode())
    docs, bench = make_docs([(doc, hit), (doc, clean), (1, passage + " one")]), spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontam.decontaminate(docs, bench).collect())
    assert got == Counter([(doc, 26, 25), (doc, 5, 0), (1, 26, 25)])
    assert [r["text"] for r in decontam.drop_contaminated(docs, bench).collect()] == [clean]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(docs).collect())
    assert got == Counter([(doc, 26, 25), (doc, 5, 0), (1, 26, 0)])


def test_dominance_looks_beside_a_single_piece():
    """Beside 100 of 200, (60, 36) does not match (50, 45): 50 is there once, so its best partner is 45."""
    assert packing.reduce_by_dominance({100: 1, 60: 1, 50: 1, 45: 1, 36: 1}, 200)[0][:1] != [((100, 60, 36), 1)]


def test_a_worker_holds_one_tokenizer():
    """Two loads of the same vocabulary are one object, without cycles: dropped, it goes at once; its caches stay bounded and exact."""
    import gc
    import weakref

    path = queries.tokenizer_path()
    assert packing.token_bytes(path) is packing.token_bytes(path)
    gc.disable()
    try:
        own = packing.TokenBytes(path)
        gone = weakref.ref(own.words.make)
        own("some words, and one more.")
        del own
        assert gone() is None
    finally:
        gc.enable()


def test_the_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    own, fresh = packing.TokenBytes(queries.tokenizer_path()), packing.TokenBytes(queries.tokenizer_path())
    text = " ".join(f"ab{chr(97 + i % 26)}{chr(97 + i % 7)}, cd{i % 11}" for i in range(300)) + " " + "z" * 900
    assert own(text) == own(text) == np.array(fresh.tokenizer.encode(text).ids, dtype="<u4").tobytes()
    assert max(len(c) + len(c.older) for c in (own.words, own.first, own.parts)) <= 10


def test_a_word_is_kept_and_spelled_once():
    """Not as a word and as a part besides, and not again before a mark or a line end; the ids stay the tokenizer's."""
    own = packing.TokenBytes(queries.tokenizer_path())
    for text in ("some words, more words.\nOther Words, words;\nmore", "a\n" * 3000 + "b", " x\n y\n\nz .\n'", "m\x1c\nn caf\u00e9.\nCaf\u00e9, \u4e00.\n\u4e00"):
        assert own(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
    assert not {" words", " more", " Words", "Other"} & own.parts.keys() and {"words", "more"} <= own.words.keys()


def test_dominance_keeps_the_optimum_of_single_pieces():
    import random

    rng = random.Random(5)
    for _ in range(4000):
        capacity = rng.choice([30, 60, 100, 1024])
        items = [rng.randint(capacity // 8, capacity * 2 // 3) for _ in range(rng.randint(3, 9))]
        fixed, rest = packing.reduce_by_dominance(dict(Counter(items)), capacity)
        left = [k for k, v in rest.items() for _ in range(v)]
        if fixed:
            assert sum(n for _, n in fixed) + (_optimum(left, capacity) if left else 0) == _optimum(items, capacity), (capacity, items)


def test_dominance_of_a_lost_optimum():
    items = [63, 62, 61, 47, 37, 31, 26, 23, 19, 19]
    fixed, rest = packing.reduce_by_dominance(dict(Counter(items)), 100)
    left = [k for k, v in rest.items() for _ in range(v)]
    assert sum(n for _, n in fixed) + _optimum(left, 100) == 4


def test_spans_round_the_ends_are_those_of_the_whole_text():
    import random

    scan, rng = automaton.scanner(automaton.BASE + automaton.ADDED), random.Random(6)
    parts = ["token", "=", ": ", '"', "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", " ", "\n", "é", ",", "ghp_", "x" * 40, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "passwd", "sk_live_", "deadbeef" * 4, "'", "api_key"]
    for _ in range(3000):
        data = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14))).encode()
        want = sorted((i, k, j) for k in range(len(scan.rules)) for i, j in scan.spans_within(k, data, 0, len(data)))
        got = sorted((i, k, j) for k in range(len(scan.rules)) for i, j in scan.spans_of(k, data, [i for i, r in zip(*scan.ends(data)) if r >> k & 1]))
        assert got == want, data


def test_secrets_of_repeated_rows_and_long_texts(make_docs):
    long = "plain words " * 400_000 + "token = abcdefgh12 " + "a" * 500_000
    got = Counter(tuple(r) for r in automaton.find_secrets(make_docs([(1, long), (1, long), (2, "token=abcdefgh1")])).select("doc_id", "n_assign", "n_hex", "spans").collect())
    at = len("plain words ") * 400_000
    assert got == Counter({(1, 1, 1, f"assign:{at}:{at + 18},hex:{at + 19}:{at + 500_019}"): 2, (2, 1, 0, "assign:0:15"): 1})
