"""URL filters, top-k, language ID, HTML extraction, WARC and the pipeline, with the odd cases."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import automaton, html, langid, packing, queries, topk, urls, warc

URLS = [
    None, "", "nothing", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/17?x=1#y", "ftp://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/", "http://com/de/a", "http://example.org", "http://u@example.org:80/es/", "x://é.org/ü#", "://org/",
    "http://org.com/fr/?q=http://example.org/es/", "http://example.org/" + "a" * 3000,
]


def _judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:n].translate({c: c + 32 for c in range(65, 91)}), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = []
    for verdict, rule in queries.URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, rule int")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(pages, queries.URL_RULES).collect()}
    assert got == {i: _judge(u) for i, u in enumerate(URLS)}


def test_url_index_confirms_strings_behind_equal_digests(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda _: 7)
    urls.write_index([("block", "a.org/"), ("allow", "b.org/x")], str(tmp_path / "i"))
    index = urls.Index(str(tmp_path / "i"))
    assert index.best([("b.org", "/xy"), ("a.org", "/"), ("c.org", "/")]) == [("b.org/x", True), ("a.org/", False), None]


def _top(rows, k=5):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        best = sorted(((sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != q and len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:k]
        out.update((q, n + 1, j, s) for n, (s, j) in enumerate(best))
    return out


@pytest.mark.parametrize("seeds", [1, 64])
def test_top_k_matches_brute_force(spark, monkeypatch, seeds):
    monkeypatch.setattr(topk, "BUCKET", 32)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    rows += [(i, rows[i % 3][1]) for i in range(400, 420)] + [(500, [0.0] * 8), (501, None), (502, [1.0, None] * 4), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (550, [1.0, 2.0]), (551, [2.0, 3.0]), (None, [1.0] * 8), (600, []), (50, rows[50][1]), (77, rows[77][1])]
    rows = [(i, v if v is None or None in v else [float(np.float32(x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, block int, length double")
    got = Counter(tuple(r) for r in topk.top_k(table, F.col("id") % 50 == 0, seeds=seeds).collect())
    assert got == _top(rows)


@pytest.mark.parametrize("n_blocks", [7, 40])
def test_top_k_of_a_common_length(spark, monkeypatch, n_blocks):
    """Half of the rows are one vector; blocks stay near their size, and no more of them meet than can hold an answer."""
    monkeypatch.setattr(topk, "BLOCK", 400 // n_blocks)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 0.5]) for i in range(200)] + [(i, (rng.normal(size=4) * 3 ** float(rng.integers(-3, 4))).tolist()) for i in range(200, 400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in topk.top_k(table, F.col("id") % 50 == 0, seeds=16).collect()) == _top(rows)
    own = topk.vectors(table, "vec_id", "embedding")
    sizes = [r["count"] for r in topk.dealt(own, "length", n_blocks, 400 // n_blocks, "b").groupBy("b").count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 3 * (400 // n_blocks) + 10


def test_top_k_of_large_numbers():
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**20, 2.0], [1.0, 1.0]])
    best = topk.search(q, np.array([0]), v, np.array([1, 2, 3]), 2)
    assert best.vec.tolist() == [1, 2] and best.score.tolist() == [2**60 + 3, 2**60 + 2]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect() == []


LANGS = {"xa": "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor", "xb": "der schnelle braune fuchs springt über den faulen hund und läuft weg", "xc": "the quick brown fox jumps over the lazy dog and runs away from it"}


def _lang_rows():
    rng, rows = np.random.default_rng(4), []
    for i in range(240):
        lang = list(LANGS)[i % 3]
        own = LANGS[lang].split()
        rows.append((i, " ".join(rng.choice(own, rng.integers(8, 60))).capitalize() + ".", lang))
    return rows


def test_language_id(spark, make_docs):
    rows = _lang_rows()
    docs = make_docs(rows + [(1000, None, "xa"), (1001, "", None), (1002, "123 !?", "xa"), (1003, "Fuchs", None), (None, "the dog runs", "xc"), (1004, "Слово не воробей вылетит не поймаешь " * 20, None), (1005, rows[0][1] * 400, None)])
    models = langid.fit(docs, 150)
    got = {r["doc_id"]: r for r in langid.identify(docs, models).collect()}
    for i, _, lang in rows:
        held = zlib.crc32(str(i).encode()) % 5 == 0
        assert got[i]["held_out"] == held
        if held:
            assert got[i]["lang_pred"] == lang
        assert not got[i]["rejected"] and 0 <= got[i]["score"] <= 1
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[1003]["lang_pred"] == "xb" and got[None]["lang_pred"] == "xc" and not got[None]["held_out"]
    assert got[1004]["lang_pred"] in LANGS and got[1004]["rejected"]
    assert got[1005]["lang_pred"] == rows[0][2]
    kept = langid.keep_identified(docs, models)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["rejected"]}


def test_character_models_are_distributions():
    models = langid.train([("a", "abab abba ba aab"), ("b", "cdc ddc cd")])
    words = [x + y for x in "abcd" for y in "abcd"]
    # all words of one character and the end sum to at most one, with a little left for unknown characters
    one = np.exp(models.word_scores(list("abcd"))[:, 0]).sum()
    assert 0 < one < 1 and np.isfinite(models.word_scores(words)).all()
    assert models.word_scores(["ab"])[0, 0] > models.word_scores(["ab"])[0, 1]


def _kneser_ney(texts):
    """(word) -> log probability, from dictionaries, straight from the definition."""
    counts = Counter(w for t in texts for w in langid.words_of(t))
    marked = lambda w: "^" * langid.ORDER + w + "$"
    grams = {langid.ORDER: Counter()}
    for w, c in counts.items():
        line = marked(w)
        for i in range(langid.ORDER, len(line)):
            grams[langid.ORDER][line[i - langid.ORDER + 1 : i + 1]] += c
    for k in range(langid.ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in {marked(w)[i - k : i + 1] for w in counts for i in range(langid.ORDER, len(marked(w)))})
    discount, total, kinds = {}, {}, {}
    for k, g in grams.items():
        n1, n2 = (sum(v == x for v in g.values()) for x in (1, 2))
        discount[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        for x, v in g.items():
            total[k, x[:-1]] = total.get((k, x[:-1]), 0) + v
            kinds[k, x[:-1]] = kinds.get((k, x[:-1]), 0) + 1

    def p(k, g):
        if k == 0:
            return 1e-6
        if (k, g[:-1]) not in total:
            return p(k - 1, g[1:])
        weight = discount[k] * kinds[k, g[:-1]] / total[k, g[:-1]]
        if k == 1 and g not in grams[1]:
            return 1e-6
        return max(grams[k].get(g, 0) - discount[k], 0) / total[k, g[:-1]] * (g in grams[k]) + weight * p(k - 1, g[1:])

    def word(w):
        line = marked(w)
        return sum(np.log(p(langid.ORDER, line[i - langid.ORDER + 1 : i + 1])) for i in range(langid.ORDER, len(line)))

    return word, lambda before, c: p(langid.ORDER, (before + c)[-langid.ORDER :])


def test_character_models_match_kneser_ney_by_definition():
    texts = [("a", "abab abba ba aab bab abc abcab"), ("a", "b ab ab c"), ("b", "cdc ddc cd dcd cddc ccd"), ("b", LANGS["xc"])]
    models = langid.train(texts)
    words = [x + y + z for x in "abcdz" for y in "abcd" for z in ("", "a", "d", "zz")] + LANGS["xb"].split() + LANGS["xc"].split()
    got = models.word_scores(words)
    for k, language in enumerate(models.languages):
        word, one = _kneser_ney([t for x, t in texts if x == language])
        assert np.allclose(got[:, k], [word(w) for w in words], atol=1e-9)
        seen = {c for x, t in texts if x == language for c in t if c.isalpha()}
        for before in ("^^^^", "^^^a", "^^^c", "^^ab", "abab", "^^cd"):
            assert sum(one(before, c) for c in seen | {"$"}) < 1 + 1e-9
    assert got[:, -1].tolist() == [len(w) + 1 for w in words]


def test_language_id_without_anything_to_learn(make_docs):
    docs = make_docs([(1, "abc", None)])
    assert langid.fit(docs) is None
    assert langid.identify(docs, None).collect()[0]["lang_pred"] == "und"
    assert langid.identify(make_docs([]), None).collect() == []


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header><h2>Site name</h2></header><nav><ul><li><a href=/a>Menu one</a></li><li>Two</li></ul></nav>'
    '<div class="ad">Buy now all of this</div><div class=cookie-notice>We use cookies</div><article><h1>Head &amp; line</h1><p><b>First  text\n here.<br>More<p>Second &eacute; &#233; one with <a href=x>a link</a>.</p><aside>Side words</aside><form><input><button>Send</button></form>'
    '<blockquote>Quoted words</blockquote><div class="comments"><p>A reader says</p></div></article><section id="comments"><p>Nice page</p></section><footer>&copy; me</footer></body></html>'
)


def test_html_text(spark):
    costs = html.learn_costs([html.Page(PAGE)] * 3)
    want = "Head & line\n\nFirst text here. More\n\nSecond é é one with a link.\n\nQuoted words"
    assert html.extract(PAGE, costs) == want
    plain = "<body><nav><a>x</a><a>y</a></nav><div><p>" + "many words of text " * 20 + "</p><p>and these too, to the end</p></div><footer>bye</footer>"
    assert html.extract(plain, costs) == ("many words of text " * 20).strip() + "\n\nand these too, to the end"
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (3, "v", "", 1), (4, "w", "<p>unfinished <a href='", 1), (1, "u", PAGE, 1)], "page_id long, url string, html string, text int")
    got = html.extract_pages(pages, html.fit_costs(pages)).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter({(1, want): 2, (2, ""): 1, (3, ""): 1, (4, "unfinished"): 1})
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract_pages(pages.limit(0), {}).collect() == []


def test_html_text_beside_long_boxes():
    costs = html.learn_costs([html.Page(PAGE)] * 3)
    long = "many other words of no interest " * 40
    short = f"<body><nav><a>x</a></nav><article><h1>Short head</h1><p>Few words.</article><footer>&copy; {long}</footer></body>"
    assert html.extract(short, costs) == "Short head\n\nFew words."
    for box in ('<section id="comments">', '<div class="ad">', "<aside>"):
        end = f"</{box[1:].split()[0].rstrip('>')}>"
        boxed = f"{box}<p>{long}</p><p>{long}</p>{end}"
        assert html.extract(f"<body><div><p>The text of the page</p></div>{boxed}</body>", costs) == "The text of the page"
        assert html.extract(f"<body>{boxed}<main><p>The text of the page</p></main></body>", costs) == "The text of the page"
    assert html.extract(f"<body><footer>{long}</footer></body>", costs) == ""


def test_warc_round_trip(spark, tmp_path):
    long = "<html>" + "é" * 700 + "</html>"
    rows = [(1, "http://a/ü\r\nX: y", long), (7, "b", long), (3, None, long), (7, "b", long), (4, "c", "short"), (9, "d", "short"), (5, "e", None), (6, "f", ""), (None, "g", long), (8, "h", "x\r\n\r\ny" * 300)] + [(100 + i, f"u{i}", f"<p>{i}</p>" * 40) for i in range(30)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, response int")
    got = warc.round_trip(pages, with_payload=True).collect()
    import hashlib

    want = Counter()
    for i, u, h in rows:
        p = (h or "").encode()
        again = len(p) >= 1000 and sum((x or "") == (h or "") for _, _, x in rows) > 1 and i != max((j for j, _, x in rows if x == h and j is not None), default=i)
        want[(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 7 if again else None, u or "", None if again else p)] += 1
    assert Counter((*r[:6], r["payload"] if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    archives = warc.build_archives(warc.mark_revisits(pages))
    files = warc.write_files(archives, str(tmp_path)).collect()
    back = [warc.decode_record(r) for f in files for r in warc.frames((tmp_path / f["archive"]).read_bytes())]
    assert len(back) == len(rows)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_reader_rejects_damage():
    records = [warc.encode_record(i, "u", f"page {i}".encode() * 50, None, False) for i in range(20)]
    data = warc.build_archive(records)
    assert list(warc.frames(data)) == records
    for bad in (data[4:], data[:-3], data[:8]):
        with pytest.raises(Exception):
            assert list(warc.frames(bad)) == records
    with pytest.raises(ValueError):
        warc.decode_record(records[0].replace(b"page 0page", b"page 1page", 1))
    with pytest.raises(ValueError):
        warc.decode_record(records[0][:-1])


def test_pipeline_matches_its_stages(spark, tmp_path):
    """The whole pipeline on a small corpus against plain Python for what each stage must do."""
    rows = _lang_rows()[:90]
    near = rows[0][1] + " dolor"
    item = " ".join(LANGS["xb"].split() + LANGS["xc"].split())
    secret = "the dog runs token = abcdefgh12345 away " + rows[2][1]
    extra = [(900, rows[1][1], "xb"), (901, item + " und hund", "xb"), (902, None, "xa"), (903, "!!! 123", "xa"), (904, secret, "xc"), (905, secret, "xc")]
    docs = rows + extra
    base = str(tmp_path)
    frame = spark.createDataFrame([(i, t, lang, "s", len(t) if t else None) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    from tests.llm.test_text_ops import _components, _contaminated, _fingerprint

    kept = [(i, t) for i, t, _ in docs if t and any(c.isalpha() for c in t)]
    comps = _components([i for i, _ in kept], [_fingerprint(t) for _, t in kept])
    kept = [(i, t) for (i, t), c in zip(kept, comps) if i == c]
    clean = {r[0] for r in _contaminated(kept, [(1, item)]) if not r[5]}
    kept = [(i, t) for i, t in kept if i in clean]
    scan = automaton.scanner(automaton.BASE + automaton.ADDED)
    assert near and {i for i, _ in kept} >= {904} and not {i for i, _ in kept} & {900, 901, 902, 903, 905}
    sizes = Counter()
    for i, t in kept:
        for a, k, b in reversed(scan.spans(t)):
            t = t[:a] + f"[{scan.rules[k].name}]" + t[b:]
        sizes[(i, len(packing.TokenBytes(queries.tokenizer_path())(t)) // 4 + 1)] += 1
    got = corpus_pipeline.run(spark, base).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == sizes
    seqs = Counter()
    for r in got:
        seqs[r["sequence_id"]] += r["length"]
    assert max(seqs.values()) <= 1024


@pytest.mark.parametrize("page, text", [
    ('<body class="has-sidebar"><div class="main has-sidebar"><p>A text of a few words.</p></div></body>', "A text of a few words."),
    ('<div class="post social"><p>On social life.</p></div><div class="social-links"><a>x</a> y</div>', "On social life."),
    ("<header><h1>The site</h1></header><article><header><h1>Title</h1></header><p>Words of it.</p></article>", "Title\n\nWords of it."),
    ('<div id="content"><p>One two three.</p></div><div id="comment-list"><p>I say ' + "so " * 300 + "</p></div>", "One two three."),
    ('<p>One two three.</p><div class="ad-slot">Buy ' + "now " * 300 + '</div><p>Four five.</p><div class="no-ads"><p>Six.</p></div>', "One two three.\n\nFour five.\n\nSix."),
])
def test_html_boxes_by_their_class_words(page, text):
    assert html.extract(page, {"h1": 0.05, "p": 0.05, "header": 0.2, "div": 0.2}) == text


def test_html_class_words_are_learned():
    pages = [f'<div class="zz{i % 2}">these are {i} words of something else</div><article class="q"><div class="yy"><p>' + "main words " * 40 + "</p></div></article>" for i in range(30)]
    costs = html.learn_costs([html.Page(x) for x in pages])
    assert costs[".zz0"] < -1 < 0 < costs[".yy"]
    assert html.extract('<div class="zz1">left out however long ' + "x " * 200 + '</div><div class="yy"><p>Kept words.</p></div>', costs) == "Kept words."


def test_html_region_is_the_maximum_of_all():
    """Against every contiguous part."""
    rng = np.random.default_rng(9)
    costs = {"p": 0.5, "li": 3.0, "a": 2.0, "div": 1.0, "ul": 4.0}
    for _ in range(200):
        parts = [rng.choice(["<p>", "</p>", "<li>", "<a>", "</a>", "<div>", "</div>", "<ul>", "<div class=ad>"]) if rng.random() < 0.6 else "w " * int(rng.integers(1, 6)) for _ in range(25)]
        page = html.Page("".join(parts), costs)
        each = [0.0 if away else words or -costs.get(name, html.DEFAULT_COST) for (name, words), away in zip(page.scores_of, page.away)]
        best = max((sum(each[i:j]) for i in range(len(each) + 1) for j in range(i, len(each) + 1)), default=0.0)
        i, j = html.best_region(page, costs)
        assert abs(sum(each[i:j]) - max(best, 0.0)) < 1e-9


def test_html_of_repeated_and_very_long_pages(spark):
    long = "<article>" + "<p>some words and more</p>" * 60_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", long), (2, "u", "<p>x y</p>"), (2, "u", "<p>x y</p>")], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["n_chars"]) for r in html.extract_pages(pages, html.fit_costs(pages)).collect())
    assert got == Counter({(1, 60_000 * 21 - 2): 1, (2, 3): 2})


def test_pipeline_of_nothing_and_of_rows_without_ids(spark, tmp_path):
    schema, no_items = "doc_id long, text string, lang string, source string, n_chars long, fp string", spark.createDataFrame([], "item_id long, text string")
    rows = [(i, t, lang, "s", len(t), None) for i, t, lang in _lang_rows()[:60]] + [(None, None, "xa", None, None, "x"), (61, "", None, None, 0, "x")]
    one, two = "the fox jumps over the lazy dog " * 9 + "quick", "and the dog runs away from it brown fox " * 7
    rows += [(None, one, None, None, None, "y"), (None, one, None, None, None, "y"), (None, two, None, None, None, "z"), (0, two, None, None, None, "z"), (70, "lorem ipsum dolor sit amet " * 3000, None, None, None, None)]
    for name, own in (("none", []), ("some", rows)):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        no_items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect() if r["start"] == 0)
    assert got[None] == 1 and got[61] == 0 and got[70] == 1  # `one`, once; `two` went to the row with an id
    assert got[0] == 2  # two texts under one id
