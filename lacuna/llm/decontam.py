"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, runs of GRAIN words are hashed from these, and of every WINDOW - GRAIN + 1 consecutive run hashes the least is
kept: the fingerprint of the window of WINDOW words that they span. Equal windows have equal fingerprints, so every shared span of
WINDOW words or more is found; consecutive windows mostly share their fingerprint, which is joined once. Where a document's and an
item's fingerprints agree, the hit is extended: the windows with that fingerprint are compared word by word with the item's.
Items of fewer words are one window each; documents are searched for every length that such items have.

The benchmark's windows, with their items, are broadcast if they take at most BROADCAST_BYTES; otherwise both sides are shuffled on the
fingerprint and the words are fetched by document. Cases: null and wordless texts have no words, hits or items; a null item id is not listed but
its text is searched for; equal items count each; rows that agree in id and text are one document repeated and get
equal results; empty tables give no rows, or no hits; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import KEYS, ascii_lower, cut, fresh, row_key

WINDOW, GRAIN = 10, 4
#: Java's form of what separates words, before and after A-Z are lower-cased.
SEPARATORS, SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20
#: In repetitive text one fingerprint can stand for any number of windows in a row; such runs are joined again every so many windows,
#: as a join reaches WINDOW - GRAIN windows on. Twice this less one must not exceed that reach by more than one.
RESTART = (WINDOW - GRAIN + 2) // 2


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), "")).cast("long")


def _pairs(df: DataFrame, name: str, of: str, shift: int, both) -> DataFrame:
    """Adds the array of both(x[i], x[i + shift])."""
    n = F.greatest(F.size(of) - shift, F.lit(0))
    return df.withColumn(name, F.zip_with(F.slice(of, F.lit(1), n), F.slice(of, F.lit(shift + 1), n), both))


def fingerprinted(df: DataFrame) -> DataFrame:
    """Adds `prints`: at i the fingerprint of the window of words i to i + WINDOW - 1. Each step is a column, so that none is computed twice."""
    df = df.withColumn("_h", F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    have, of = 1, "_h"
    while have < GRAIN:
        df, have = _pairs(df, f"_g{have * 2}", of, have, lambda a, b: F.xxhash64(a, b)).drop(of), have * 2
        of = f"_g{have}"
    have, most = 1, WINDOW - GRAIN + 1
    while have < most:
        step = min(have, most - have)
        df, have = _pairs(df, f"_m{have + step}", of, step, lambda a, b: F.least(a, b)).drop(of), have + step
        of = f"_m{have}"
    return df.withColumnRenamed(of, "prints")


def _line(words: str, at: Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, at + 1, n), " ")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(KEYS, hits, items) of the documents with hits: hits holds structs (at, n), items the sorted ids of items with occurring windows."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
    whole = fingerprinted(items).select("item", "words", F.posexplode_outer("prints").alias("at", "print")).where("print is not null")
    whole = whole.select("print", F.lit(WINDOW).alias("n"), _line("words", F.col("at"), WINDOW).alias("line"), "item")
    short = items.where((F.size("words") > 0) & (F.size("words") < WINDOW)).select(F.lit(None).cast("long").alias("print"), F.size("words").alias("n"), F.array_join("words", " ").alias("line"), "item")
    known = whole.unionByName(short).groupBy("print", "n", "line").agg(F.collect_set("item").alias("items"))
    known, _ = cut(known, "benchmark-windows")
    prints = known.where("print is not null").select("print").distinct()
    lengths = [r["n"] for r in known.where("print is null").select("n").distinct().collect()]  # fewer than WINDOW
    size = known.agg(F.sum(F.octet_length("line") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16) + 64).alias("n")).collect()[0]["n"] or 0
    small = size <= BROADCAST_BYTES
    hold = F.broadcast if small else (lambda df: df)

    rows = docs.select(*row_key(id_col, text_col), words_of(F.col(text_col)).alias("words"))
    full = fingerprinted(rows)
    # outer: else Spark infers a filter on the array's size, moves it below and computes all steps once more for each use
    runs = full.select(*KEYS, "words", "prints", F.posexplode_outer("prints").alias("at", "print")).where(f"print is not null and (at = 0 or print <> prints[at - 1] or (at % {RESTART} = 0 and print = get(prints, at - {RESTART})))")
    if small:
        found = runs.join(hold(prints), "print")
    else:
        places = runs.select(*KEYS, "at", "print").join(prints, "print").groupBy(*KEYS).agg(F.collect_set(F.struct("at", "print")).alias("places"))
        found = full.join(places, KEYS).select(*KEYS, "words", "prints", F.explode("places").alias("p")).select(*KEYS, "words", "prints", "p.at", "p.print")
    last = F.least(F.col("at") + (WINDOW - GRAIN), F.size("prints") - 1)
    windows = found.select(*KEYS, "words", "prints", "print", F.explode(F.sequence("at", last)).alias("at")).where("prints[at] = print")
    windows = windows.select(*KEYS, "at", F.lit(WINDOW).alias("n"), _line("words", F.col("at"), WINDOW).alias("line"))
    if lengths:  # one pass over the documents for all of them
        each = rows.select(*KEYS, "words", F.explode(F.array(*(F.lit(n) for n in sorted(lengths)))).alias("n")).where(F.size("words") >= F.col("n"))
        each = each.select(*KEYS, "words", "n", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("at"))
        windows = windows.unionByName(each.select(*KEYS, "at", "n", _line("words", F.col("at"), F.col("n")).alias("line")))
    hits = windows.join(hold(known.select("n", "line", "items")), ["n", "line"])
    return hits.groupBy(*KEYS).agg(F.collect_set(F.struct("at", "n")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = contaminated(docs, benchmark, id_col, text_col, item_col, item_text)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1)))))
    found = found.select(*KEYS, covered.cast("long").alias("hit"), F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), count_words(F.col(text_col)).alias("n_words"), *row_key(id_col, text_col))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return every.join(found, KEYS, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without hits, with the same columns."""
    own = fresh(docs, *KEYS)
    found = contaminated(docs, benchmark, id_col, text_col, item_col, item_text).select(*KEYS).toDF(*own)
    return docs.select("*", *(k.alias(c) for k, c in zip(row_key(id_col, text_col), own))).join(found, own, "left_anti").select(*(f"`{c}`" for c in docs.columns))
