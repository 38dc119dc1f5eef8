"""A training corpus from `documents`, in five stages, each on all that its predecessor kept.

Language ID drops what it rejects; SimHash keeps one document, that of the smallest doc_id, of each group of near-duplicates; decontamination drops
documents that hold a benchmark passage; the secret scan replaces secrets by their kind; packing assigns every
token piece a sequence and an offset. All stages but the last return the columns of documents.

Cases: null texts and texts without a letter go with the first stage (they have no language); an empty table, and one of which a stage keeps
nothing, give no rows; of repeated rows the SimHash stage keeps one; rows without an id are told apart by their text and stay unless
their group holds a smaller key (ids first); different texts under one id are judged each for itself; very long texts are read whole, and extra
columns, whatever their names, travel along up to the last stage. Intermediate tables are deleted after each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import automaton, decontam, langid, packing, simhash
from lacuna.llm.common import drop_table, fresh, row_key, scratch, shared_dir
from lacuna.llm.queries import tokenizer_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the smallest id, then the least digest of the text. Rows without an id stay only if no row of their group has one."""
    keys = row_key("doc_id", "text")
    found = simhash.first_of_components(docs)
    own = fresh(docs, *found.columns)
    kept = docs.select("*", *(k.alias(c) for k, c in zip(keys, own))).join(found.toDF(*own), own, "left_semi")
    return kept.dropDuplicates(own).select(*(f"`{c}`" for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return automaton.redact_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("simhash", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL has neither the language models nor XXH64 nor the tokenizer; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again as the next one's documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_dir(spark)}/lacuna-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last:
            drop_table(spark, last)
        last = f"{base}/{name}"
    return docs
