"""Corpus pipeline: language ID, exact dedup, near dedup, personal data, packing.

Each stage works on all that its predecessor kept; `run` writes each result as Parquet
and reads it again as the next one's input.  All stages but the last return the columns of
`documents`.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import scratch

#: Documents whose language is less sure than this are rejected, as are those without letters.
LEAST_SCORE = 0.4

#: Intermediate tables of the stage called last, which its result may still read.
_last: list[str] = []


@contextlib.contextmanager
def _tables(spark: SparkSession) -> Iterator[None]:
    """A stage's intermediate tables; those of the stage before go, whose result has been written.

    Heap goes back at both ends: while executors make a file, the local file system's `chmod` counts all of it twice.
    """
    scratch.remove(spark, _last)
    scratch.release(spark)
    scratch.shrink(spark)
    with scratch.collected() as paths:
        yield
    scratch.shrink(spark)
    _last.extend(paths)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier can tell."""
    from tidewell.llm.language_id import UNKNOWN, fit_sample, identify

    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    with _tables(spark):
        model = fit_sample(docs)
        if {"lang_pred", "score"}.isdisjoint(docs.columns):
            kept = identify(docs, model).where(sure).select(*[F.col(f"`{c}`") for c in docs.columns])
        else:
            whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
            kept = identify(whole, model).where(sure).select("doc.*")
        return scratch.written(kept, "language-kept")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    from tidewell.llm.exact_dedup import exact_dedup as keep

    with _tables(spark):
        return keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8)."""
    from tidewell.llm.similar import near_dedup as keep

    with _tables(spark):
        return keep(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars follows."""
    from tidewell.llm.pii import redact

    with _tables(spark):
        clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all tokens of all documents in sequences; a row for each piece."""
    import public_tokenizers

    from tidewell.llm.packing import pack

    with _tables(spark):
        return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("packing", packing),
]

#: SQL can't express the classifier, XXH64 or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`.  A stage's table goes once the next one is written; the last stays."""
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = scratch.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        scratch.remove(spark, former)
        former, docs = [path], spark.read.parquet(path)
    scratch.remove(spark, _last)
    return docs
