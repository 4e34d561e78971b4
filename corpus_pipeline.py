"""The corpus pipeline: five stages over documents, each working on all that its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import decontaminate, langid_crf, piece_offsets, secret_forest, simhash
from packetloom.llm.tables import set_apart, table
from packetloom.session import written

#: Near copies: words of a shingle and most differing bits of two fingerprints.
COPY_SHINGLE, COPY_BITS = 4, 4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; null texts and texts without letters go.

    Code-switched texts stay, however evenly their languages are mixed. A missing ``lang`` is
    filled with the prediction.
    """
    docs, back = set_apart(docs, "doc_id", "text", "lang")
    model = langid_crf.fit(docs)
    if not model.languages:  # nothing to learn from: only the letter test is left
        return back(docs.where(F.regexp_like("text", F.lit(r"\p{L}"))))
    found = langid_crf.identify(docs, model, spans=False)
    kept = found.where(F.col("lang_pred") != langid_crf.UNKNOWN)
    return back(kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id."""
    return simhash.one_of_each(docs, shingle=COPY_SHINGLE, max_bits=COPY_BITS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    docs, back = set_apart(docs, "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), window=10)
    return back(found.where("n_hit = 0"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and ``n_chars`` counted anew."""
    clean = secret_forest.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and each piece's span of source bytes."""
    return piece_offsets.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", known_language),
    ("copies", one_of_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", pieces),
]
#: Forests, random fields and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
