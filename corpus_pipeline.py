"""From raw documents to token ids: language ID, exact dedup, near-dedup, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertinax.llm import bpe, exact_dedup, hd_langid, mixing, simhash
from pertinax.llm.common import documents
from pertinax.session import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; profiles are learned from those not held out."""
    profiles = hd_langid.train(docs.where(~hd_langid.held_out(F.col("doc_id"))))
    return hd_langid.keep_identified(docs, profiles)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z/a-z, the row with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fingerprints linked at 4 or fewer bits, the row with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one at each source's cut ends at the budget."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return bpe.roundtrip(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL has no hyperdimensional profiles, XXH64 fingerprints or merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table; what a stage returns is written before the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
