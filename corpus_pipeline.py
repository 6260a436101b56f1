"""A training corpus from raw documents, in five stages.

Each stage works on all rows that the one before it kept. All but the last return the
columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm import bpe, line_dedup, minhash, mixing, quality
from pagesieve.llm.queries import MIX, MIX_OPTIONS, VOCABULARY
from pagesieve.llm.storage import stored

#: Words of a shingle in the near-dedup stage.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of an earlier document go; so do documents that lose all their words."""
    return line_dedup.deduplicated(docs, whole=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id."""
    return minhash.one_of_each(docs, width=SHINGLE_WORDS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budgets of their leaves take them."""
    return mixing.mixed(docs, MIX, **MIX_OPTIONS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded; the digest of what its ids decode to comes along."""
    tokens = bpe.encode(
        docs.select("doc_id", "lang", "source", "text"), VOCABULARY, drop_text=True, offsets=False
    )
    return bpe.decode(tokens, VOCABULARY).select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("MinHash near-dedup", near_duplicates),
    ("mixing", mixed_sources),
    ("byte-level BPE", token_ids),
]

#: BPE cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
