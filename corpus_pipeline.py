"""The pipeline from raw documents to token ids.

Every stage takes what the one before kept, written as Parquet and read again; all but
the last return the columns of ``documents``.  Tables between stages go to the folder
that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.llm import line_dedup, mixing, ngram_join, quality_model, tokens
from oremill.llm.queries import tokenizer_model
from oremill.llm.text import tuned
from oremill.plans.staging import stage

#: Weights of the sources in the mix, by code point order and repeating.
WEIGHTS = (5, 2, 1)


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the number of characters brought up to date."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    kept = quality_model.scored(F.col("text"), quality_model.fit(docs)) >= quality_model.KEEP_FROM
    return docs.where(kept)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one resembles; those that keep no line go."""
    return _like(line_dedup.deduplicated(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return _like(ngram_join.without_copies(docs), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, the two at a run's ends cut."""
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    return _like(mixing.taken_documents(mixing.mixed(sized, WEIGHTS)), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, and whether they decode to its text."""
    model = tokenizer_model()
    both = tokens.round_trip(docs.select("doc_id", "source", "text"), model)
    return both.select("doc_id", "source", "ids", F.size("ids").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


#: The stages share executors, whose workers keep what they have taken, so batches for Python are smaller than an operator's own.
small = functools.partial(tuned, settings={"spark.sql.execution.arrow.maxBytesPerBatch": "2m"})

STAGES = [
    ("quality classifier", small(quality_classifier)),
    ("line dedup", small(line_deduplication)),
    ("n-gram Jaccard join", small(near_duplicates)),
    ("mixing sources to target weights", small(source_mix)),
    ("SentencePiece encoding and decoding", small(token_ids)),
]
ORACLE_SQL = None  # models, hashing order and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
