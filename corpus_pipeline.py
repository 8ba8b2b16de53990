"""A corpus pipeline: toxic documents go, near duplicates go, contaminated documents go, sources are mixed to weights,
and what is left becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what its predecessor kept.  All stages but
the last return the columns of ``docs``.  Nulls and empty texts: a null text is not toxic (its score is that of a text
without known words), has no near duplicate, is not contaminated, has no tokens of its own but the end id, and stays; a
null doc_id stays through the filters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframe.llm.common import held_out, own_shuffles, release, shared_folder, table
from chainframe.llm.decontaminate import decontaminate
from chainframe.llm.mixing import taken_rows
from chainframe.llm.near_dedup import deduplicate
from chainframe.llm.queries import TOKENIZER, WEIGHTS, levels
from chainframe.llm.tokens import read_tokens, write_tokens
from chainframe.llm.toxicity import THRESHOLD, fit, score

#: Share of the tokens that the mix keeps, at most one epoch of each leaf.
SHARE, SEED = 0.8, 8


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold.  The model learns from the labelled documents of the stage's input that are
    not held out."""
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model, "_toxicity").where(F.col("_toxicity") < THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves, without their long benchmark passages.  ``n_chars`` follows the text."""
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, as often as it takes them."""
    return taken_rows(docs, levels(), WEIGHTS, SHARE, max_epochs=1, seed=SEED)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids, read back from the written blocks."""
    return read_tokens(spark, write_tokens(docs, TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: The classifier, the signatures and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        with own_shuffles(spark):
            kept.write.parquet(f"{folder}/{name}")
        release(spark)
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
