"""A training-data pipeline over `documents`: five stages, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of `documents`,
the last one the token ids.  Between stages rows are written as Parquet in the
shared folder and read again, so a lost executor repeats tasks, not stages.
Empty tables, null texts and repeated rows follow the operators' rules.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard, pieces, suffix_dedup, toxicity
from tessella.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC; all of them where no word tells toxic texts apart.

    Repeated rows share a fate; null and empty texts have the score of no known word.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not len(model.keys):
        return docs.select(*COLUMNS)
    return toxicity.score(docs.select(*COLUMNS), model, "_score").where(F.col("_score") < TOXIC).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; of rows with that id, one.

    Null and empty texts are linked with nothing and stay.
    """
    return jaccard.keep_first(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that also occur elsewhere."""
    cut = suffix_dedup.remove_repeats(docs, keep_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("repeated_strings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: No stage's learning or iteration is expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
