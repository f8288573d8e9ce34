"""The corpus pipeline: quality, near copies, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of documents,
the last one the token ids. Every stage's rows are written and read again.

Defined cases, for every stage: null text counts as empty (and stays null); a null doc_id is a row of its own, never a near copy; rows of
equal doc_id are judged by their own text, equal rows alike; texts may be of any length; further columns are kept, whatever their
names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from panelweft.llm import bpe, decontamination, jaccard, pii, quality
from panelweft.llm.common import written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (sets of five-word shingles at least 0.8 alike) the document of the smallest doc_id stays."""
    return jaccard.keep_one(docs, like=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are generalised or removed in the text; n_chars follows."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, and whether they decode to the very text."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, check=True)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "same")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("tokens", encode),
]

#: SQL cannot express the fitted classifier nor the tokenizer; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
