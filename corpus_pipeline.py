"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction and packing of documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is written as Parquet
before the next one reads it. All but the last return the columns of documents.

All stages: an empty table gives an empty result, repeated rows are each a row, extra columns are kept by all
stages but the last, whatever their names, and very long texts are one row each that is worked on in blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigrid.llm import credentials, decontaminate, language, near_dup, packing
from lumigrid.llm._shared import drop, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or of no language with a score of 0.3, go.

    If none has a label, only those without a letter go. Of equal scores (ties) the first language by name counts.
    """
    return language.accepted(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: sets of five-word shingles of similarity 0.8 or more.

    Rows are told apart by their number in docs, so an id may be null or repeat: rows of one id and one text are
    copies, and rows of one id and different texts are different documents. The first row of a group stays, so there
    are no ties. Null and empty texts are in no group and stay.
    """
    key = next(k for i in range(len(docs.columns) + 1) if (k := f"row{i}") not in docs.columns)
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    gone = table(near_dup.groups(rows, id_col=key).where("not kept").select(F.col("doc_id").alias(key)), "gone")
    # What goes grows with the corpus, so it is never broadcast: the plan is the same at every size.
    return rows.join(gone.hint("merge"), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of any benchmark item occurs go; null and empty texts have none and stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; documents stay, and null texts stay null. Spans that touch are one mask."""
    return credentials.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces in token sequences; null and empty texts are the end token alone."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]
#: Tokens and learned labels are not for SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/lumigrid/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        if before is not None:
            drop(before)
        docs = before = spark.read.parquet(f"{root}/{name}")
        before.written_to = f"{root}/{name}"
    return docs
