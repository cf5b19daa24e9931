"""The corpus pipeline: quality rules, toxicity, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions.storage import discard, scratch
from cartolake.llm import packing, quality, secrets, simhash, toxicity
from cartolake.llm.common import numbered, unused

#: Packing and toxicity scores have no SQL form; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule rejects; a null or empty text has too few words and goes."""
    return docs.where(quality.cascade(quality.order_rules(docs, quality.default_rules())).isNull())


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows among docs; rows predicted toxic go, each by its own text, whatever its doc_id.

    Without labels of both classes nothing can be learned, and all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    return docs if model is None else toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id, then name of the row; null doc_ids come last.

    The names of rows stay the same whenever they are read, so that the choice and the rows kept have the same ones.
    """
    number = unused(docs, "row_number")
    rows = numbered(docs, number)
    return rows.join(simhash.representatives(rows, number), number, "left_semi").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with a mark in place of each secret and n_chars, where there is one, of the text that is left."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, with their places; a null or empty text is one piece of its end alone, and no rows give none.

    The pieces are written within, so the result doesn't read docs any more.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep. A stage's table goes as soon as the next stage has read it."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept, read_from = stage(spark, docs, sf_dir), path
        path = scratch(spark, name.replace(" ", "-"))
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        discard(spark, read_from)
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, path)
    return pieces
