"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions.storage import scratch

#: The characters that separate words: space and \t \n \v \f \r.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder, and read again: a cut in the lineage that outlives executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_scan(docs: DataFrame) -> bool:
    """Whether docs is a plain scan of files, whose rows come in the same tasks and order whenever they are read."""
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def steady(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of docs, whose rows lie in the same order whenever they are read: other inputs than a scan of files are written first."""
    own = docs.select(*columns)
    return own if is_scan(docs) else materialize(own, "steady")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with the column `name`, which differs in every row and is the same whenever the rows are read again.

    For a plain scan of Parquet files that is a row's file and place there; other rows are written once with a number.
    """
    if is_scan(docs):
        with contextlib.suppress(AnalysisException):
            return docs.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index"))
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


#: The most keys that are cut into slices, and so broadcast.
HOT_KEYS = 50_000


def slice_rows(total: int, rows_per_task: int) -> int:
    """Rows of a key from which on it is cut: of `total` rows at most HOT_KEYS keys have more."""
    return max(rows_per_task, 1 + total // HOT_KEYS)


def join_sliced(rows: DataFrame, table: DataFrame, sizes: DataFrame, keys: list[str], spread: Column, most: int) -> DataFrame:
    """rows joined with table, which has one row for each of keys; with slice, the part of its key's rows that a row is in.

    sizes (keys, copies) and table.copies tell how many rows have the keys. Those with more than `most`, of slice_rows and so
    HOT_KEYS at most, are cut by spread, a hash of what differs in their rows; so no task meets all rows of one key.
    """
    slices = F.ceil(F.col("copies") / most).cast("int")
    hot = F.broadcast(sizes.where(F.col("copies") > most).select(*keys, slices.alias("slices")))
    cut = rows.join(hot, keys, "left").withColumn("slice", F.pmod(spread, F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    return cut.join(table.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))), [*keys, "slice"])


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(value of each column) row by row, with few rows as Python objects at a time."""
    for batch in batches:
        at = [batch.schema.get_field_index(c) for c in columns]
        for first in range(0, batch.num_rows, 256):
            some = batch.slice(first, 256)
            yield from zip(*(some.column(k).to_pylist() for k in at), strict=True)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def hash_share(h: Column, wanted: int, rows: int) -> Column:
    """Whether a signed 64-bit hash falls into the share wanted / rows of all hashes: about that many rows, at any size."""
    if wanted >= rows:
        return F.lit(True)
    return h < F.lit((1 << 64) * wanted // rows - (1 << 63))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes to differ from every column of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
