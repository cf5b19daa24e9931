"""Large place exports: one JSON object with an array of places, read by many tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions.storage import scratch

#: Depth within {"places": [ ... ]}: a place opens from here.
OUTSIDE = 2
#: Splits of the input at most, whose few numbers are broadcast: 100 TB in splits of 128 MB are 800,000.
SPLITS = 2_000_000
STRUCTURE = re.compile(r'\\.|["{}\[\]]', re.DOTALL)


def step(text: str, quoted: bool) -> tuple[bool, int]:
    """Whether the end of a fragment lies within a string, and by how much it is deeper than its beginning.

    A fragment is what stands before a closing brace, so an escape never reaches over its end.
    """
    if "\\" in text:
        text = re.sub(r"\\.", "", text, flags=re.DOTALL)
    parts = text.split('"')
    bare = "".join(parts[quoted::2])
    deeper = bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
    quoted ^= len(parts) % 2 == 0
    return quoted, deeper - (not quoted)  # the brace that ended the fragment closes something unless it is text


def split_summaries(fragments: DataFrame) -> DataFrame:
    """file, block, flips, if_bare, if_quoted of each split: whether quotes are odd, and the depth it adds by how it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, [], []

        def close() -> None:
            if now is not None:
                (bare, a), (quoted, b) = state
                rows.append((*now, int(bare), a, b))

        for batch in batches:
            for text, *at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if tuple(at) != now:
                    close()
                    now, state = tuple(at), [(False, 0), (True, 0)]
                state = [(q, d + more) for (was, d) in state for q, more in [step(text, was)]]
        close()
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["file", "block", "flips", "if_bare", "if_quoted"])

    return fragments.mapInArrow(run, "file string, block long, flips int, if_bare long, if_quoted long")


def split_starts(summaries: DataFrame) -> DataFrame:
    """file, block, quoted, depth: how each split of a file begins, from running sums over those before it."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = summaries.withColumn("quoted", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    return first.withColumn("adds", F.when(F.col("quoted"), F.col("if_quoted")).otherwise(F.col("if_bare"))).select("file", "block", "quoted", F.coalesce(F.sum("adds").over(before), F.lit(0)).alias("depth"))


def element_pieces(fragments: DataFrame) -> DataFrame:
    """file, block, piece, whole, text of fragments (text, file, block, quoted, depth): the elements of the array.

    An element that reaches over the end of its split is a piece (whole false): its beginning has piece 1, what another
    split has of it piece 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quoted, depth, begun = None, False, 0, False
        open_: list[str] = []
        rows: list[tuple] = []

        def put(at: tuple, whole: bool) -> None:
            rows.append((*at, int(begun), whole, "".join(open_)))
            open_.clear()

        for batch in batches:
            for text, *at, q, d in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if tuple(at) != now:
                    if open_:
                        put(now, False)
                    now, quoted, depth, begun = tuple(at), q, d, False
                first = 0
                if depth <= OUTSIDE:
                    first = len(text)
                    for m in STRUCTURE.finditer(text):
                        c = m.group()
                        if c == '"':
                            quoted = not quoted
                        elif not quoted and c in "{[":
                            depth += 1
                            if c == "{" and depth == OUTSIDE + 1:
                                first, begun = m.start(), True
                                break
                        elif not quoted and c in "}]":
                            depth -= 1
                    if first == len(text):
                        depth -= not quoted
                        continue
                    quoted, more = step(text[first + 1 :], quoted)
                else:
                    quoted, more = step(text, quoted)
                depth += more
                open_ += [text[first:], "}"]
                if depth <= OUTSIDE and not quoted:
                    put(now, begun)
                    begun = False
            yield pieces(rows)
            rows.clear()
        if open_:
            put(now, False)
        yield pieces(rows)

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["file", "block", "piece", "whole", "text"])

    return fragments.mapInArrow(run, "file string, block long, piece int, whole boolean, text string")


def read_large_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per place of exports {generated_at, count, places: [...]} of any size and layout; schema: of a place.

    Spark's text reader cuts files into splits and splits into fragments at closing braces. A first pass tells of each split
    whether its quotes are odd and how deep it goes, running sums over the splits of a file give how each begins, and a
    second pass cuts the elements. Those that reach over splits, at most two pieces a split, are put together at the end.
    Of arrays at the top only places may hold objects. A file that isn't UTF-8 or no JSON has no defined result; an
    element that doesn't fit the schema gives nulls. The input is read twice.
    """
    text = spark.read.option("lineSep", "}").text(path)
    fragments = text.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    told = scratch(spark, "splits")
    split_summaries(fragments).write.parquet(told)
    summaries = spark.read.parquet(told)
    starts = split_starts(summaries)
    if summaries.count() > SPLITS:
        raise ValueError(f"more than {SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    # the broadcast join keeps the order of fragments within their split
    pieces = element_pieces(fragments.join(F.broadcast(starts), ["file", "block"]).select("text", "file", "block", "quoted", "depth"))
    begun = F.sum("piece").over(Window.partitionBy("file").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, 0))
    cut = pieces.where("NOT whole").withColumn("element", begun)
    joined = cut.groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece", "text"))), lambda x: x["text"]), "").alias("text"))
    elements = pieces.where("whole").select("text").unionByName(joined.select("text"))
    return elements.select(F.from_json("text", schema).alias("p")).select("p.*")
