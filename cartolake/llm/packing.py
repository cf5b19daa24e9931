"""Packing by shortest-pack-first over the length histogram.

Documents are tokenized through the distinct-word shuffle (see worddict) and cut into pieces of at most `width` tokens.
Only the histogram of the pieces' lengths, at most `width` numbers, comes to the driver. There lengths are placed longest
first, each piece on the shortest pack, or on a new one where even that has no room. Equal packs move as a group, so what
is kept is how often each packing pattern occurs: each length splits one group at most, so the groups' number follows
`width`, not the input. The patterns are joined back to the pieces by rank within a length.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import encoded, materialize, steady
from .worddict import Answers, answer_words, by_text, texts_from_blocks, to_blocks

WIDTH = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
ROWS_PER_RANKING = 50_000


def word_encoder(path: str):
    """Function from distinct words, cut at ASCII white space, to their ids (unsigned 16-bit).

    The tokenizer drops white space and never joins across it, and its special tokens, which texts may hold, have none
    inside, so a text's ids are its words' ids, one after the other.
    """
    own = tokenizer(path)

    def encode(words: list[bytes]) -> list[bytes]:
        out = []
        for first in range(0, len(words), 2000):
            some = own.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words[first : first + 2000]], add_special_tokens=False)
            out += [np.array(e.ids, "<u2").tobytes() for e in some]
        return out

    return encode


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, path: str | None = None, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document's ids and end_id, cut every `width` ids."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        def prepare(found: Answers):
            gather = found.gatherer("<u2")

            def texts(doc_ids: list, lengths: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
                ids, per_word = gather(words)
                counts = by_text(lengths, per_word)
                wide = np.insert(ids.astype("<u4"), np.cumsum(counts), end_id)
                rows, at = [], 0
                for doc_id, n in zip(doc_ids, (counts + 1).tolist(), strict=True):
                    for start in range(0, n, width):
                        stop = min(start + width, n)
                        rows.append((doc_id, start, stop - start, zlib.crc32(wide[at + start : at + stop].tobytes()), n))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

            return texts

        return prepare

    answered = answer_words(to_blocks(steady(docs, "doc_id", "text"), lambda: lambda text: encoded(text).split()), lambda: word_encoder(path))
    return texts_from_blocks(answered, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, how many such packs) by shortest-pack-first; every length is placed as often as it occurs.

    Of packs with the same fill those go first whose pattern got there first.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = {}  # by fill
    fills: list[int] = []  # a heap of the fills in open_packs

    def put(pattern: tuple[int, ...], fill: int, packs: int) -> None:
        if fill not in open_packs:
            open_packs[fill] = {}
            heapq.heappush(fills, fill)
        open_packs[fill][pattern] = open_packs[fill].get(pattern, 0) + packs

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and fills and fills[0] + length <= width:
            fill = fills[0]
            pattern, have = next(iter(open_packs[fill].items()))
            used = min(have, left)
            left -= used
            if used < have:
                open_packs[fill][pattern] = have - used
            else:
                del open_packs[fill][pattern]
                if not open_packs[fill]:
                    del open_packs[heapq.heappop(fills)]
            put((*pattern, length), fill + length, used)
        # a new pack is the only one with room, so it takes all that fit before the next one opens
        times = width // length
        for n, packs in ((times, left // times), (left % times, 1)):
            if n and packs:
                put((length,) * n, n * length, packs)
    return sorted((p, n) for by in open_packs.values() for p, n in by.items())


def pattern_table(found: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """A row for each (pattern, distinct length in it): ranks first..first + packs * times of the length lie there."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, packs in found:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            times = pattern.count(length)
            rows.append((length, used[length], used[length] + packs * times, times, sequence, offset))
            used[length] += packs * times
            offset += times * length
        sequence += packs
    return pd.DataFrame(rows, columns=["length", "first", "last", "times", "sequence_at", "offset_at"], dtype="int64")


def pack(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """cut (doc_id, start, length, others) with sequence_id and offset. Equal pieces each get their own place."""
    spark = cut.sparkSession
    rows = materialize(cut.withColumn("piece_no", F.monotonically_increasing_id()), "pieces")
    sized = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # `width` rows at most
    histogram = {r["length"]: r["n"] for r in sized}
    table = pattern_table(patterns(histogram, width))
    places = spark.createDataFrame(table, "length long, first long, last long, times long, sequence_at long, offset_at long")
    # a hot length is ranked in many buckets, whose counts give the ranks before each
    buckets = max(8, max(histogram.values(), default=0) // ROWS_PER_RANKING + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("piece_no"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("start_rank"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("piece_no")) - 1)
    ranked = ranked.join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("start_rank"))
    # the patterns' number is bounded by the histogram, not by the input
    met = ranked.alias("r").join(F.broadcast(places.alias("p")), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    k = F.col("rank") - F.col("first")
    return met.select(
        *(F.col(f"r.{c}").alias(c) for c in cut.columns), (F.col("sequence_at") + F.floor(k / F.col("times"))).alias("sequence_id"),
        (F.col("offset_at") + F.pmod(k, F.col("times")) * F.col("r.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row of docs.

    A null or empty text is one piece that holds the end id alone. Equal rows are packed each for itself; a null doc_id
    stays null; an empty table gives no rows; other columns are dropped, whatever their names. A text of any length is met
    whole, in pieces. Pieces of one length take the places of that length by an arbitrary rank; the packing is the same.
    Within a sequence offsets have no gaps.
    """
    return pack(pieces(docs, path, width), width)
