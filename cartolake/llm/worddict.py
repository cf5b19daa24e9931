"""The global distinct-word shuffle that tokenization and language-model scoring share.

Texts are cut into words with positions. A block is a run of rows of one input partition; in it every distinct word has a
local number. What leaves a block is (block, bucket, words), the exploded word table with equal words of a block
pre-aggregated and gathered by the word's hash bucket, and (block, part, sequence), which holds the positions: the local
numbers of the block's texts in order. The word rows go to the bucket's partition, where each distinct word is handled
once and every block gets the answers; these go back to the block, where the texts are reassembled by position.

A block is bounded by BLOCK_WORDS; only a single text longer than that makes a longer one. No word is hot: a block holds
it once. There are as many buckets as shuffle partitions, so a bucket's words shrink as a cluster grows. Block numbers
come from the partition and a counter, so a task that runs again makes the same rows, provided that its input comes in the
same order again: docs must be a scan of files, or of a table written before, not the result of a shuffle.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, texts_of

BLOCK_WORDS = 4_500_000
PART_WORDS = 250_000
#: Distinct words whose answers a bucket keeps at once. Beyond, it starts again; answers stay the same.
KNOWN_WORDS = 1_500_000
#: n: the bucket of a row of words; for a part of a sequence, part - 2^30, so that by n these come first and in order.
SCHEMA = "block long, n int, payload binary"
ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("payload", pa.binary())])
PARTS_FROM = -(1 << 30)
#: Payload bytes of a batch that goes back to Spark.
BATCH_BYTES = 4 << 20


def batched(rows: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[2])
        if size >= BATCH_BYTES or len(some) >= 5000:
            yield to_batch(some)
            some, size = [], 0
    if some:
        yield to_batch(some)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        blocks, ns, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for k, (block, n) in enumerate(zip(blocks, ns, strict=True)):
            yield block, n, payloads[k].as_py()


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and shares the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def squeeze(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def expand(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def to_planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of their significance: planes of small numbers are mostly zero."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Block:
    """The texts of a block as local word numbers."""

    def __init__(self) -> None:
        self.local: defaultdict[bytes, int] = defaultdict()
        self.local.default_factory = self.local.__len__
        self.names: list = []
        self.lengths: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.size = 0

    def add(self, name, words: list) -> None:
        self.names.append(name)
        self.lengths.append(len(words))
        self.numbers.append(np.fromiter(map(self.local.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def rows(self, block: int, buckets: int, tally: Callable[[list, list[int], np.ndarray, int], np.ndarray] | None) -> Iterator[tuple[int, int, bytes]]:
        if not self.names:
            return
        numbers, distinct = np.concatenate(self.numbers), len(self.local)
        self.numbers.clear()
        often = np.empty(distinct, np.int64)  # local numbers by falling frequency: most are then small
        often[np.argsort(-np.bincount(numbers, minlength=distinct), kind="stable")] = np.arange(distinct)
        counts = tally(self.names, self.lengths, often[numbers], distinct) if tally else None
        stops = np.cumsum(self.lengths)
        first, part = 0, 0
        while first < len(self.names):
            begin = int(stops[first - 1]) if first else 0
            last = max(first + 1, min(int(np.searchsorted(stops, begin + PART_WORDS, side="right")), first + 100_000))
            yield block, PARTS_FROM + part, squeeze((self.names[first:last], self.lengths[first:last], to_planes(often[numbers[begin : int(stops[last - 1])]])))
            first, part = last, part + 1
        words = list(self.local)
        self.local.clear()
        words = words if not words or isinstance(words[0], bytes) else [encoded(w) for w in words]
        bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, distinct) % buckets
        order = np.lexsort((often, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in range(buckets):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                at = often[own]
                yield block, k, squeeze((to_planes(np.diff(at, prepend=0)), [words[i] for i in own.tolist()], None if counts is None else to_planes(counts[at])))


def to_blocks(docs: DataFrame, split: Callable[[], Callable[[str | None], list]], tally=None, batch_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of SCHEMA for all rows of docs. split() gives, in the task, the function from a text to its words, all str
    or all bytes. tally(names, lengths, numbers, distinct) may give a count for each local number, which goes along with
    the words. A text is named by doc_id, or by (doc_id, ...) with further columns."""
    buckets = partitions(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            cut, block, number = split(), Block(), TaskContext.get().partitionId() << 24
            for doc_id, text, *rest in texts_of(batches, "doc_id", "text", *batch_columns):
                block.add((doc_id, *rest) if rest else doc_id, cut(text))
                if block.size >= BLOCK_WORDS:
                    yield from block.rows(number, buckets, tally)
                    block, number = Block(), number + 1
            yield from block.rows(number, buckets, tally)
            del block
            release()

        return batched(rows())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *batch_columns).mapInArrow(run, SCHEMA)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(blocks: DataFrame) -> DataFrame:
    """One bucket's rows to one partition, parts of sequences evenly."""
    n = partitions(blocks)
    to = F.when(F.col("n") >= 0, F.col("n")).otherwise(F.shiftright("block", 24) + F.col("n")).cast("int")
    return blocks.repartitionById(n, F.pmod(to, F.lit(n)))


def answer_words(blocks: DataFrame, answer: Callable[[], Callable[[list[bytes]], list[bytes]]]) -> DataFrame:
    """blocks with the words of each row replaced by their answers. answer() gives, in the task, the function from
    distinct words to their answers; a bucket asks for each distinct word once. Parts of sequences pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            ask, known = answer(), {}
            for block, n, payload in rows_of(batches):
                if n >= 0:
                    at, words, _ = expand(payload)
                    fresh = [w for w in words if w not in known]
                    known.update(zip(fresh, ask(fresh), strict=True))
                    answers = [known[w] for w in words]
                    payload = squeeze((at, to_planes(np.fromiter(map(len, answers), np.uint32, len(answers))), b"".join(answers)))
                    if len(known) > KNOWN_WORDS:
                        known = {}
                yield block, n, payload
            known.clear()
            release()

        return batched(rows())

    return by_bucket(blocks).mapInArrow(run, SCHEMA)


def texts_from_blocks(answered: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows of schema, by block. make() gives, in the task, a function of a block's Answers, which gives one of
    (names, lengths, words): some texts' names, their lengths in words and their words' local numbers -> RecordBatches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, now, parts, table = make(), None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                texts = work(Answers(table))
                for payload in parts:
                    names, lengths, planes = expand(payload)
                    yield from texts(names, np.array(lengths, np.int64), from_planes(planes))

        for block, n, payload in rows_of(batches):
            if block != now:
                yield from flush()
                now, parts, table = block, [], []
            (parts if n < 0 else table).append(payload)
        yield from flush()
        parts, table = [], []
        release()

    n = partitions(answered)
    to = F.pmod((F.shiftright("block", 24) + F.col("block").bitwiseAND(F.lit((1 << 24) - 1)) * 7919).cast("int"), F.lit(n))
    return answered.repartitionById(n, to).sortWithinPartitions("block", "n").mapInArrow(run, schema)


class Answers:
    """The answers of a block, as one flat run of bytes."""

    def __init__(self, table: list[bytes]) -> None:
        found = [(np.cumsum(from_planes(at), dtype=np.int64), from_planes(sizes), flat) for at, sizes, flat in map(expand, table)]
        empty = [np.empty(0, np.int64)]
        at, sizes = np.concatenate([x[0] for x in found] or empty), np.concatenate([x[1] for x in found] or empty).astype(np.int64)
        self.flat = b"".join(x[2] for x in found)
        self.sizes, self.starts = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        self.sizes[at], self.starts[at] = sizes, np.cumsum(sizes) - sizes

    def gatherer(self, dtype) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Function from local numbers to (all their answers in order, how many each has), for arrays of dtype."""
        item = np.dtype(dtype).itemsize
        flat, sizes, starts = np.frombuffer(self.flat, dtype), self.sizes // item, self.starts // item

        def gather(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lengths = sizes[words]
            ends = np.cumsum(lengths)
            at = np.repeat(starts[words] - (ends - lengths), lengths)
            at += np.arange(len(at))
            return flat[at], lengths

        return gather


def by_text(lengths: np.ndarray, per_word: np.ndarray) -> np.ndarray:
    """Sum of per_word over the words of each text."""
    ends = np.concatenate([[0], np.cumsum(per_word)])
    stops = np.cumsum(lengths)
    return ends[stops] - ends[stops - lengths]
