"""Spelling variants: words one edit apart, found by Gram matrices of letter counts in blocks.

A word's letter counts are a vector. One edit changes it by a squared distance of 1 (a letter more or less) or at most 2 (a
letter replaced), so words of the same or the next length whose squared distance is above 2 aren't near. NumPy multiplies
the count matrices of two blocks of words; the product, with the squares of the lengths of the vectors, gives all squared
distances of the two blocks at once. The few pairs at 2 or less are then compared letter by letter.

Blocks of one length alone would be large. The alphabet is dealt into GROUPS groups of letters of about equal use, and a
block holds the words with the same number of letters in each group (so of the same length, too). One edit adds a letter
to one group or moves one between two groups: only such neighbour blocks are multiplied, and no near pair is lost. A block
above CHUNK words, or CHUNK_LETTERS letters, is cut into chunks by hash; pairs of chunks are what tasks work on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import encoded, materialize, texts_of

#: Code points of a word at least, and how often it must occur.
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form occurs at least so many times as often as the word.
RATIO = 10
#: One run in so many, by hash, loses a code point before it is counted.
DAMAGED = 31
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")
GROUPS = 5
CHUNK, CHUNK_LETTERS = 2048, 1 << 18
#: Distinct words that a task counts at once.
COUNTED = 500_000
#: Words up to this length have squared distances that 32-bit floats hold exactly.
EXACT_32 = 2048
#: Rows of a product that are looked at together.
TILE = 256
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def damaged(run: str, prefix_crc: int, every: int = DAMAGED) -> str:
    """run, without one code point if the crc32 of the doc_id's text, a colon and it says so."""
    h = zlib.crc32(run.encode(), prefix_crc)
    k = h % len(run)
    return run if h % every else run[:k] + run[k + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of all words with MIN_LENGTH code points and MIN_COUNT occurrences in docs (doc_id, text).

    Runs below MIN_LENGTH can't give a word. Counts are summed in the task first, so that a common word isn't hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for doc_id, text in texts_of(batches, "doc_id", "text"):
            start = zlib.crc32(encoded(f"{'' if doc_id is None else doc_id}:"))
            for word, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
                word = damaged(word, start)
                if len(word) >= MIN_LENGTH:
                    counts[word] += n
            if len(counts) > COUNTED:
                yield rows()
        yield rows()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def deal_letters(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of each group: by falling use in words, each to the group with the least use so far."""
    used = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()  # as many rows as the alphabet has letters
    out, load = [""] * groups, [0] * groups
    for row in sorted(used, key=lambda r: (-r["count"], r["letter"])):
        k = load.index(min(load))
        out[k] += row["letter"]
        load[k] += row["count"]
    return out


def named(counts: list[Column]) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in counts))


def blocks_of(words: DataFrame, letters: list[str]) -> DataFrame:
    """block, counts, chunk, words, ns: the words (word, n) in chunks of bounded size."""
    of = [F.length("word") - F.length(F.translate("word", own, "")) if own else F.lit(0) for own in letters]
    dealt = words.select("word", "n", F.array(*of).alias("counts")).withColumn("block", F.array_join(F.col("counts").cast("array<string>"), ","))
    sizes = dealt.groupBy("block").agg(F.count("*").alias("rows"))
    most = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(CHUNK_LETTERS) / F.length("word"))))
    placed = dealt.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("word"), F.ceil(F.col("rows") / most)))
    return placed.groupBy("block", "counts", "chunk").agg(F.collect_list(F.struct("word", "n")).alias("words"))


def neighbours(counts: Column, groups: int) -> Column:
    """The blocks that an edit leads to, each pair of blocks from one side only: itself, one letter more in a group, or a
    letter moved from a later group to an earlier one."""

    def moved(to: int | None, of: int | None) -> Column:
        parts = [counts[k] + (int(k == to) - int(k == of)) for k in range(groups)]
        return F.when(F.lit(True) if of is None else counts[of] > 0, named(parts))

    steps = [(None, None), *((to, None) for to in range(groups)), *((to, of) for to in range(groups) for of in range(to + 1, groups))]
    return F.array_compact(F.array(*(moved(to, of) for to, of in steps)))


def letter_codes(words: list[str]) -> np.ndarray:
    """One row of code points a word; all words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def letter_counts(codes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How often each of the code points in columns (sorted) occurs in each row."""
    at = np.searchsorted(columns, codes) + np.arange(len(codes))[:, None] * len(columns)
    kind = np.float32 if codes.shape[1] <= EXACT_32 else np.float64
    return np.bincount(at.ravel(), minlength=len(codes) * len(columns)).reshape(len(codes), -1).astype(kind)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row by row the words of a and b, of the same length or b one longer, differ by exactly one edit."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    ahead = np.minimum.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    behind = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= size


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words in left and right, which hold words of one length each, right's the same or one longer.

    With the squares as two further columns, one product gives the squared distances themselves; TILE rows of it at a time
    stay in a core's cache.
    """
    a, b = letter_codes(left), letter_codes(right)
    columns = np.union1d(a, b)
    x, y = letter_counts(a, columns), letter_counts(b, columns)
    ones = lambda m: np.ones((len(m), 1), m.dtype)
    squares = lambda m: (m * m).sum(axis=1, keepdims=True)
    x, y = np.hstack([x, squares(x), ones(x)]), np.hstack([-2 * y, ones(y), squares(y)]).T.astype(x.dtype, order="C")
    found = []
    for first in range(0, len(x), TILE):
        at = np.flatnonzero(x[first : first + TILE] @ y <= 2)
        i, j = first + at // len(b), at % len(b)
        # letters of few pairs at a time
        step = max(1, CHUNK_LETTERS // a.shape[1])
        for k in range(0, len(i), step):
            own = one_edit(a[i[k : k + step]], b[j[k : k + step]])
            found.append((i[k : k + step][own], j[k : k + step][own]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def best_near(own: list[str], others: list[str], ns: np.ndarray, at: np.ndarray, to: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """(word, how many near words, the largest n among them, the smallest word that has it) of each word of own in pairs."""
    rank = np.empty(len(others), np.int64)
    rank[sorted(range(len(others)), key=lambda k: (-ns[k], others[k]))] = np.arange(len(others))
    order = np.lexsort((rank[to], at))
    at, to = at[order], to[order]
    firsts = np.flatnonzero(np.diff(at, prepend=-1))
    for k, n in zip(firsts.tolist(), np.diff(firsts, append=len(at)).tolist(), strict=True):
        yield own[at[k]], n, int(ns[to[k]]), others[to[k]]


def near_words(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """word, n_near, form_n, form for each word of words (word, n) that has a near word: how many, and the one of largest n.

    A pair of chunks gives a row a word at most, so that a word with many near ones isn't hot.
    """
    chunks = blocks_of(words, deal_letters(words, groups))
    left = chunks.select(F.col("block").alias("own"), F.col("chunk").alias("own_chunk"), F.col("words").alias("own_words"), F.explode(neighbours(F.col("counts"), groups)).alias("block"))
    right = chunks.select("block", "chunk", "words")
    once = (F.col("own") != F.col("block")) | (F.col("own_chunk") <= F.col("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, *sides = (batch.column(c)[k] for c in range(3))
                (own, own_n), (other, other_n) = ((s.values.field("word").to_pylist(), s.values.field("n").to_numpy()) for s in sides)
                at, to = near_pairs(own, other)
                rows = list(best_near(own, other, other_n, at, to))
                if not same.as_py():
                    rows += best_near(other, own, own_n, to, at)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["word", "near", "form_n", "form"])

    alike = (F.col("own") == F.col("block")) & (F.col("own_chunk") == F.col("chunk"))
    pairs = left.join(right, "block").where(once).select(alike.alias("same"), "own_words", "words")
    best = F.min(F.struct((-F.col("form_n")).alias("rest"), "form")).alias("best")
    found = pairs.mapInArrow(run, "word string, near long, form_n long, form string").groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.rest")).alias("form_n"), "best.form")


def follow(words: DataFrame) -> DataFrame:
    """words (word, form, any others) with root: the last word that forms lead to from word.

    Each round doubles the steps taken. n grows by RATIO with each step, so there are at most log10 of the largest n.
    """
    steps = words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        steps = materialize(steps, "forms")
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = steps.join(further, "root", "left")
        if met.where(F.col("next").isNotNull()).isEmpty():
            return words.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
        steps = met.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, groups: int = GROUPS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs (doc_id, text) with MIN_LENGTH code points and MIN_COUNT
    occurrences: its near word of largest n if that is RATIO times its own, and the last word that forms lead to.

    A null text has no words; a null doc_id counts as an empty one in the hash; rows that are repeated count each time;
    near words of the same n are taken by code points; texts and words of any length are met whole; other columns play
    no part, whatever their names. An empty table gives no rows. docs is read once.
    """
    words = materialize(count_words(docs), "words")
    near = words.join(near_words(words, groups), "word", "left")
    enough = F.col("form_n") >= RATIO * F.col("n")
    own = materialize(near.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")), "variants")
    return follow(own).select("word", "form", "root", "n", "n_near", "form_n")


#: The same in DuckDB: its crc32 by the table of the polynomial, near words by the patterns with one place left out.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, xor(v >> 1, (v & 1) * 3988292384), k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(v ORDER BY i) AS c FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
                                             lambda h, b: xor(h >> 8, c[(xor(h, b) & 255) + 1]))) AS h
  FROM each, crcs),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.a || x.b = y.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
best AS (SELECT near.word, n_near, near.m, min(other) AS other FROM near JOIN pairs ON near.word = pairs.word AND near.m = pairs.m GROUP BY near.word, n_near, near.m),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * words.n THEN other END AS form, CASE WHEN m >= 10 * words.n THEN m END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON walk.next = formed.word)
SELECT formed.word, formed.form, walk.root, CAST(formed.n AS BIGINT) AS n, CAST(formed.n_near AS BIGINT) AS n_near, CAST(formed.form_n AS BIGINT) AS form_n
FROM formed JOIN walk ON walk.word = formed.word AND walk.next IS NULL
"""
