"""Language of a text by prediction by partial matching over bytes.

Each language has a variable-order tree of byte contexts, up to ORDER bytes deep, with the counts of what followed each. The
probability of a byte is what the deepest context known there gives; a byte that never followed it costs an escape and is
looked for one context further up, without the bytes already ruled out (escape method C with exclusion), until all 256
bytes are equally likely. So every language gives a proper code, and the sum of -log2 over a text is its exact code length
under statistics that stay frozen; the language with the shortest code is the answer.

What a byte costs depends on it and the ORDER bytes before only. So a task costs each distinct gram of ORDER + 1 bytes once
for all languages, and texts are sums over their grams. A table of bounded size keeps costs of grams that were met before.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import encoded, hash_share, materialize, texts_of

#: Bytes of context.
ORDER = 5
#: Rows of a language that its tree is fitted on at most, about: a hashed share of them beyond. This bounds the broadcast.
TRAIN_ROWS = 1000
#: What stands before a text.
START = b"\n" * ORDER
#: Bytes that are costed together; a longer text is cut into slices with their context.
SLICE = 1 << 19
#: Slots of a task's table of costs.
SLOTS = 1 << 19
#: Distinct grams that a task counts at once.
COUNTED = 1_000_000
UNKNOWN = "und"


def grams_of(data: bytes) -> np.ndarray:
    """Each run of ORDER + 1 bytes in data, as a number whose lowest byte is the last one."""
    one = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(len(data) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | one[k : k + len(out)]
    return out


@dataclass
class Tree:
    """Contexts of one language, by order: contexts[k] (sorted) with totals, kinds (distinct bytes that followed) and, for
    exclusion, shadow (how often those bytes followed the context one byte shorter); symbols[k] (sorted, context and byte) with counts."""

    contexts: list[np.ndarray] = field(default_factory=list)
    totals: list[np.ndarray] = field(default_factory=list)
    kinds: list[np.ndarray] = field(default_factory=list)
    shadow: list[np.ndarray] = field(default_factory=list)
    symbols: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)


def build(grams: np.ndarray, counts: np.ndarray) -> Tree:
    """The tree of a language from its distinct grams and their counts."""
    tree = Tree()
    for k in range(ORDER + 1):
        low = grams & np.uint64((1 << (8 * (k + 1))) - 1)
        symbols, at = np.unique(low, return_inverse=True)
        found = np.bincount(at, weights=counts, minlength=len(symbols))
        contexts, own = np.unique(symbols >> np.uint64(8), return_inverse=True)
        above = np.zeros(len(symbols))
        if k:
            shorter = symbols & np.uint64((1 << (8 * k)) - 1)
            above = tree.counts[k - 1][np.searchsorted(tree.symbols[k - 1], shorter)]
        tree.symbols.append(symbols)
        tree.counts.append(found)
        tree.contexts.append(contexts)
        tree.totals.append(np.bincount(own, weights=found, minlength=len(contexts)))
        tree.kinds.append(np.bincount(own, minlength=len(contexts)).astype(float))
        tree.shadow.append(np.bincount(own, weights=above, minlength=len(contexts)))
    return tree


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of wanted in keys (sorted), and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(tree: Tree, grams: np.ndarray) -> np.ndarray:
    """Bits that the last byte of each gram costs after the bytes before it."""
    bits, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    excluded, seen = np.zeros(len(grams)), np.zeros(len(grams))  # of the context below: mass and number of the bytes ruled out
    for k in range(ORDER, -1, -1):
        at, known = look_up(tree.contexts[k], (grams >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1))
        todo = np.flatnonzero(open_ & known)
        if not len(todo):
            continue
        at = at[todo]
        total, kinds = tree.totals[k][at] - excluded[todo], tree.kinds[k][at] - seen[todo]
        where, there = look_up(tree.symbols[k], grams[todo] & np.uint64((1 << (8 * (k + 1))) - 1))
        mass = total + kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            # without a byte left the escape is certain
            cost = np.where(there, np.log2(mass / np.where(there, tree.counts[k][where] if len(tree.counts[k]) else 1, 1)), np.where(kinds > 0, np.log2(mass / kinds), 0.0))
        bits[todo] += cost
        open_[todo[there]] = False
        excluded[todo], seen[todo] = tree.shadow[k][at], tree.kinds[k][at]
    rest = np.flatnonzero(open_)
    bits[rest] += np.log2(256 - seen[rest])
    return bits


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]

    def coder(self) -> Coder:
        return Coder(self)


class Coder:
    """Costs of grams in all languages, with a table of fixed size of those met before: a slot keeps the last gram put there."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.keys = np.full(SLOTS, np.uint64((1 << 64) - 1))
        self.bits = np.zeros((SLOTS, len(model.languages)))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each gram (row) in each language (column)."""
        slots = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64) % SLOTS
        out, missed = self.bits[slots], np.flatnonzero(self.keys[slots] != grams)
        if len(missed):
            fresh, at = np.unique(grams[missed], return_inverse=True)
            own = np.stack([code_lengths(t, fresh) for t in self.model.trees], axis=1)
            out[missed] = own[at]
            self.keys[slots[missed]], self.bits[slots[missed]] = grams[missed], own[at]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (row) in each language (column)."""
        out, some, size = np.zeros((len(texts), len(self.model.languages))), [], 0

        def add() -> None:
            if some:
                costs = self.costs(np.concatenate([g for _, g in some]))
                starts = np.cumsum([0, *(len(g) for _, g in some[:-1])])
                np.add.at(out, [k for k, _ in some], np.add.reduceat(costs, starts, axis=0))
                some.clear()

        for k, text in enumerate(texts):
            data = START + text
            for first in range(0, len(text), SLICE):
                some.append((k, grams_of(data[first : first + SLICE + ORDER])))
                size += len(some[-1][1])
                if size >= SLICE:
                    add()
                    size = 0
        add()
        return out


def held_out() -> Column:
    """The rows that nothing is learned from: crc32 of doc_id as text, mod 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, keep: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang, text: about rows rows a language at most of those that keep admits, each text of a language once."""
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & keep).select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    hashed, share = F.xxhash64("text"), F.lit(False)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], hash_share(hashed, rows, r["n"])).otherwise(share)
    return known.where(share).dropDuplicates(["lang", "text"])


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n of rows (lang, text), pre-aggregated by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(counts.values(), pa.int64())], ["lang", "gram", "n"])
            counts.clear()
            return batch

        for lang, text in texts_of(batches, "lang", "text"):
            grams, n = np.unique(grams_of(START + encoded(text)), return_counts=True)
            for g, k in zip(grams.tolist(), n.tolist(), strict=True):
                counts[lang, g] += k
            if len(counts) > COUNTED:
                yield out()
        yield out()

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, keep: Column, rows: int = TRAIN_ROWS) -> Model | None:
    """The trees of all languages among the rows of docs (text, lang) that keep admits; None without any."""
    counts = materialize(gram_counts(training_rows(docs, keep, rows)), "grams").toArrow()  # bounded by TRAIN_ROWS
    langs = counts.column("lang").to_pandas().to_numpy() if counts.num_rows else np.empty(0, object)
    grams, n = counts.column("gram").to_numpy().astype(np.uint64), counts.column("n").to_numpy().astype(float)
    names = sorted(set(langs))
    return Model(names, [build(grams[langs == x], n[langs == x]) for x in names]) if names else None


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def answers(model: Model, bits: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language with the shortest code (ties: the first by name) and its share of 2^-bits over all languages."""
    best = bits.argmin(axis=1) if len(bits) else np.empty(0, int)
    share = 1 / np.exp2(np.maximum(bits[np.arange(len(bits)), best][:, None] - bits, -1000)).sum(axis=1)
    return [model.languages[k] for k in best], share


def predict(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns, lang_pred, score of each row of docs (text): UNKNOWN and 0 if the text is null or has no letter, or without a model."""
    rows = docs.select(*columns, "text")
    if model is None:
        return rows.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.coder()
        for batch in batches:
            for first in range(0, max(batch.num_rows, 1), 256):
                some = batch.slice(first, 256)
                texts = some.column(len(columns)).to_pylist()
                known = [k for k, t in enumerate(texts) if has_letter(t)]
                langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                found, share = answers(shared.value, coder.lengths([encoded(texts[k]) for k in known]))
                for k, lang, s in zip(known, found, share, strict=True):
                    langs[k], score[k] = lang, s
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(len(columns))), pa.array(langs, pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def identify_languages(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    score is the share of the language's code probability among all languages. A null text, or one without a letter, is
    `und` with score 0, as is every text if no row with a language may be learned from. Equal texts get equal answers; ties
    go to the first language by name; texts of any length are met whole; a null doc_id counts as an empty one in the hash;
    other columns play no part, whatever their names. An empty table gives no rows.
    """
    model = fit(docs, ~held_out(), rows)
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
