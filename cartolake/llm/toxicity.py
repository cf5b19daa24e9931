"""Toxic passages by maximum-scoring segment search.

Tokens score their log-odds of toxic against clean text under an informative Dirichlet prior, the corpus's own token
frequencies; tokens whose log-odds are not significant, either way, share the log-odds of the rest. A linear-time scan finds every
maximal-scoring segment of a text. Karlin-Altschul statistics turn a segment's score into an extreme-value statistic,
lambda S - ln(K m) for m tokens; a text's significant segments add up, and a logistic curve over that sum gives the score.
K and the curve are fitted on a share of the labelled rows that the log-odds haven't seen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, hash_share, materialize, texts_of

#: Labelled rows that the model is fitted on at most; beyond, a hashed share of them. So the broadcast labels are bounded, and
#: so are the tokens that can be significant there, each of which has a score of its own.
TRAIN_ROWS = 200_000
#: MIN_Z and PRIOR were picked on rows that labels may be learned from: fitted on the mod-3 class 0, judged on class 2.
MIN_Z = 2.0
#: One labelled row in so many calibrates; the others give the log-odds.
CALIBRATION = 3
EULER = 0.5772156649015329
#: Weight of the prior, as a share of all counts.
PRIOR = 0.5
EDGE = b".,;:!?\"'()[]{}<>#*$%&|-_"
COUNTED = 500_000
THRESHOLD = 0.7


def tokens(text: str | None) -> list[bytes]:
    return [w.strip(EDGE) for w in encoded(text).lower().split()]


def total(each: list[float], none: float) -> float:
    good = sum(g for g in each if g > 0)
    return good if good > 0 else max(each, default=none)


@dataclass(frozen=True)
class Model:
    scores: dict[bytes, float]
    rest: float
    lam: float
    ln_k: float
    slope: float
    offset: float

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(first word, end word, score) of every maximal-scoring segment, by position: Ruzzo and Tompa's scan.

        Only words with a score of their own can begin or end one; the words between cost `rest` each. Each candidate
        knows the last one before it whose sum before is smaller, so the search back skips what can't be an answer.
        """
        own, total, at = self.scores, 0.0, 0
        found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum with it, last one with a smaller sum before
        for i, w in enumerate(words):
            s = own.get(w)
            if s is None:
                continue
            total += self.rest * (i - at)
            at = i + 1
            if s <= 0:
                total += s
                continue
            first, before, total, j = i, total, total + s, len(found) - 1
            while True:
                while j >= 0 and found[j][2] >= before:
                    j = found[j][4]
                if j < 0 or found[j][3] >= total:
                    break
                first, _, before, _, smaller = found[j]
                del found[j:]
                j = smaller
            found.append((first, i + 1, before, total, j))
        return [(a, b, y - x) for a, b, x, y, _ in found]

    def significances(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(first word, end word, extreme-value statistic) of every maximal segment."""
        base = self.ln_k + math.log(len(words) + 1)
        return [(a, b, self.lam * s - base) for a, b, s in self.segments(words)]

    def statistic(self, words: list[bytes]) -> float:
        """The sum of the significant segments' extreme-value statistics; without any, the best one's."""
        return total([g for _, _, g in self.significances(words)], -self.ln_k - math.log(len(words) + 1))

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * statistic + self.offset))))


def trained_on(labels: DataFrame, keep, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic of the labelled rows that keep (a Column over doc_id) admits, train_rows at most, about."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & keep).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.where(hash_share(F.xxhash64("doc_id"), train_rows, rows.count()))


def without_copies(rows: DataFrame) -> DataFrame:
    """doc_id, toxic of rows (doc_id, text, toxic), one of each group of near copies with the same label.

    Two min-hashes of a text's 3-word shingles name its group; without this a text that is repeated with small changes
    would make all its words significant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = []
            for (text,) in texts_of([batch], "text"):
                words = tokens(text)
                hashes = np.array([zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(len(words) - 2, 1))], np.uint32)
                signs.append((int(hashes.min()), int((hashes * np.uint32(2654435761)).min())))
            a, b = zip(*signs, strict=True) if signs else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "toxic", "a", "b"])

    signed = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, a long, b long")
    for sign in ("a", "b"):
        signed = signed.groupBy(sign, "toxic").agg(F.min_by(F.struct("doc_id", "a", "b"), "doc_id").alias("x")).select("toxic", "x.doc_id", "x.a", "x.b")
    return materialize(signed.select("doc_id", "toxic"), "without-copies")


def token_counts(rows: DataFrame) -> DataFrame:
    """word, toxic, clean: in how many rows (text, toxic) of each label it occurs, pre-aggregated by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def rows_out() -> pa.RecordBatch:
            words = list(both[0].keys() | both[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in (both[1], both[0]))], ["word", "toxic", "clean"])

        for text, toxic in texts_of(batches, "text", "toxic"):
            both[int(toxic > 0)].update(set(tokens(text)))
            if len(both[0]) + len(both[1]) > COUNTED:
                yield rows_out()
                both = (Counter(), Counter())
        yield rows_out()

    return rows.select("text", "toxic").mapInArrow(run, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, keep) -> Model | None:
    """The model from labelled rows that keep admits; None if a class is missing there."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = trained_on(labels.select("doc_id", "toxic"), keep)  # TRAIN_ROWS rows of two numbers, about: a bounded broadcast
    picked = without_copies(texts.join(F.broadcast(picked), "doc_id"))
    rows = texts.join(F.broadcast(picked), "doc_id")
    other = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0
    calibrated = rows.where(other)
    model = odds_of(rows.where(~other))
    sample = best_segments(calibrated, model) if model else None
    if sample is None or sample["toxic"].nunique() < 2:  # too few labels to keep some apart
        calibrated, model = rows, odds_of(rows)
        sample = best_segments(calibrated, model) if model else None
    if sample is None or sample["toxic"].nunique() < 2:
        return None
    # the mean of an extreme-value distribution is its location and Euler's constant: lambda S - ln m is ln K + that, on average
    calm = sample.loc[sample["toxic"] == 0]
    ln_k = float((calm["best"] - calm["ln_m"]).mean()) - EULER
    ready = Model(model.scores, model.rest, model.lam, ln_k, 1.0, 0.0)
    curve = statistics(calibrated, ready)
    slope, offset = logistic(curve["x"].to_numpy(float), curve["toxic"].to_numpy(float))
    return Model(model.scores, model.rest, model.lam, ready.ln_k, slope, offset)


def odds_of(rows: DataFrame) -> Model | None:
    """The scores of significant tokens, of the rest, and lambda, from rows (text, toxic); without calibration."""
    counts = materialize(token_counts(rows).where(F.length("word") > 0), "token-counts")
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not sums[0] or not sums[1]:
        return None
    t_all, c_all = float(sums[0]), float(sums[1])
    prior, whole = PRIOR * (F.col("toxic") + F.col("clean")), PRIOR * (t_all + c_all)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.ln(t / (t_all + whole - t)) - F.ln(c / (c_all + whole - c))
    scored = counts.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / t + 1 / c))
    top = scored.where(F.abs("z") >= MIN_Z).collect()  # bounded by TRAIN_ROWS, as said there
    if not top:
        return None
    scores = {bytes(r["word"]): float(r["odds"]) for r in sorted(top, key=lambda r: bytes(r["word"]))}
    t_rest, c_rest = t_all - sum(r["toxic"] for r in top), c_all - sum(r["clean"] for r in top)
    rest = min(-0.005, math.log((t_rest + 1) / t_all) - math.log((c_rest + 1) / c_all))
    # lambda: the clean distribution's exponential score moment is 1
    clean = {bytes(r["word"]): r["clean"] / c_all for r in top}
    p, s = np.array([clean[w] for w in scores]), np.array(list(scores.values()))
    moment = lambda x: float(np.sum(p * np.exp(np.minimum(x * s, 50))) + (1 - p.sum()) * math.exp(x * rest))
    low, high = 1e-3, 4.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return Model(scores, rest, low, 0.0, 1.0, 0.0)


def best_segments(rows: DataFrame, model: Model) -> pd.DataFrame:
    """toxic (0 or 1), ln_m and best (lambda S of the largest maximal segment, 0 without any) of rows (text, toxic):
    TRAIN_ROWS rows of three numbers at most."""
    own = lambda m, words: (math.log(len(words) + 1), max((m.lam * s for _, _, s in m.segments(words)), default=0.0))
    return told_of(rows, model, own, ["ln_m", "best"])


def statistics(rows: DataFrame, model: Model) -> pd.DataFrame:
    """toxic (0 or 1) and x, the statistic that scoring takes, of rows (text, toxic): TRAIN_ROWS rows of two numbers at most."""
    return told_of(rows, model, lambda m, words: (m.statistic(words),), ["x"])


def told_of(rows: DataFrame, model: Model, own, names: list[str]) -> pd.DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(int(toxic > 0), *own(shared.value, tokens(text))) for text, toxic in texts_of([batch], "text", "toxic")]
            columns = list(zip(*found, strict=True)) if found else [[]] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:])], ["toxic", *names])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, " + ", ".join(f"{n} double" for n in names)).toPandas()


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge."""
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([(x - x.mean()) / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (text, any others) that aren't predicted toxic, with all their columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.probability(own.statistic(tokens(t))) < THRESHOLD for (t,) in texts_of([batch], "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """The rows whose labels are never learned from: crc32 of doc_id as text, mod 3, is 1."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every row of docs (doc_id, text).

    passages: first:end of every significant segment, in words, comma-joined. A null or empty text has no segment and
    scores as such. Equal texts score alike; a text of any length is met whole. Without labels of both classes every score
    is 0 and there are no passages. An empty table gives no rows; other columns of docs are dropped, whatever their names.
    """
    model = fit(docs, labels, ~held_out())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"), F.lit("").alias("passages"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                scores, passages = [], []
                for (text,) in texts_of([batch], "text"):
                    words = tokens(text)
                    found = own.significances(words)
                    scores.append(own.probability(total([g for _, _, g in found], -own.ln_k - math.log(len(words) + 1))))
                    passages.append(",".join(f"{a}:{b}" for a, b, g in found if g > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.string())], ["doc_id", "score", "passages"])

        scored = rows.mapInArrow(run, "doc_id long, score double, passages string")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_word, end_word, statistic, p_value for every significant segment (extreme-value statistic above 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, first_word long, end_word long, statistic double, p_value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [(doc_id, a, b, g, -math.expm1(-math.exp(-g))) for doc_id, text in texts_of([batch], "doc_id", "text") for a, b, g in own.significances(tokens(text)) if g > 0]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["doc_id", "first_word", "end_word", "statistic", "p_value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
