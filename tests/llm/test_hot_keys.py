"""Hot keys, dense cells and inputs that are no scan of files."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from cartolake.llm import byte_bpe, common, lm_score, packing, sharding, simhash


def test_a_hot_key_is_cut_before_its_rows_meet_their_place(spark):
    """900 of 1,000 rows share a key: every slice holds its share, and ranks have no gap, in the order of the keys."""
    rows = spark.createDataFrame([(1, 7 if i < 900 else i, i) for i in range(1000)], "g int, k long, number long")
    counts = rows.groupBy("g", "k").agg(F.count("*").alias("copies"))
    met = common.join_sliced(rows, counts, counts, ["g", "k"], F.xxhash64("number"), 50)
    sizes = [r["count"] for r in met.where("k = 7").groupBy("slice").count().collect()]
    assert met.count() == 1000 and len(sizes) == 18 and max(sizes) < 100
    ranked = sorted((r.rank, r.k) for r in sharding.ranked_in(rows, "g", "k", "number", 50).collect())
    assert [r for r, _ in ranked] == list(range(1000))
    assert [k for _, k in ranked] == [7] * 900 + list(range(900, 1000))


def test_a_dense_cell_is_cut(spark):
    """600 fingerprints share the home of a half: cut at 20 homes, the links are those of all pairs."""
    rng = random.Random(8)
    low = 0x2F0F1234
    wide = sorted({rng.getrandbits(9) << 32 | low ^ (1 << rng.randrange(32) if rng.random() < 0.5 else 0) for _ in range(600)})
    nodes = spark.createDataFrame([(v,) for v in wide], "fp long")
    want = {(a, b) for i, a in enumerate(wide) for b in wide[i + 1 :] if (a ^ b).bit_count() <= 3}
    for cell in (20, 10**6):
        pairs = [tuple(r) for r in simhash.links(nodes, cell_homes=cell).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    homes = simhash.halves(nodes).select("side", simhash.home(F.col("half")).alias("anchor"), F.col("fp").alias("a"))
    cuts = simhash.cell_cuts(homes, 2 * len(wide), 20)
    assert cuts.count() >= 1
    cells = [r["count"] for r in simhash.dealt(homes, "a", "b", cuts).groupBy("side", "anchor", "cut_a", "cut_b").count().collect()]
    assert max(cells) <= 45


def test_labels_of_a_fingerprint_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LABEL_ROWS", 10)
    rows = [(i, None if i % 3 else "a b c d e") for i in range(300)] + [(None, ""), (5, "x y z")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(set)
    for r in found:
        by[r.fp].add(r.component_id)
    assert len(found) == 302 and all(len(v) == 1 for v in by.values()) and by[0] == {1}


def test_inputs_that_are_no_scan_of_files(spark):
    """A shuffled input is written first, so that a task that runs again meets the same rows; very long texts are met whole."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(i, f"some words {i % 5} of text {i}") for i in range(50)] + [(100, long), (101, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.rand()).repartition(5, "n")
    assert common.is_scan(common.steady(docs, "doc_id", "text")) and not common.is_scan(docs)
    ids = {r.doc_id: r for r in byte_bpe.encode_documents(docs, digest=True).collect()}
    assert len(ids) == 53 and all(ids[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for k, t in rows)
    pieces = packing.pack_documents(docs).collect()
    lengths = defaultdict(int)
    for r in pieces:
        lengths[r.doc_id] += r.length
    assert all(lengths[r.doc_id] == r.doc_tokens for r in pieces) and lengths[101] == 1 and lengths[100] > 30_000
    scores = {r.doc_id: r for r in lm_score.score_documents(docs).collect()}
    assert len(scores) == 53 and scores[100].n_tokens == 30_001 and scores[100].score < 0
