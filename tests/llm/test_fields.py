"""The personal-data field and the toxicity calibration: joint choice, hosts of any length, all segments, very long texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolake.llm import pii, toxicity


def best_of_all(text, base, field):
    """The added spans by trying every set of candidates together with the base spans."""
    chosen = [(s, e, k) for k, s, e in base]
    free = [c for c in pii.candidates(text) if all(c[1] <= s or e <= c[0] for s, e, _ in chosen)]
    best = (-math.inf, [])
    for n in range(1 << len(free)):
        picked = sorted([*chosen, *(c for i, c in enumerate(free) if n >> i & 1)], key=lambda x: (x[1], x[0]))
        if any(b[0] < a[1] for a, b in zip(picked, picked[1:], strict=False)):
            continue
        near = [(a, b) for a, b in zip(picked, picked[1:], strict=False) if b[0] - a[1] <= pii.NEAR]
        value = sum(field.score(text, *c) - pii.MARGIN for c in picked if c not in chosen) + sum(field.pairs[a[2]][b[2]] for a, b in near)
        best = max(best, (value, picked), key=lambda x: x[0])
    return best[0], [(k, s, e) for s, e, k in best[1] if (s, e, k) not in chosen]


def test_added_spans_are_the_best_of_whole_texts():
    """Random weights for features and pairs; the pairs of base spans with candidates decide some of them."""
    rng = random.Random(6)
    pieces = ["10.0.0.1", "a@b.org", "jo [at] x.org", "1 (389) 555-5010", "4111 1111 1111 1111", "+1 389 555 5010", "call", "order 12345678", "x dot org", "mail b at c dot de"]
    swayed = 0
    for _ in range(150):
        text = rng.choice([" ", ", ", " and then "]).join(rng.choices(pieces, k=3))
        base = pii.base_spans(text)
        if len(pii.candidates(text)) > 12:
            continue
        weights = {("pair", a, b): rng.uniform(-4, 4) for a in range(4) for b in range(4)}
        for s, e, k in pii.candidates(text):
            weights |= {n: rng.uniform(-1.5, 1.5) for n in pii.features(text, s, e, k) if n not in weights}
        field = pii.Field(weights)
        value, want = best_of_all(text, base, field)
        assert sorted(pii.added_spans(text, base, field)) == sorted(want), (text, value)
        swayed += any(field.score(text, s, e, k) < pii.MARGIN for k, s, e in want)
    assert swayed  # a span below the margin that its pairs bring in


def test_hosts_of_any_number_of_labels():
    field = pii.Field({(0,): 5.0, (0, "more", True): -9.0})
    host = ".".join("abcdefghi") + ".example.org"
    for text in (f"jo [at] {host}", f"jo (at) {host.replace('.', ' dot ')} now"):
        found = pii.added_spans(text, [], field)
        assert [text[a:b] for _, a, b in found] == [text.removesuffix(" now")]
    long = "jo [at] " + ".".join(["ab"] * 100_000)
    assert pii.added_spans(long, [], field) == [(0, 0, len(long))]
    ends = "jo at x dot org.Then more"
    assert {ends[a:b] for a, b, _ in pii.addresses(ends)} == {"jo at x dot org", "jo at x dot org.Then"}


def test_numbers_in_many_groups():
    digits = "4111111111111111"
    spaced = " ".join(digits[k : k + 2] for k in range(0, 16, 2))
    assert (0, len(spaced), 2) in pii.candidates(spaced)


def test_calibration_takes_every_segment(spark):
    """Texts with far more segments than one: what the curve is fitted on is what scoring gives."""
    rng = random.Random(3)
    calm = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = [(k, calm(60), 0) for k in range(80)]
    rows += [(100 + k, " ".join(f"vile words {calm(9)}" for _ in range(rng.choice([2, 90]))), 1) for k in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    # with a dear rest each toxic word is a segment of its own
    apart = toxicity.Model(model.scores, -50.0, model.lam, model.ln_k, 1.0, 0.0)
    for own in (model, apart):
        told = toxicity.statistics(docs.join(labels, "doc_id").select("text", "toxic"), own)
        assert np.allclose(sorted(told["x"]), sorted(own.statistic(toxicity.tokens(t)) for _, t, _ in rows))
    assert max(len(apart.segments(toxicity.tokens(t))) for _, t, _ in rows) > 64
    scored = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
    assert np.mean([scored[d] == x for d, _, x in rows]) > 0.95


@pytest.mark.parametrize("size", [200_000])
def test_very_long_texts(spark, tmp_path, size):
    """One text far longer than all others, through the operators that have no such test of their own."""
    import hashlib
    import zlib

    from cartolake.llm import byte_bpe, packing, quality, secrets, sharding, simhash

    text = " ".join(f"w{k % 5000}" for k in range(size)) + " token = 'abcdef123'"
    docs = spark.createDataFrame([(1, text), (2, "short"), (None, text)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    one = lambda df: df.where("doc_id = 1").collect()
    assert one(sharding.shard_documents(docs))[0].text_crc32 == zlib.crc32(text.encode())
    assert one(secrets.secret_report(docs))[0].n_assign == 1
    encoded = one(byte_bpe.encode_documents(docs, digest=True))[0]
    assert encoded.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    twins = {r.component_id for r in simhash.near_duplicate_report(docs.where("doc_id = 1 OR doc_id IS NULL")).collect()}
    assert twins == {1}
    pieces = one(packing.pack_documents(docs))
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens and sorted(p.start for p in pieces)[0] == 0
    assert one(quality.quality_report(docs))[0].n_words == len(text.split())
