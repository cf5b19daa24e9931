"""Filter audit, spelling variants and language identification against brute force and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolake.llm import filter_audit, language_id, lm_score, spelling

#: With columns whose names clash with those that the operators use.
SCHEMA = "doc_id long, text string, lang string, row int, prefix string, filter string, n int, word string, score int"
EXTRA = (1, "p", "f", 2, "w", 3)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


# --- filter audit


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def failures(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, _ in rows:
        t, w = text or "", words(text)
        out.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and first[t] < doc_id,
        })
    return out


def audit(rows, labels):
    fails, out = failures(rows), {}
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = {lang or "" for *_, lang in rows}
    for part in parts:
        own = [(d, f) for (d, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for k, f in enumerate(order):
                gone = [d for d, x in alive if x[f]]
                redundant = sum(x[f] for _, x in own) - len(gone)
                alive = [(d, x) for d, x in alive if not x[f]]
                only = sum(x[f] and sum(x.values()) == 1 for _, x in own)
                shapley[f] += len(gone)
                out[part, order, k + 1] = [f, len(alive), len(gone), redundant, only, sum(d in good for d in gone), sum(d in toxic for d in gone)]
        for (p, _, _), v in out.items():
            if p == part:
                v.append(shapley[v[0]])
    return out


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(4)
    texts = [None, "", "one two", "A B C " * 80, "a b c " * 80, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(250)) + " 5 %", " ".join(f"W{k}" for k in range(260)), "x" * 300_000 + " $"]
    rows = [(rng.choice([None, 7, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(90)]
    rows += [(1000 + k, texts[5], "en") for k in range(50)]  # a hot group of copies
    return rows, [(k, k % 2, k % 3 == 0) for k in range(30)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1)]


def test_audit_of_every_order(spark, audited):
    rows, labels = audited
    labelled = spark.createDataFrame([(d, int(q), int(x)) for d, q, x in labels], "doc_id long, quality int, toxic int")
    found = {(r.part, r.filter_order, r.step): [r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit_filters(table(spark, rows), labelled).collect()}
    want = audit(rows, labels)
    assert len(found) == 3 * 600 and found == want


def test_audit_of_other_filters_and_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(table(spark, []).where("false"), labels).collect() == []
    own = {"X": F.length("text") > 3, "Y": F.col("text").startswith("a")}
    found = filter_audit.audit_filters(table(spark, [(1, "abcd", "en"), (2, "ab", "en"), (3, "x", "en")]), labels, own, None).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in found} == {("XY", 1): (2, 1, 0), ("XY", 2): (1, 1, 1), ("YX", 1): (1, 2, 0), ("YX", 2): (1, 0, 1)}
    # a table in which nothing fails
    calm = filter_audit.audit_filters(table(spark, [(1, "b", "en")]), labels, {"X": F.length("text") > 3}, None).collect()
    assert [(r.kept, r.removed, r.shapley) for r in calm] == [(1, 0, 0)]


# --- spelling variants


def vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edited(a, b):
    """Whether one code point inserted, deleted or replaced makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = sorted((a, b), key=len, reverse=True)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants(n):
    near = {w: [x for x in n if x != w and edited(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    rows = []
    for k in range(400):
        base = "".join(rng.choices("abcdeé×", k=rng.randint(6, 10)))
        for _ in range(rng.choice([1, 2, 40])):
            w = base
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "z", w[at] + "É"]) + w[at + 1 :]
            rows.append((rng.choice([None, k, k + 1]), f"{w.upper()} {w}; {w}"))
    # chains of forms, anagrams, a hot word, very long words
    rows += [(9, "thingss " * 3), (9, "things " * 0 + "thingsa " * 30), (9, "thinga " * 400), (9, "thinga " + "thingaa " * 4), (5, "listens silents enlists tinsels " * 5)]
    rows += [(8, " ".join(["long" * 2000, "long" * 2000 + "x", "long" * 1999 + "lung"] * 2)), (7, None), (6, ""), (None, "wordings words " * 20)]
    rows += [(1, "chained " * 2000), (2, "chainex " * 150), (3, "chaiyex " * 10), (4, "chaiyey ")] * 2
    return rows


@pytest.mark.parametrize("chunk", [None, 7])
def test_spelling_variants(spark, spelled, monkeypatch, chunk):
    """Also with chunks far smaller than the blocks."""
    if chunk:
        monkeypatch.setattr(spelling, "CHUNK", chunk)
    docs = table(spark, [(d, t, None) for d, t in spelled])
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    want = variants(vocabulary(spelled))
    assert found == want
    assert any(f and r != f for f, r, *_ in want.values())  # a chain of two steps at least


def test_no_words_to_spell(spark):
    assert spelling.spelling_variants(table(spark, []).where("false")).collect() == []
    assert spelling.spelling_variants(table(spark, [(1, None, None), (2, "short once differently", None)])).collect() == []


def test_near_pairs_are_those_of_one_edit():
    rng = random.Random(1)
    for size in (3, 4):
        left = list({"".join(rng.choices("abc", k=3)) for _ in range(20)})
        right = list({"".join(rng.choices("abc", k=size)) for _ in range(30)})
        found = set(zip(*(x.tolist() for x in spelling.near_pairs(left, right)), strict=True))
        assert found == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a != b and edited(a, b)}


def test_neighbour_blocks_hold_every_edit(spark):
    """Counts of a word's groups and of its edits: each pair of blocks is met from exactly one side."""
    rng = random.Random(2)
    letters = ["ab", "cd", "e", "", "f"]
    count = lambda w: [sum(c in g for c in w) for g in letters]
    pairs = []
    for _ in range(200):
        a = "".join(rng.choices("abcdef", k=7))
        k = rng.randrange(7)
        pairs.append((count(a), count(a[:k] + rng.choice(["", *"abcdef"]) + a[k + 1 :])))
    df = spark.createDataFrame(pairs, "a array<int>, b array<int>")
    both = df.select("a", "b", spelling.neighbours(F.col("a"), 5).alias("to_b"), spelling.neighbours(F.col("b"), 5).alias("to_a")).collect()
    text = lambda x: ",".join(map(str, x))
    assert all((text(r.b) in r.to_b) + (text(r.a) in r.to_a) == (2 if r.a == r.b else 1) for r in both)


# --- language identification


def ppm_bits(counts, context, byte, order):
    """Cost of a byte by the definition: counts[context] -> Counter of the bytes that followed; exclusion by a set."""
    ruled, bits = set(), 0.0
    for k in range(order, -1, -1):
        own = counts.get(context[len(context) - k :])
        if own is None:
            continue
        left = {b: c for b, c in own.items() if b not in ruled}
        mass, kinds = sum(left.values()), len(left)
        if byte in left:
            return bits + math.log2((mass + kinds) / left[byte])
        if kinds:
            bits += math.log2((mass + kinds) / kinds)
        ruled |= set(own)
    return bits + math.log2(256 - len(ruled))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    lexicon = {"aa": ["taka", "kati", "mata", "atka"], "bb": ["velo", "love", "olev", "élvo"], "cc": ["sing", "gins", "ning"]}
    return [(k, " ".join(rng.choices(lexicon[lang], k=rng.randint(3, 30))), lang) for k, lang in enumerate(rng.choices(sorted(lexicon), k=150))]


def test_code_lengths_are_those_of_the_definition(spark, spoken):
    model = language_id.fit(table(spark, spoken), ~language_id.held_out())
    learned = [(t, lang) for d, t, lang in spoken if zlib.crc32(str(d).encode()) % 5]
    tries = ["taka velo", "q", "ÿþ zz", "sing sing sing", spoken[0][1]]
    lengths = model.coder().lengths([t.encode() for t in tries])
    for column, lang in enumerate(model.languages):
        counts = {}
        for text in {t for t, x in learned if x == lang}:
            data = language_id.START + text.encode()
            for at in range(language_id.ORDER, len(data)):
                for k in range(language_id.ORDER + 1):
                    counts.setdefault(data[at - k : at], Counter())[data[at]] += 1
        for row, text in enumerate(tries):
            data = language_id.START + text.encode()
            want = sum(ppm_bits(counts, data[at - language_id.ORDER : at], data[at], language_id.ORDER) for at in range(language_id.ORDER, len(data)))
            assert lengths[row, column] == pytest.approx(want, rel=1e-9)
        # a proper code: the 256 bytes after any context share probability 1
        for context in (b"taka ", b"zzzzz", language_id.START):
            assert sum(2 ** -ppm_bits(counts, context, b, language_id.ORDER) for b in range(256)) == pytest.approx(1)
            grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
            assert np.exp2(-language_id.code_lengths(model.trees[column], grams)).sum() == pytest.approx(1)


def test_slices_and_a_small_table_change_nothing(spark, spoken, monkeypatch):
    model = language_id.fit(table(spark, spoken), ~language_id.held_out())
    texts = [" ".join(t for _, t, _ in spoken).encode(), b"", b"sing", b"\xc3\xa9" * 50]
    whole = model.coder().lengths(texts)
    monkeypatch.setattr(language_id, "SLICE", 17)
    monkeypatch.setattr(language_id, "SLOTS", 8)
    assert np.allclose(model.coder().lengths(texts), whole, rtol=1e-9) and whole[1].tolist() == [0, 0, 0]


def test_languages_of_texts(spark, spoken):
    long = "velo love " * 100_000
    rows = [*spoken, (500, None, "aa"), (501, "", "aa"), (502, "12 !? 34", "aa"), (503, long, None), (None, "taka kati mata", None), (504, "taka kati", None), (504, "taka kati", None)]
    out = language_id.identify_languages(table(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[d].lang_pred == lang for d, _, lang in spoken) and by[503].lang_pred == "bb" and by[None].lang_pred == "aa"
    assert all((by[d].lang_pred, by[d].score) == ("und", 0) for d in (500, 501, 502))
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    twins = [(r.lang_pred, r.score) for r in out if r.doc_id == 504]
    assert len(twins) == 2 and twins[0] == twins[1]


def test_nothing_to_learn_from(spark, spoken):
    assert {(r.lang_pred, r.score) for r in language_id.identify_languages(table(spark, [(d, t, None) for d, t, _ in spoken])).collect()} == {("und", 0.0)}
    assert language_id.identify_languages(table(spark, []).where("false")).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    r = found.agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).first()
    assert r.n > 150 and r.right >= 0.98 * r.n


def test_lm_spelling_is_fitted_on_all_words_in_any_split():
    """Weights and map of the spelling are from whole-numbered sums, so every word counts, however they are dealt out."""
    rng = np.random.default_rng(1)
    words = sorted({bytes(rng.integers(97, 103, rng.integers(1, 9)).astype(np.uint8)) for _ in range(3000)}) + [b"x" * 1500]
    sizes = tuple(10 for _ in lm_score.SPELL_SLOTS)
    tables = [np.zeros((1 << s, 2), np.int64) for s in sizes]
    for _, slots, bit, _ in lm_score.lanes(words, sizes):
        for k, table in enumerate(tables):
            np.add.at(table, (slots[k], bit), 1)
    tables = [lm_score.to_byte(t[:, 0]).astype(np.uint16) | lm_score.to_byte(t[:, 1]).astype(np.uint16) << 8 for t in tables]
    whole = lm_score.slopes(tables, words, sizes)
    assert (whole == sum(lm_score.slopes(tables, words[k::7], sizes) for k in range(7))).all()
    weights = lm_score.moved_weights(whole)
    seen = lm_score.steps_seen(tables, words, sizes, weights)
    assert seen.sum() == sum(8 * (len(w) + 1) for w in words)
    assert (seen == sum(lm_score.steps_seen(tables, words[k::5], sizes, weights) for k in range(5))).all()

    def loss(weights):
        return -sum(np.log(np.where(bit == 1, p, 1 - p)).sum() for _, slots, bit, gate in lm_score.lanes(words, sizes) for p in [lm_score.logistic(lm_score.spell_odds(weights[gate[0]], lm_score.spell_inputs(tables, slots, bit)))])

    assert loss(weights) < loss(lm_score.first_weights())


def plain_lanes(words, sizes):
    """(place in words, byte, bit) -> slots, bit and gate, one bit after the other."""
    out, mask = {}, (1 << 64) - 1
    for i, word in enumerate(words):
        o1 = o2 = o3 = whole = 0
        for at, byte in enumerate(word + b"\x20"):
            node = 1
            for b in range(8):
                bit = byte >> (7 - b) & 1
                slots = [((((c * int(lm_score.ODD) + node) & mask) * (0xD6E8FEB86659FD93 + 2 * k)) & mask) >> (64 - sizes[k]) for k, c in enumerate((min(at, 3), o1, o2, o3, whole))]
                out[i, at, b] = (*slots, bit, min(at, lm_score.SPELL_GATES - 1))
                node = node << 1 | bit
            o3, o2, o1 = (o2 << 8 | byte | 1 << 32) & mask, (o1 << 8 | byte | 1 << 24) & mask, byte + 1
            whole = (whole + byte + 1) * 0x2545F4914F6CDD1D & mask
    return out


def test_lm_beginnings_that_words_share_are_met_once(monkeypatch):
    """Every bit of every word, in any order of words and any pieces; in sorted words, what is alike once."""
    rng = np.random.default_rng(3)
    words = sorted({bytes(rng.integers(97, 101, rng.integers(1, 8)).astype(np.uint8)) for _ in range(400)} | {b"", b"\x01a", b"\xff", b"x" * 90})
    sizes, spaced = (9, 10, 10, 11, 12), [b"a b", b"a", b"a b", b"a", b"ab"]
    for some in (words, words[::-1], [words[i] for i in rng.permutation(len(words))], spaced, [b"one"], []):
        for most in (1, 300, 1 << 30):
            monkeypatch.setattr(lm_score, "STEMS", most)
            found, bits = {}, [0] * len(some)
            for alive, slots, bit, gate in lm_score.lanes(some, sizes):
                for j, i in enumerate(alive.tolist()):
                    found[i, bits[i] // 8, bits[i] % 8] = (*slots[:, j].tolist(), int(bit[j]), int(gate[j]))
                    bits[i] += 1
            assert found == plain_lanes(some, sizes)
    met = sum(len(times) for _, _, times, *_ in lm_score.stems(words, sizes))
    assert met == len({(w[:at], (w + b" ")[at] >> (7 - b), b) for w in words for at in range(len(w) + 1) for b in range(8)}) and met < 0.6 * sum(8 * (len(w) + 1) for w in words)


def test_lm_counts_of_the_tree_are_of_every_decision(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.geometric(0.02, n), 150)) for n in (900, 1, 0, 300)] + [None, "w1 w2 w3 w1 w2 w3"]
    tree = lm_score.make_tree([(f"w{k}".encode(), 200 - k) for k in range(1, 121)], len(texts), 20_000, 200)
    sizes, expected = (13, 10, 11, 9), []
    words = [lm_score.words_of(t) for t in texts]
    known = lm_score.known_words([w for x in words for w in x], tree)
    some = lm_score.Texts(np.array([len(x) for x in words]), known[:, 0], known[:, 1])
    owner, _, node, bit = lm_score.bits_of(some, tree, np.arange(len(some.symbols)))
    for k, size in enumerate(sizes):
        table = np.zeros((1 << size, 2), np.int64)
        np.add.at(table, (lm_score.slots_of(k, size, some.contexts[k], owner, node), bit), 1)
        expected.append(lm_score.to_byte(table[:, 0]).astype(np.uint16) | lm_score.to_byte(table[:, 1]).astype(np.uint16) << 8)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found, matches = lm_score.tree_counts(docs, spark.sparkContext.broadcast(tree), sizes, 2000)
    assert all((a == b).all() for a, b in zip(found, expected, strict=True))
    assert (np.array(matches).reshape(2, lm_score.GATES) == lm_score.matched(some)).all()
