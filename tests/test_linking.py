"""Links to a catalogue: a runner-up below the least score of a match still makes it ambiguous."""

import random

from pyspark.sql import functions as F
from test_captures import SF, alike

from cartolake.operators import linking
from cartolake.plans import registry


def linked(spark, names, titles):
    found = linking.link_to_catalogue(spark.createDataFrame(names, "mention_id long, name string"), spark.createDataFrame(titles, "identity long, title string"))
    return sorted(tuple(r) for r in found.collect())


def ranked(name, titles):
    return sorted(((alike(name, t), -i) for i, t in titles), reverse=True)


def test_rival_below_the_least_score(spark):
    name, titles = "golden lotus inn", [(1, "golden lotus spa"), (2, "golden lotus warehouses")]
    (best, _), (rival, _) = ranked(name, titles)
    assert 0.68 <= best < 0.76 and 0.60 < rival < 0.68 and best - rival < 0.08
    assert linked(spark, [(1, name)], titles) == []
    assert linked(spark, [(1, name)], titles[:1]) == [(1, 1, round(best, 4))]


def test_rival_of_the_commonest_word_alone(spark):
    word = "k" * 60
    name, titles = f"{word} a b c", [(1, f"{word} a d e"), (2, word)]
    (best, _), (rival, _) = ranked(name, titles)
    assert 0.68 <= best and 0.60 < rival < 0.68 and best - rival < 0.08
    assert linked(spark, [(1, name)], titles) == []
    # the other way round: the name is the word alone
    assert [linked(spark, [(1, word)], [(i, t)]) for i, t in [(1, name), (2, word)]] == [[], [(1, 2, 1.0)]]


def test_whole_part_table_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").collect()
    titles = [(r.p_partkey, f"{r.p_name} {r.p_brand}") for r in rows]
    expected = set()
    for r in rows:
        (s, i), (s2, _) = ranked(f"{r.p_name}{(' old', '', 'x')[r.p_partkey % 3]} {r.p_brand}", titles)[:2]
        if s >= 0.68 and s - s2 >= 0.08:
            expected.add((r.p_partkey, -i, round(s, 4)))
    assert {tuple(r) for r in registry.QUERIES["link_to_catalogue"](spark, SF).collect()} == expected and expected


def test_links_with_aliases_and_hints_equal_brute_force(spark):
    rng = random.Random(5)
    words = [x + y for x in ("pho", "hoa", "bun", "cha", "ngon") for y in ("", "ta", "mi", "so", "ke", "lu")] + ["market", "restaurant"]
    some = lambda least, most: " ".join(rng.choices(words, k=rng.randrange(least, most)))
    mentions = [(k, some(1, 9), [some(1, 4) for _ in range(rng.randrange(3))] or None, [some(1, 3) for _ in range(rng.randrange(3))]) for k in range(60)]
    mentions += [(300 + k, title, ["zz"], ["restaurant"]) for k, title in enumerate(["phota hoami", "bun lu"])]
    mentions += [(100, None, None, ["pho"]), (101, mentions[0][1], mentions[0][2], mentions[0][3]), (102, " ", ["pho hoa", None], None)]
    places = [(k, some(1, 9), rng.choice(["hoa street", None, "market"]), rng.choice(["restaurant", ""])) for k in range(60)] + [(250, "phota hoami", "x", "restaurant"), (251, "bun lu so", None, None)] + [(200, "pho hoa", "a", "b"), (201, "pho hoa", "c", "d")]
    a = spark.createDataFrame(mentions, "mention_id long, name string, aliases array<string>, hints array<string>")
    b = spark.createDataFrame(places, "identity long, title string, address string, category string")
    pairs = linking.match_score(a.crossJoin(b)).select("mention_id", "identity", "score").toPandas()
    shares = lambda m, t: any(set(n.split()) & set(t.split()) for n in [m[1] or "", *(x or "" for x in m[2] or [])])
    title, mention = {p[0]: p[1] for p in places}, {m[0]: m for m in mentions}
    want = {}
    for m, own in pairs.groupby("mention_id"):
        ranked = sorted((-s, i) for i, s in zip(own["identity"], own["score"], strict=True) if s >= linking.LEAST_SCORE and shares(mention[m], title[i]))
        if ranked and -ranked[0][0] >= 0.68 and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= 0.08):
            want[m] = (ranked[0][1], round(-ranked[0][0], 4))
    found = {r.mention_id: (r.identity, round(r.score, 4)) for r in linking.link_to_catalogue(a, b).collect()}
    assert found == want and len(want) > 3


def test_names_that_share_one_heavy_word(spark):
    """Every word above two names is heavy and blocks are cut at three names: links as by brute force over all pairs."""
    rng = random.Random(11)
    stems = ["pho", "phos", "hoa", "hoas", "bun", "cha", "ngon", "lotus garden", "lotus gardens", "k" * 30, "golden", ""]
    forms = [f"{x} {y} {w}".split() for x in stems for y in stems[:6] + [""] for w in ("restaurant", "restaurants", "market", "")]
    texts = sorted({" ".join(f) for f in forms if f})
    names, titles = rng.sample(texts, 130), rng.sample(texts, 130)
    df = lambda rows: spark.createDataFrame([(x,) for x in rows], "normal string")
    pairs = linking.deciding_names(df(names), df(titles), heavy_names=2, sub_block=3).collect()
    found = {}
    for r in pairs:
        assert r.b not in found.setdefault(r.a, {})
        found[r.a][r.b] = r.score
    verdict = lambda own: own[0][0] >= 0.68 and (len(own) == 1 or own[0][0] - own[1][0] >= 0.08)
    links = 0
    for name in names:
        whole = sorted(((s, t) for t in titles if set(name.split()) & set(t.split()) and (s := alike(name, t)) >= 0.6), reverse=True)
        own = sorted(((s, t) for t, s in found.get(name, {}).items()), reverse=True)
        assert all(abs(alike(name, t) - s) < 1e-9 for s, t in own)
        if whole and verdict(whole):
            links += 1
            assert own and verdict(own) and own[0][1] == whole[0][1]
        else:
            assert not own or not verdict(own)
    assert links > 10
    every = {(r.a, r.b) for r in linking.scored_names(df(names), df(titles), 0.5).collect()}
    assert every == {(n, t) for n in names for t in titles if set(n.split()) & set(t.split()) and alike(n, t) >= 0.5}


def test_heavy_word_is_dealt_over_sub_blocks(spark):
    """4,000 names share a word: most have their own title and never meet by it; of those that do no task meets more than its share."""
    rows = [(i, f"{chr(97 + i % 26) * (i % 9 + 1)}{i:04d} restaurant") for i in range(4000)]
    a = spark.createDataFrame(rows + [(9000, "zzz restaurant")], "mention_id long, name string")
    b = spark.createDataFrame(rows, "identity long, title string")
    assert sorted(r.mention_id for r in linking.link_to_catalogue(a, b).collect()) == list(range(4000))
    key = a.select("name", F.lit("restaurant").alias("word"))
    left, right = key.withColumnRenamed("name", "a"), key.withColumnRenamed("name", "b").limit(900)
    for side in linking.sub_blocks(left, right, ["word"], 100):
        sizes = [r["count"] for r in side.groupBy("word", "cut_a", "cut_b").count().collect()]
        assert len(sizes) == 41 * 9 and max(sizes) < 150
    assert linking.met_in_blocks(left, right, ["word"], 100).count() == 4001 * 900


def test_contexts_are_compared_once_and_in_tasks_of_their_own(spark):
    mentions = spark.createDataFrame([(k, f"pho hoa {k % 3}", ["ben thanh"] if k % 2 else []) for k in range(8)], "mention_id long, name string, hints array<string>")
    places = spark.createDataFrame([(1, "pho hoa 1", "ben thanh street"), (2, "pho hoa 2", "elsewhere"), (3, "pho hoa 2", "ben thanh street")], "identity long, title string, address string")
    linked = linking.link_to_catalogue(mentions, places)
    assert sorted((r.mention_id, r.identity) for r in linked.collect()) == [(1, 1), (4, 1), (5, 3), (7, 1)]
    assert "REPARTITION_BY_NUM" in linked._jdf.queryExecution().executedPlan().toString()
