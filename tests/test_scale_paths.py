"""Operators whose plain form doesn't scale, against that plain form; cases of rules that were built in part."""

import json
import math
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cartolake.operators import captures, classify, discovery, linking, reviews, urls
from cartolake.sources import exports, files, upsert


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("part", [None, 5000])
def test_a_hundred_thousand_phrases(spark, monkeypatch, part):
    """Also with several automata in a row; phrases that overlap, hold each other, are repeated or empty."""
    if part:
        monkeypatch.setattr(classify, "PART_CHARS", part)
    rng = random.Random(1)
    n = 100_000 if part is None else 2000
    phrases = [("c%d" % (k % 5000), "".join(rng.choices("abcdé ", k=rng.randint(5, 9)))) for k in range(n)] + [("sub", "ab"), ("twin", "ab"), ("twin", "ab"), ("all", ""), (None, "a"), ("none", None), ("case", "Ab")]
    addresses = ["".join(rng.choices("abcdéABC ", k=60)) for _ in range(40)] + [None, "", "xyz"]
    df = spark.createDataFrame(list(enumerate(addresses)), "id int, address string")
    found = {r.id: r.destinations for r in classify.tag_destinations(df, spark.createDataFrame(phrases, "code string, phrase string")).collect()}
    for k, address in enumerate(addresses):
        low = (address or "").lower()
        assert found[k] == sorted({c for c, p in phrases if c is not None and p is not None and p in low})


def test_phrases_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(classify, "DICTIONARY_CHARS", 10)
    df = spark.createDataFrame([("x",)], "address string")
    with pytest.raises(ValueError, match="no dimension"):
        classify.tag_destinations(df, spark.createDataFrame([("code", "a long phrase")], "code string, phrase string"))


ODD = ['a "quoted" }', "x\\y", '{"in": [1, 2}', "end\\", 'é日本"', "}\n{", ""]


def test_export_in_many_splits(spark, tmp_path, small_splits):
    """Three layouts; braces, quotes and escapes in texts; places longer than a split, and as short as nothing."""
    rng = random.Random(1)
    places = [{"id": k, "title": rng.choice(ODD) * rng.randint(1, 3), "nested": {"a": [{"b": {}}], "s": "}"}, "long": "y}" * rng.choice([1, 5, 900])} for k in range(150)] + [{} for _ in range(3)]
    for k, indent in enumerate((None, 2, 0)):
        whole = {"generated_at": 't }" ', "count": 51, "places": places[k * 51 : (k + 1) * 51], "tail": {"x": [1]}}
        (tmp_path / f"{k}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=bool(k % 2)))
    (tmp_path / "none.json").write_text('{"generated_at": null, "count": 0, "places": []}\n')
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 100
    schema = "id long, title string, long string, nested struct<a:array<struct<b:struct<c:int>>>,s:string>"
    found = exports.read_large_export(spark, str(tmp_path), schema).collect()
    got = [(r.id, r.title, r.long, r.nested and r.nested.s) for r in found]
    assert sorted(got, key=str) == sorted(((p.get("id"), p.get("title"), p.get("long"), p.get("nested", {}).get("s")) for p in places), key=str)


def test_export_equals_the_reader_of_whole_files(spark, tmp_path):
    rows = [{"id": k, "name": f"n{k}"} for k in range(50)]
    (tmp_path / "e.json").write_text(json.dumps({"generated_at": "t", "count": 50, "places": rows}))
    schema = "id long, name string"
    assert sorted(exports.read_large_export(spark, str(tmp_path), schema).collect()) == sorted(files.read_place_export(spark, str(tmp_path), schema).collect())


def apart(a, b):
    (lat1, lng1), (lat2, lng2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(("km", "crowded"), [(0.001, 5), (30.0, 5), (500.0, 1000), (25_000.0, 7)])
def test_radius_join_at_poles_and_date_line(spark, km, crowded):
    rng = random.Random(3)
    at = lambda: (rng.choice([89.9, -89.9, 90.0, 0.1, -0.1, 45.0]), rng.choice([180.0, -180.0, 179.9, -179.95, 0.0, 359.9]))
    points, centers = [(k, *at()) for k in range(60)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, float("inf"))], [(k, *at()) for k in range(20)] + [(99, None, None)]
    p = spark.createDataFrame(points, "id int, latitude double, longitude double")
    c = spark.createDataFrame(centers, "center_id int, c_lat double, c_lng double")
    found = sorted((r.id, r.center_id) for r in discovery.radius_join(p, c, km, crowded).collect())
    want = sorted((i, j) for i, *a in points[:60] for j, *b in centers[:20] if apart(a, b) <= km + 1e-9)
    assert found == want and len(found) == len(set(found))


def test_radius_join_computes_a_distance_once_for_a_pair_of_places(spark):
    p = spark.range(1000).selectExpr("id", "IF(id % 4 = 0, 10.2D, 10D) AS latitude", "IF(id % 2 = 0, 20D, 170D) AS longitude", "IF(id % 3 = 0, NULL, id) AS more")
    c = spark.range(700).selectExpr("id AS center_id", "10D AS c_lat", "IF(id % 2 = 0, 20D, -100D) AS c_lng")
    joined = discovery.radius_join(p, c, 5.0)
    assert joined.columns == ["id", "latitude", "longitude", "more", "center_id", "c_lat", "c_lng", "distance_km"]
    rows = {(r.id, r.center_id): (r.latitude, r.more, r.distance_km) for r in joined.collect()}
    assert rows == {(i, j): (10.0, None if i % 3 == 0 else i, 0.0) for i in range(2, 1000, 4) for j in range(0, 700, 2)}
    # what is compared are blocks of rows of one place
    assert discovery.placed(p, "latitude", "longitude", "points_").count() <= 3 + 1000 / discovery.BLOCK


def test_radius_join_deals_the_pairs_of_one_cell_over_tasks(spark):
    p = spark.range(0, 4001, 1, 1).selectExpr("id", "10D AS latitude", "20D AS longitude")
    c = spark.range(0, 4001, 1, 1).selectExpr("id AS center_id", "10D AS c_lat", "20D AS c_lng")
    shares = [r["count"] for r in discovery.radius_join(p, c, 25.0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 4001**2 and len(shares) > 1 and max(shares) < 0.8 * 4001**2


def test_radius_join_has_more_tasks_where_more_pairs_meet(spark, monkeypatch):
    monkeypatch.setattr(discovery, "PAIRS", 10_000)
    p = spark.range(1000).selectExpr("id", "10D AS latitude", "20D AS longitude")
    c = spark.range(1000).selectExpr("id AS center_id", "10D AS c_lat", "20D AS c_lng")
    shares = [r["count"] for r in discovery.radius_join(p, c, 25.0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 1000**2 and max(shares) <= 0.15 * 1000**2


def test_known_by_any_id(spark):
    candidates = spark.createDataFrame([("k1", "p1", "c1"), ("k2", "p2", " "), ("k3", None, "c3"), ("k4", "", None), ("k5", "p1", "c9"), ("k6", "c3", "p2")], "key string, place_id string, cid string")
    catalogue = spark.createDataFrame([("k1", "p1", "c1"), ("x", " p1 ", ""), ("y", None, "c3"), ("", "", "")], "key string, place_id string, cid string")
    found = sorted((r.key, r.is_known) for r in discovery.exclude_existing(candidates, catalogue).collect())
    assert found == [("k1", True), ("k2", False), ("k3", True), ("k4", False), ("k5", True), ("k6", False)]
    assert discovery.exclude_existing(candidates, catalogue.select("key")).where("is_known").count() == 1


def near_by_all_ratios(quote, text):
    n, words = len(quote.split()), text.split()
    sizes = range(max(2, n - 2), min(len(words), n + 3) + 1)
    return any(SequenceMatcher(None, quote, " ".join(words[k : k + s])).ratio() >= 0.58 for s in sizes for k in range(len(words) - s + 1))


def test_bounded_window_search_has_the_same_verdicts():
    rng = random.Random(0)
    vocabulary = ["ba", "kor", "the", "lim", "sto", "aneri", "of", "pho", "quan", "xy"]
    verdicts = set()
    for _ in range(400):
        quote = " ".join(rng.choices(vocabulary, k=rng.randint(1, 8)))
        text = " ".join("".join(rng.choices("abcdeoxyz", k=rng.randint(1, 7))) if rng.random() < 0.75 else rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))
        verdicts.add(near_by_all_ratios(quote, text))
        assert linking.near_window(quote, text) == near_by_all_ratios(quote, text), (quote, text)
    assert verdicts == {True, False}


def test_long_text_is_searched_in_seconds():
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(100_000)]
    began = time.time()
    assert not linking.near_window("zzqx wwvk jjqp the qqzz vvkk of kkww", " ".join(words))
    assert time.time() - began < 20


# --- tables that take changes


def rows_of(spark, path):
    return sorted(tuple(r) for r in upsert.read_table(spark, path).collect())


def test_upsert_twice_is_upsert_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id int, title string, n int, changed_at int"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    assert upsert.upsert(path, make((1, "a", 1, 1), (2, "b", 1, 1), (None, "x", 1, 1)), "id", buckets=3) == 2
    change = make((1, "a2", 2, 5), (1, "a1", 2, 4), (3, "c", 9, 1), (2, "old", 9, 0))
    assert upsert.upsert(path, change, "id", buckets=3) == 2
    want = [(1, "a2", 2, 5), (2, "b", 1, 1), (3, "c", 9, 1)]
    assert rows_of(spark, path) == want
    assert upsert.upsert(path, change, "id", buckets=3) == 0 and rows_of(spark, path) == want
    assert upsert.upsert(path, spark.createDataFrame([(2, "b2", 7), (8, "new", 7)], "id int, title string, changed_at int"), "id", insert=False, buckets=3) == 1
    assert rows_of(spark, path) == [(1, "a2", 2, 5), (2, "b2", 1, 7), (3, "c", 9, 1)]


def test_upsert_that_is_ended_before_its_manifest(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "id int, title string, changed_at int"
    first = spark.createDataFrame([(k, "a", 1) for k in range(20)], schema)
    upsert.upsert(path, first, "id", buckets=4)
    real = spark.createDataFrame

    def fail(rows, kind=None, *more):
        if kind == "part int, version int":
            raise RuntimeError("killed")
        return real(rows, kind, *more)

    change = real([(3, "b", 2), (30, "c", 2)], schema)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a: fail(*a))
    with pytest.raises(RuntimeError, match="killed"):
        upsert.upsert(path, change, "id", buckets=4)
    monkeypatch.undo()
    assert rows_of(spark, path) == [(k, "a", 1) for k in range(20)]
    assert upsert.upsert(path, change, "id", buckets=4) == 2
    assert rows_of(spark, path) == sorted([(k, "b" if k == 3 else "a", 2 if k == 3 else 1) for k in range(20)] + [(30, "c", 2)])


def test_only_legacy_translations_change(spark, tmp_path):
    places, names = str(tmp_path / "p"), str(tmp_path / "n")
    upsert.upsert(places, spark.createDataFrame([(1, "http://x", 0), (2, "http://y", 0)], "id int, title string, changed_at int"), "id")
    upsert.upsert(names, spark.createDataFrame([(1, "http://x", "LEGACY", 0), (2, "http://y", "EDITOR", 0)], "id int, name string, source string, changed_at int"), "id")
    fixes = files.title_corrections(spark.createDataFrame([(1, "http://x", "Pho"), (2, "http://y", "Bun"), (9, "http://z", "Gone")], "id int, old string, new string"))
    assert upsert.apply_corrections(places, names, fixes, F.lit(5)) == (2, 1)
    assert rows_of(spark, places) == [(1, "Pho", 5), (2, "Bun", 5)] and rows_of(spark, names) == [(1, "Pho", "LEGACY", 5), (2, "http://y", "EDITOR", 0)]


# --- rules that were built in part


def test_icons_and_later_variants(spark):
    rows = [(0, "https://lh3.googleusercontent.com/a/x=w500"), (1, "https://lh3.googleusercontent.com/p/1=s64"), (2, "https://lh3.googleusercontent.com/p/1=w500"), (3, "https://lh3.googleusercontent.com/p/2=w203-h32-k"), (4, "https://lh3.googleusercontent.com/p/3=w203"), (5, "https://lh3.googleusercontent.com/p/4=W640"), (6, "https://x.org/p=w203")]
    df = spark.createDataFrame([("p", *r) for r in rows], "place_id string, pos int, url string")
    assert sorted(r.pos for r in urls.page_photos(df).collect()) == [4]


def test_review_images_and_texts(spark):
    schema = "review_id string, place_id string, seq int, author string, rating int, text string, review_date string, images array<string>"
    df = spark.createDataFrame([("r1", "p", 1, "A", 5, " Quán ngon ", "2024-05-06", ["http://a", "data:b", " http://c"]), ("r2", "p", 2, "B", 4, None, "4 days ago", [" x ", " "]), ("r3", "p", 3, "C", 4, "t", None, [" "]), ("r4", "p", 4, "D", 4, "t", None, None)], schema)
    scoring = {r.review_id: r for r in reviews.scoring_reviews(df, 9).collect()}
    assert scoring["r1"].user_images == ["http://a"] and scoring["r1"].review_text == {"vi": "Quán ngon"} and scoring["r2"].review_text == {} and scoring["r4"].user_images == []
    fresh = {r.review_id: r for r in reviews.refresh_reviews(df, "2024-06-01").collect()}
    assert sorted(fresh) == ["r1", "r2"] and fresh["r1"].user_images == ["http://a", "data:b", "http://c"] and fresh["r1"].review_text == {"other": "Quán ngon"} and fresh["r2"].review_date == "2024-06-01"


def test_country_by_words_of_the_address(spark):
    df = spark.createDataFrame([(10.0, 106.0, None), (None, None, "Hà Nội, VIỆT NAM"), (1.0, 1.0, "Vietnamese St"), (0.0, 0.0, "x, Vietnam")], "latitude double, longitude double, address string")
    assert [(r.timezone, r.in_country) for r in classify.infer_locale(df).collect()] == [("Asia/Saigon", True), ("UTC", True), ("UTC", False), ("UTC", True)]


def test_links_of_pages(spark):
    html = """<link href="/css"><a href='/one'>1</a><A class=x href = "/two">2</A><abbr href="/no"><a data-href="/no">n</a><a href=/three>3</a>"""
    assert captures.place_info_from_pages(spark.createDataFrame([(1, html)], "page_id int, html string")).first().links == ["/one", "/two", "/three"]


def kept_by_fold(frames, most):
    """Videos as lists of (pos, vector): the plain fold over each."""
    out = []
    for video, rows in frames.items():
        last, rows = None, sorted(rows, key=lambda r: r[0])
        for pos, v in rows:
            if len(rows) > 2 and last is not None and v is not None and len(v) == len(last) and max(abs(a - b) for a, b in zip(v, last, strict=True)) <= most:
                continue
            out.append((video, pos))
            last = v
    return sorted(out)


def test_frames_pass_one_by_one(spark):
    """Across Arrow batches, with videos of one and two frames, frames without a vector, a video or a place."""
    rng = random.Random(4)
    frames = {v: [(p, None if rng.random() < 0.05 else [float(rng.randrange(4)), float(rng.randrange(3))][: rng.choice([1, 2, 2, 2])]) for p in range(n)] for v, n in enumerate([1, 2, 3, 400, 2, 7, 1, 90])}
    rows = [(v, p, x) for v, own in frames.items() for p, x in own] + [(None, 5, [1.0]), (3, None, [1.0]), (None, 5, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "video int, pos int, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = [tuple(r) for r in linking.drop_near_identical(df, 1.0).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lone = [r for r in found if None in r]
    assert sorted(set(found) - set(lone)) == kept_by_fold(frames, 1.0) and sorted(lone, key=str) == sorted([(None, 5), (None, 5), (3, None)], key=str)
