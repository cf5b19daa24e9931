"""Operators whose ratio has no SQL form against brute force; literal cases; streams."""

import json
import re
import unicodedata
from difflib import SequenceMatcher
from itertools import pairwise

from pyspark.sql import functions as F

from cartolake.operators import captures, linking
from cartolake.plans import registry
from cartolake.sources import files
from cartolake.streaming import events, jobs

SF = "/root/testdata/sf0.001"


def normal(text):
    text = unicodedata.normalize("NFKD", (text or "").casefold()).replace("đ", "d")
    return " ".join(re.sub(r"\W+", " ", "".join(c for c in text if not unicodedata.combining(c))).split())


def alike(a, b):
    a, b = normal(a), normal(b)
    x, y = set(a.split()), set(b.split())
    near = SequenceMatcher(None, a, b).ratio()
    if not a or not b or a == b or not x & y:
        return 0.0 if not a or not b else 1.0 if a == b else 0.55 * near
    score = 0.6 * 2 * len(x & y) / (len(x) + len(y)) + 0.4 * near
    return min(1.0, max(score, 0.9) if min(len(x), len(y)) >= 2 and (x <= y or y <= x) else score)


def test_similarity_equals_brute_force(spark):
    rows = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in registry.QUERIES["name_similarity"](spark, SF).collect():
        p = rows[r.id]
        assert abs(r.similarity - alike(p.p_name, f"{p.p_type} {p.p_name}{' s' if r.id % 2 == 0 else ''}")) < 1e-8


def test_links_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").limit(70).collect()
    names = [(r.p_partkey, f"{r.p_name}{(' old', '', 'x')[r.p_partkey % 3]} {r.p_brand}") for r in rows]
    titles = [(r.p_partkey, f"{r.p_name} {r.p_brand}") for r in rows]
    expected = set()
    for m, name in names:
        ranked = sorted(((alike(name, t), -i) for i, t in titles), reverse=True)
        (s, i), (s2, _) = ranked[:2]
        if s >= 0.68 and s - s2 >= 0.08:
            expected.add((m, -i, round(s, 4)))
    found = linking.link_to_catalogue(spark.createDataFrame(names, "mention_id long, name string"), spark.createDataFrame(titles, "identity long, title string"))
    assert {tuple(r) for r in found.collect()} == expected and expected


def supported(quote, text):
    q, t = normal(quote), normal(text)
    if not q or not t or f" {q} " in f" {t} ":
        return bool(q and t)
    a, b = q.split(), t.split()
    covered = sum(w in b for w in a) / len(a)
    if len(a) < 2 or covered < 0.6 or covered >= 0.8:
        return len(a) >= 2 and covered >= 0.8
    sizes = range(max(2, len(a) - 2), min(len(b), len(a) + 3) + 1)
    return any(SequenceMatcher(None, q, " ".join(b[k : k + n])).ratio() >= 0.58 for n in sizes for k in range(len(b) - n + 1))


def test_quotes_equal_brute_force(spark):
    text = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    found = registry.QUERIES["quote_support"](spark, SF).collect()
    for r in found:
        mine = text[r.conv_id, r.turn]
        assert r.supported == supported(mine, " ".join(w for i, w in enumerate(mine.split(" ")) if i % 4 < 3) if r.against == "own" else text[r.conv_id, r.turn - 1])
    assert len({r.supported for r in found}) == 2


def test_frames_kept_differ_from_the_last_kept(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    kept = registry.QUERIES["drop_near_identical"](spark, SF).collect()
    by_video = {}
    for r in sorted(kept, key=lambda r: r.pos):
        by_video.setdefault(r.video, []).append(r.pos)
    apart = lambda a, b: [abs(x - y) for x, y in zip(rows[a], rows[b], strict=True)]
    far = lambda a, b: max(sum(apart(a, b)[k : k + 4]) / 4 for k in range(0, len(rows[a]) - 3, 4))
    assert 0 < len(kept) < len(rows)
    for video, own in by_video.items():
        assert own[0] == min(k for k in rows if k // 50 == video) and all(far(a, b) > 0.2 for a, b in pairwise(own))
        for k in (k for k in rows if k // 50 == video and k not in own):
            assert far(max(x for x in own if x < k), k) <= 0.2


def test_frames_of_unequal_sizes(spark):
    frames = [[1.0, 1.0], [1.0, 1.0], [1.0], None, [1.0], [1.0, 9.0], [3.0, 7.0]]
    rows = spark.createDataFrame([("v", k, f) for k, f in enumerate(frames)] + [("w", 0, [1.0]), ("w", 1, [1.0])], "video string, pos int, vector array<double>")
    kept = sorted(tuple(r) for r in linking.drop_near_identical(rows, 2.0, 2).collect())
    assert kept == [("v", 0), ("v", 2), ("v", 3), ("v", 4), ("v", 5), ("w", 0), ("w", 1)]


def test_normal_form(spark):
    row = spark.createDataFrame([("  Phở – Đà Nẵng, Straße!",), (None,)], "t string")
    assert [r[0] for r in row.select(linking.match_text(F.col("t"))).collect()] == ["pho da nang strasse", ""]


def test_hours_and_clock(spark):
    rows = spark.createDataFrame([("a", 0, "Monday, 11 AM to 2 PM, Copy open hours", None), ("a", 1, None, ["tuesday", "Closed"]), ("a", 2, "Someday, x", None)], "place_id string, pos int, label string, cells array<string>")
    assert sorted((r.day, r.hours) for r in captures.parse_opening_hours(rows).collect()) == [("Monday", "11 AM - 2 PM"), ("Tuesday", "Closed")]
    times = spark.createDataFrame([("12 AM",), ("12:30 PM",), ("13:05",), ("13 PM",), (None,)], "t string")
    assert [r[0] for r in times.select(captures.clock_hour(F.col("t"))).collect()] == [0, 12, 13, None, None]


def test_place_lists(spark):
    raw = spark.createDataFrame([('[{"a": 1}, 5]',), ('{"data": {"content": [{"a": 2}]}}',), ('{"data": [{"a": 3}]}',), ("{}",), ("no",), (None,)], "j string")
    places, rejects = files.unwrap_place_list(raw, "j", "a int")
    assert sorted(r.a for r in places.collect()) == [1, 2, 3] and rejects.count() == 3


def test_dimension_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"templates": ["a {region}", "b"], "foods": {"x": ["pho", "bun"]}}))
    (tmp_path / "r.json").write_text(json.dumps([{"code": "x", "name": "X", "priority": 3, "tourist_areas": ["old town"]}]))
    templates, foods = files.read_search_config(spark, str(tmp_path / "c.json"))
    assert [(r.pos, r.template) for r in templates.collect()] == [(0, "a {region}"), (1, "b")] and foods.count() == 2
    assert files.read_regions(spark, str(tmp_path / "r.json")).first().priority == 3


def test_block_guard_equals_batch(spark, tmp_path):
    from cartolake.operators import refresh

    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id AS worker", "event_id AS seq", "event_type IN ('error', 'view') AS blocked", "event_type = 'signup' AS raised")
    for k in range(2):
        rows.where(f"(seq < 500) = ({k} = 0)").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/*"))
        with jobs.state_store(spark):
            q = events.live_block_guard(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    columns = ["worker", "seq", "streak", "wait_s", "stop"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(columns).collect(), key=str) == sorted(refresh.block_streaks(rows).select(columns).collect(), key=str)


def computed(df, text):
    """How often the plan mentions a text."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_popular_times_read_a_label_once(spark):
    rows = [("a", "Mondays", 1, "Currently  45% busy, usually 20% busy."), ("a", "Mondays", 2, "130% busy at 12 PM."), ("a", "mondays", 3, "7% busy at 12 pm"), ("a", "Monday", 4, "9% busy at 13:00."),
            ("a", "Monday", 5, "9% busy at 25."), ("a", "Someday", 6, "9% busy at 3 PM."), ("a", None, 7, "9% busy at 3 PM."), ("a", "Sunday", 8, None), ("a", "Sunday", 9, "1% busy at 0 AM."), ("a", "Sunday", 10, "1% busy at 12:30 AM")]
    found = captures.parse_popular_times(spark.createDataFrame(rows, "place_id string, day string, pos long, label string"))
    assert sorted(map(tuple, found.collect())) == [("a", "Monday", -1, 45), ("a", "Monday", 12, 7), ("a", "Monday", 13, 9), ("a", "Sunday", 0, 1)]
    assert computed(found, "% busy at") <= 2


def test_menus_are_read_once(spark):
    texts = ['{"data":[],"images":[{"image":"u=w10","name":" A "},{"url":"u=w10","title":"A"},"only title",null,{"title":"x"}],"highlights":["Menu",{"title":"menu"}," Set ",7,{"url":"v"}]}',
             '{"data":[{"url":"d"}],"images":[{"url":"i"}],"menu":{"url":" ","link":" l "}}', '{"menu":{"url":"m"}}', '{"menu":"m","highlights":["menu"]}', '{"menu":{"url":{"a":"b"}}}', "{}", "no json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, actions string")
    listed = captures.normalize_menu(rows, "actions")
    assert listed.columns == ["id", "actions", "menu"]
    found = {r.id: r.menu and (r.menu.link, [tuple(x) for x in r.menu.data], [tuple(x) for x in r.menu.highlights]) for r in listed.collect()}
    assert found == {
        0: (None, [("u=w100", "A")], [("", "Set"), ("", "7"), ("v", "")]), 1: ("l", [("d", "")], []), 2: ("m", [], []), 3: None, 4: ('{"a":"b"}', [], []), 5: None, 6: None, 7: None,
    }
    some = listed.where("menu IS NOT NULL").select("id", F.size("menu.data").alias("n"), F.get("menu.data", F.lit(0))["url"].alias("url"))
    assert computed(some, "$.images") == 1
