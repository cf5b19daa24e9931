"""Match scores against brute force; literal cases of posts, model output, menus, payloads and exports."""

import json

from pyspark.sql import functions as F
from test_captures import alike

from cartolake.operators import captures, extraction, linking, mentions, refresh, urls
from cartolake.plans import registry
from cartolake.sources import files

SF = "/root/testdata/sf0.001"


def test_match_scores_equal_brute_force(spark):
    part = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    found = registry.QUERIES["match_score"](spark, SF).collect()
    for r in found:
        own, near = part[r.id], part[r.id - 1]
        title = f"{near.p_name} {near.p_brand}"
        best = max(alike(n, title) for n in [own.p_name] + [f"{own.p_brand} {own.p_name}"] * (r.id % 2 == 0))
        if r.id % 3 > 0:
            best = min(1.0, 0.86 * best + 0.14 * alike(own.p_type, f"{near.p_type} {near.p_size} {title}"))
        assert abs(r.score - best) < 1e-8
    assert len(found) == sum(k - 1 in part for k in part)


def test_match_score_without_names(spark):
    rows = spark.createDataFrame([(None, None, None, "T", None, None), ("a", [None, "T"], [" "], "t", "x", "y"), ("a", None, ["x"], None, "x", None)], "name string, aliases array<string>, hints array<string>, title string, address string, category string")
    assert [round(r.score, 4) for r in linking.match_score(rows).collect()] == [0.0, 1.0, 0.14]


def test_model_output(spark):
    rows = spark.createDataFrame([('```\n{"a": {"b": 1}}\n```',), ('{"a": true\n "b": 1}',), ('{"l": [{"a": 1}\n{"a": 2}]}',), ("no object",), ("",), (None,), ('{"a": }',), ('{"s": "x\\" }\\n\\"k\\": 1" "n": -1.5e3 "l": [1 2 "b" {} [],], "t": null "u": {"v": 1,},}',)], "o string")
    found = extraction.parse_ai_output(rows, "o").collect()
    assert [r.json is not None for r in found] == [True, True, True, False, False, False, False, True]
    assert json.loads(found[7].json) == {"s": 'x" }\n"k": 1', "n": -1500.0, "l": [1, 2, "b", {}, []], "t": None, "u": {"v": 1}}
    assert [r.repaired for r in found] == [False, True, True, False, False, False, False, True]
    assert json.loads(found[2].json) == {"l": [{"a": 1}, {"a": 2}]}


def test_extraction_of_odd_values(spark):
    odd = {
        "contentType": 5, "destination": "Hue", "durationDays": -2, "durationConfidence": "x", "trip_title": "t" * 200, "general_guidance": [" a ", "", 3], "discarded_mentions": [{"name": "x"}, "y"],
        "candidates": [{"sequence": -4, "dayHint": "2", "optionIndex": 0, "city_hint": " ", "aliases": ["", "b"], "inference_used": True, "evidence": "none"}, None, {"name": "q", "sequence": "z", "inference_used": "no"}],
    }
    rows = spark.createDataFrame([(json.dumps(odd),), (None,), ("{broken",)], "j string")
    first, empty, broken = (r.extraction for r in extraction.normalize_extraction(rows, "j").collect())
    assert first.content_type == "PLACE_LIST" and first.destination.name is None and first.duration_days is None and first.duration_confidence is None
    assert len(first.trip_title) == 120 and first.general_guidance == ["a", "3"] and len(first.discarded_mentions) == 1
    a, b = first.candidates
    assert (a.sequence, a.day_hint, a.option_index, a.city_hint, a.aliases, a.inference_used, a.evidence) == (1, 2, None, None, ["b"], True, [])
    assert (b.name, b.query, b.sequence, b.inference_used, b.evidence_sources) == ("q", "q", 2, False, [])
    assert empty.candidates == [] and broken.candidates == [] and empty.general_guidance == []


def test_context_of_posts(spark):
    posts = spark.createDataFrame([(1, "TikTok", "https://www.tiktok.com/@u/video/1", "long caption"), (2, None, "https://x.example/2", None)], "post_id int, extractor_key string, webpage_url string, description string")
    posts = posts.withColumns({c: F.lit(None).cast("string") for c in ("extractor", "title", "thumbnail", "uploader", "channel", "original_url")} | {"thumbnails": F.lit(None).cast("array<string>"), "duration": F.lit(1)})
    pages = spark.createDataFrame([(1, "short", "Cafe", " ", "Hue", None, None), (2, "a page's own", "Bar", None, None, None, None)], "post_id int, caption string, name string, address string, city string, province string, category string")
    one, two = extraction.social_context(posts, pages).orderBy("post_id").collect()
    assert (one.caption, one.tagged_location.name, one.tagged_location.address, one.creator_text) == ("long caption", "Cafe", None, "long caption Cafe Hue")
    assert (two.caption, two.tagged_location, two.creator_text, two.platform, two.thumbnail_url) == ("", None, "", "", "")


def test_menus(spark):
    rows = spark.createDataFrame([('{"data": [{"url": "u=w2", "title": " A "}, "text", {"title": "x"}], "highlights": ["Menu", "Soup", "Soup", 5, null]}',), ('{"menu": {"link": "m"}}',), ("{}",), (None,), ("no",)], "a string")
    found = [r.menu for r in captures.normalize_menu(rows, "a").collect()]
    assert [tuple(x) for x in found[0].data] == [("u=w20", "A")] and [x.title for x in found[0].highlights] == ["Soup", "5"]
    assert found[1].link == "m" and found[1].data == [] and found[2:] == [None, None, None]


def test_payload_of_a_bare_place(spark):
    columns = "place_id string, title string, category string, latitude double, longitude double, rating double, review_count long, link string, visibility string"
    place = spark.createDataFrame([("p", None, None, None, None, None, None, None, None)], columns)
    found = json.loads(captures.place_payload(place).first().payload)
    assert found["reviewCount"] == 0 and found["menu"] == "{}" and found["images"] == "[]" and found["subTypes"] == [] and "title" not in found
    asked = spark.createDataFrame([("p", 1, None, None, None, None, None, None), ("gone", 2, None, None, None, None, None, None)], "place_id string, group_id int, job_id string, source_job_id string, place_exists boolean, skip_if_exists boolean, reviews array<string>, contributors array<string>")
    rows = captures.contribution_payload(place, asked).collect()
    body = json.loads(rows[0].payload)
    assert len(rows) == 1 and body["place"]["visibility"] == "INACTIVE" and body["skipPlaceInsertIfExists"] is True and body["sourceReviews"] == []


def test_place_export_is_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"generated_at": "t", "count": 2, "places": [{"id": 1, "title": "A"}, {"id": 2}]}, indent=1))
    assert sorted((r.id, r.title) for r in files.read_place_export(spark, str(tmp_path / "a.json"), "id: long, title: string").collect()) == [(1, "A"), (2, None)]


def test_photos_and_sizes(spark):
    base = "https://lh3.googleusercontent.com/p/"
    rows = spark.createDataFrame([("a", k, base + u) for k, u in enumerate(("1=w5", "1=s9", "2=mm,dash", "3=750000", "4=m18", "5=w2-h3"))], "place_id string, pos int, url string")
    assert sorted(r.pos for r in urls.dedupe_photos(rows).collect()) == [0, 5]
    assert spark.createDataFrame([("x=w1-h2-s3=s4",)], "u string").select(urls.upscale_image(F.col("u"))).first()[0] == "x=w10-h20-s3=s40"


def test_frames(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 4.0), (3, None), (4, -1.0)], "video_id int, duration double")
    found = {}
    for r in mentions.frame_grid(rows, 3, 3).orderBy("video_id", "frame_no").collect():
        found.setdefault(r.video_id, []).append(r.at_s)
    assert found == {1: [0.25], 2: [1.0, 3.95], 3: [1.0, 4.0, 7.0], 4: [0.0]}


def test_jobs_that_never_finished_are_kept_by_their_start(spark):
    rows = spark.createDataFrame([("a", "running", None), ("b", "failed", "2024-01-01"), ("c", "done", "2024-05-31"), ("d", "done", None)], "job_id string, status string, at string")
    rows = rows.withColumns({"created_at": F.to_timestamp("at"), "finished_at": F.lit(None).cast("timestamp")})
    assert sorted(r.job_id for r in refresh.job_retention(rows, "2024-06-01", 48, 1).where("kept").collect()) == ["a", "d"]
