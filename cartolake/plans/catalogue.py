"""Registered queries of sources and sinks, URLs, query expansion, groups, payloads and jobs, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolake.functions.storage import scratch
from cartolake.operators import ai_log, captures, classify, discovery, linking, mentions, refresh, reviews, urls
from cartolake.plans.captures import table
from cartolake.plans.registry import query, view
from cartolake.sources import exports, files, upsert


@query("SELECT trim(url) AS url FROM pages WHERE page_id % 3 > 0")
def read_url_list(spark, sf_dir):
    """The pages' URLs written as lines, a third of them as comments, with a blank line after each, and read again."""
    path = scratch(spark, "urls")
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("# "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    table(spark, sf_dir, "pages").select(F.explode(F.array(line, F.lit(" "))).alias("value")).write.text(path)
    return files.read_url_list(spark, path)


@query("SELECT p_partkey AS id, p_name AS title, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_images FROM part")
def write_place_export(spark, sf_dir):
    """Places written as an export, those without images with empty lists, and read again."""
    path = scratch(spark, "export")
    files.write_place_export(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS title", "CASE WHEN p_partkey % 2 = 0 THEN array('a', 'b') END AS images"), path)
    return spark.read.schema("id long, title string, images array<string>").json(path).select("id", "title", F.size("images").alias("n_images"))


@query("SELECT p_partkey AS id, p_name AS title FROM part")
def read_place_export(spark, sf_dir):
    """Exports of up to 100 places each, a file for each one, read again."""
    path = scratch(spark, "exports")
    group = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))).alias("places"))
    whole = F.to_json(F.struct(F.lit("2024-05-06").alias("generated_at"), F.size("places").alias("count"), "places"))
    group.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_place_export(spark, path, "id long, title string")


@query("SELECT lower(n_name) AS code, n_name AS name, CAST(n_nationkey AS INTEGER) AS priority, CAST(n_nationkey % 3 AS INTEGER) AS n_areas FROM nation")
def read_regions(spark, sf_dir):
    """The nations as a file of regions, a dimension, read again."""
    path = scratch(spark, "regions")
    one = F.struct(F.lower("n_name").alias("code"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("priority"), F.expr("slice(array('north', 'south'), 1, CAST(n_nationkey % 3 AS INT))").alias("tourist_areas"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)
    return files.read_regions(spark, path).select("code", "name", "priority", F.size("tourist_areas").alias("n_areas"))


@query("SELECT lower(n_name) AS region, food FROM nation, (VALUES ('pho'), ('bun')) t(food) UNION ALL SELECT 'template', concat(pos, ' ', template) FROM (VALUES (0, 'food in {region}'), (1, '{food}')) t(pos, template)")
def read_search_config(spark, sf_dir):
    """The nations' foods and two templates as a configuration file, a dimension, read again."""
    path = scratch(spark, "config")
    foods = F.map_from_entries(F.collect_list(F.struct(F.lower("n_name"), F.array(F.lit("pho"), F.lit("bun")))))
    table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.array(F.lit("food in {region}"), F.lit("{food}")).alias("templates"), foods.alias("foods"))).alias("value")).write.text(path)
    templates, found = files.read_search_config(spark, path)
    return found.select("region", "food").unionByName(templates.select(F.lit("template").alias("region"), F.concat_ws(" ", "pos", "template").alias("food")))


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey % 5 < 4")
def unwrap_place_list(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("list", F.to_json(F.array(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))))
    raw = part.selectExpr(
        "CASE p_partkey % 5 WHEN 0 THEN list WHEN 1 THEN concat('{\"data\":', list, '}') WHEN 2 THEN concat('{\"data\":{\"items\":', list, '}}') WHEN 3 THEN concat('{\"data\":{\"places\":', list, '}}') ELSE 'no list' END AS reply"
    )
    return files.unwrap_place_list(raw, "reply", "id long, title string")[0]


@query("SELECT id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 1 THEN link ELSE concat('https://maps.app.goo.gl/a', id) END AS url FROM fx_place, (VALUES (1), (2)) t(pos) WHERE contains(link, 'google.com/maps') OR pos = 2 AND link <> ''")
def extract_map_urls(spark, sf_dir):
    """A link in words, and one in JSON, in brackets or before a sign that no URL holds."""
    after = "concat('{\"u\":\"https://maps.app.goo.gl/a', id, CASE id % 4 WHEN 0 THEN '\"},' WHEN 1 THEN ']x' WHEN 2 THEN '|y' ELSE '`' END)"
    rows = view(spark, sf_dir, "fx_place").where("link <> ''").selectExpr("id", f"concat('See https://example.org/x and ', link, ' soon ', {after}) AS text")
    return urls.extract_map_urls(rows, "text").select("id", "pos", "url")


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN concat('https://maps.app.goo.gl/', id, '?hl=en#top') WHEN id % 3 = 1 THEN concat('https://www.google.com/maps?q=a+b%2C', id, '&e=&z=1~%2A&hl=en') ELSE concat('https://example.com/?hl=vi&q=', id) END AS link FROM fx_place""")
def force_language(spark, sf_dir):
    link = "CASE id % 3 WHEN 0 THEN concat('https://maps.app.goo.gl/', id, '#top') WHEN 1 THEN concat('https://www.google.com/maps?HL=vi&q=a%20b,', id, '&e&hl=fr&z=1~*') ELSE concat('https://example.com/?hl=vi&q=', id) END AS link"
    return urls.force_language(view(spark, sf_dir, "fx_place").selectExpr("id", link), "link")


@query("SELECT id, concat('https://h/p', id, CASE WHEN id % 2 = 0 THEN concat('=w', id * 3, '-h', id * 3, '-k') ELSE concat('=s', id * 3, '-w5=w21') END) AS url FROM fx_place")
def upscale_image(spark, sf_dir):
    url = "concat('https://h/p', id, CASE WHEN id % 2 = 0 THEN concat('=w', id, '-h', id, '-k') ELSE concat('=s', id, '-w5=w007') END) AS url"
    return view(spark, sf_dir, "fx_place").selectExpr("id", url).select("id", urls.upscale_image(F.col("url"), 3).alias("url"))


@query("SELECT place_id, pos FROM (SELECT user_id AS place_id, event_id AS pos, row_number() OVER (PARTITION BY user_id, event_id % 9 ORDER BY event_id) AS n FROM events WHERE event_id % 5 > 1) WHERE n = 1")
def dedupe_photos(spark, sf_dir):
    """A photo in five is an avatar, and one a variant of a video."""
    url = "concat('https://lh3.googleusercontent.com/', CASE WHEN event_id % 5 = 0 THEN 'a-/' ELSE 'p/' END, event_id % 9, CASE WHEN event_id % 5 = 1 THEN '=m37' ELSE concat('=w', event_id) END) AS url"
    return urls.dedupe_photos(table(spark, sf_dir, "events").selectExpr("user_id AS place_id", "event_id AS pos", url)).select("place_id", "pos")


@query("SELECT id, min(seq) AS seq FROM (SELECT page_id % 200 AS id, page_id AS seq FROM pages WHERE page_id % 3 = 0) GROUP BY id")
def find_broken_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id % 200 AS id", "page_id AS seq", "CASE WHEN page_id % 3 = 0 THEN concat('HTTPS://x/', page_id) ELSE 'Pho' END AS title")
    return urls.find_broken_titles(rows).select("id", "seq")


@query("""SELECT lower(n_name) AS code, CAST(row_number() OVER (PARTITION BY n_name ORDER BY kind, pos, area_no, food_no) AS INTEGER) AS query_no, query FROM
 (SELECT n_name, 1 AS kind, 0 AS pos, 0 AS area_no, 0 AS food_no, concat('late food, ', n_name) AS query FROM nation
  UNION ALL SELECT n_name, 2, 0, a.no, 0, concat(a.name, ' street ', n_name) FROM nation, (VALUES (0, 'north'), (1, 'south')) a(no, name)
  UNION ALL SELECT n_name, 3, 0, 0, 0, concat('food in ', n_name) FROM nation
  UNION ALL SELECT n_name, 4, 0, 0, f.no, concat(f.food, ', ', n_name) FROM nation, (VALUES (0, 'pho'), (1, 'bun')) f(no, food) WHERE n_nationkey % 2 = 0)
 QUALIFY query_no <= 5""")
def expand_all_region_queries(spark, sf_dir):
    """All kinds of templates, areas of every region and foods of every other one; an area's template repeats itself."""
    nation = table(spark, sf_dir, "nation")
    rows = [("specialty", 0, "{food}"), ("province", 0, "food in  {region}"), ("tourist", 0, "{area} street {region}"), ("tourist", 1, "{area} street {region}"), ("custom", 0, " late food"), ("custom", 1, " ")]
    templates = spark.createDataFrame(rows, "kind string, pos int, template string")
    foods = nation.where("n_nationkey % 2 = 0").selectExpr("lower(n_name) AS code", "posexplode(array('pho', 'bun')) AS (pos, food)")
    return discovery.expand_region_queries(nation.selectExpr("lower(n_name) AS code", "n_name AS name", "array('north', 'south') AS tourist_areas"), templates, 5, foods)


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'ATTRACTIONS' WHEN 1 THEN 'FOOD_AND_DRINK' WHEN 2 THEN 'ATTRACTIONS' END AS place_group FROM fx_place")
def fold_legacy_group(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_place").selectExpr("id", "CASE id % 4 WHEN 0 THEN ' nature_and_outdoors' WHEN 1 THEN 'FOOD_AND_DRINK' WHEN 2 THEN 'SHOPPING_AND_MARKET' ELSE ' ' END AS own")
    return rows.select("id", classify.fold_legacy_group(F.col("own")).alias("place_group"))


@query("""SELECT c_custkey AS id, coalesce(array_to_string(list(DISTINCT lower(d.n_name) ORDER BY lower(d.n_name)), ','), '') AS destinations FROM customer JOIN nation n ON c_nationkey = n.n_nationkey
 LEFT JOIN nation d ON contains(lower(concat('5 ', n.n_name, ' street, ', c_name)), lower(d.n_name)) GROUP BY c_custkey""")
def tag_destinations(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS id", "concat('5 ', n_name, ' street, ', c_name) AS address")
    found = classify.tag_destinations(rows, nation.selectExpr("lower(n_name) AS code", "lower(n_name) AS phrase"))
    return found.select("id", F.array_join("destinations", ",").alias("destinations"))


@query("SELECT id, CAST(2 AS INTEGER) AS n_data, concat('https://h/', id, '=w100') AS first_url, 'Set menu' AS highlight FROM fx_place WHERE id % 3 > 0")
def normalize_menu(spark, sf_dir):
    """Two images of three, one of them twice; a highlight that says menu; a third of the places has nothing."""
    some = """concat('{"images":[{"image":"https://h/', id, '=w10","name":"A"},{"url":"https://h/', id, '=w10","title":"A"},{"url":"","title":"no url"},{"url":"https://h/b=w10"}],"highlights":["Menu"," Set menu "]}')"""
    # the table is narrow and its rows are dear: they are dealt over all tasks before their JSON is made
    places = view(spark, sf_dir, "fx_place").select("id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    rows = places.selectExpr("id", f"CASE id % 3 WHEN 0 THEN '{{\"data\":[],\"highlights\":[\"menu\"]}}' ELSE {some} END AS actions")
    menu = captures.normalize_menu(rows, "actions").where("menu IS NOT NULL")
    return menu.select("id", F.size("menu.data").alias("n_data"), F.get("menu.data", F.lit(0))["url"].alias("first_url"), F.get("menu.highlights", F.lit(0))["title"].alias("highlight"))


@query("SELECT place_id, CASE id % 2 WHEN 0 THEN 'FOOD_AND_DRINK' ELSE 'ATTRACTIONS' END AS place_group, CASE id % 3 WHEN 0 THEN '{\"mon\":\"8-9\"}' WHEN 1 THEN '[\"raw\"]' ELSE '{}' END AS regular, '' AS phone, '[]' AS images FROM fx_place")
def payload_defaults(spark, sf_dir):
    """The derived group where the own one is OTHER; regular hours from three places; defaults of absent columns."""
    rows = view(spark, sf_dir, "fx_place").withColumns({
        "place_group": F.expr("CASE id % 2 WHEN 0 THEN 'other' ELSE 'nature_and_outdoors' END"), "derived_group": F.lit("FOOD_AND_DRINK"),
        "open_hours": F.expr("CASE id % 3 WHEN 0 THEN map('mon', '8-9') END"), "raw_data": F.expr("CASE id % 3 WHEN 1 THEN '{\"openingHours\":{\"regular\":[\"raw\"]}}' END"),
    })
    at = lambda p, to: F.get_json_object("payload", f"$.{p}").alias(to)
    return captures.place_payload(rows).select("place_id", at("placeGroup", "place_group"), at("regular", "regular"), at("phone", "phone"), at("images", "images"))


@query("SELECT place_id, concat('j', id) AS job, place_id AS place, visibility, CASE WHEN id % 2 = 0 THEN '[\"r\"]' ELSE '[]' END AS reviews, 'true' AS skipped FROM fx_place WHERE id % 4 < 3")
def contribution_payload(spark, sf_dir):
    places = view(spark, sf_dir, "fx_place")
    asked = places.where("id % 4 < 3").selectExpr(
        "place_id", "id AS group_id", "concat('j', id) AS job_id", "'s' AS source_job_id", "false AS place_exists", "CAST(NULL AS BOOLEAN) AS skip_if_exists",
        "CASE WHEN id % 2 = 0 THEN array('r') END AS reviews", "CAST(NULL AS array<string>) AS contributors",
    )
    at = lambda p, to: F.get_json_object("payload", f"$.{p}").alias(to)
    return captures.contribution_payload(places, asked).select(
        "place_id", at("jobId", "job"), at("place.placeId", "place"), at("place.visibility", "visibility"), at("sourceReviews", "reviews"), at("skipPlaceInsertIfExists", "skipped")
    )


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE place_id END AS new_place_id, id % 3 = 1 AS place_exists, CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS reviews_published FROM fx_place")
def contribution_result(spark, sf_dir):
    reply = "CASE id % 3 WHEN 0 THEN 'no json' WHEN 1 THEN concat('{\"placeId\":\"', place_id, '\",\"placeAlreadyExists\":true,\"reviewsPublished\":', id, '}') ELSE concat('{\"id\":\"', place_id, '\",\"reviewsPublished\":', id, '}') END AS reply"
    return captures.contribution_result(view(spark, sf_dir, "fx_place").selectExpr("id", "place_id", reply), "reply").select("id", "new_place_id", "place_exists", "reviews_published")


@query(r"""SELECT id FROM (SELECT id, CASE WHEN id % 3 > 0 THEN id % 100 END AS age FROM fx_place WHERE visibility = 'ACTIVE' AND contains(link, 'google.com/maps') AND NOT contains(link, '/maps/@'))
 WHERE age IS NULL OR age >= 24 ORDER BY age IS NULL DESC, age DESC, id LIMIT 50""")
def review_refresh_candidates(spark, sf_dir):
    """The 50 places that waited longest, of those without a scrape in 24 hours."""
    rows = view(spark, sf_dir, "fx_place").withColumn("last_scraped_at", F.expr("CASE WHEN id % 3 > 0 THEN timestamp'2024-06-01 00:00:00' - make_interval(0, 0, 0, 0, CAST(id % 100 AS INT)) END"))
    return refresh.review_refresh_candidates(rows, "2024-06-01 00:00:00", 24, 50).select("id")


@query("""SELECT job_id, active OR (rank <= 40 AND age <= 240) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY active, age <= 240 ORDER BY age, job_id DESC) AS rank
 FROM (SELECT event_id AS job_id, event_id % 10 = 0 AS active, event_id % 480 AS age FROM events))""")
def job_retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS job_id", "CASE WHEN event_id % 10 = 0 THEN 'running' ELSE 'done' END AS status",
        "CASE WHEN event_id % 4 > 0 THEN timestamp'2024-06-01 00:00:00' - make_interval(0, 0, 0, 0, CAST(event_id % 480 AS INT)) END AS finished_at",
        "timestamp'2024-06-01 00:00:00' - make_interval(0, 0, 0, 0, CAST(event_id % 480 AS INT)) AS created_at",
    )
    return refresh.job_retention(rows, "2024-06-01 00:00:00", 240, 40).select("job_id", "kept")


@query("SELECT event_id AS job_id, user_id % 4 = 0 OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_first FROM events")
def idempotent_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS job_id", "ts AS created_at", "CASE WHEN user_id % 4 > 0 THEN user_id END AS request_key")
    return refresh.idempotent_requests(rows).select("job_id", "is_first")


@query("""SELECT p_partkey AS id, coalesce(string_agg(DISTINCT d.code, ',' ORDER BY d.code), '') AS destinations FROM part LEFT JOIN
 (SELECT concat('c', p_partkey % 97) AS code, substr(p_name, 1 + p_partkey % 3, 5 + p_partkey % 6) AS phrase FROM part) d ON contains(lower(concat(p_name, ' / ', p_brand)), d.phrase) GROUP BY p_partkey""")
def tag_many_destinations(spark, sf_dir):
    """A dictionary that is too large for a literal of the plan: a phrase of each part's name."""
    part = table(spark, sf_dir, "part")
    dictionary = part.selectExpr("concat('c', p_partkey % 97) AS code", "substr(p_name, 1 + p_partkey % 3, 5 + p_partkey % 6) AS phrase")
    found = classify.tag_destinations(part.selectExpr("p_partkey AS id", "upper(concat(p_name, ' / ', p_brand)) AS address"), dictionary)
    return found.select("id", F.array_join("destinations", ",").alias("destinations"))


@query("SELECT p_partkey AS id, concat(p_name, ' \"}', chr(10), '{[ ', p_brand) AS title, concat('S', p_size) AS size FROM part")
def read_large_export(spark, sf_dir):
    """Exports of 500 places, with quotes and braces in their titles, written and read by fragments."""
    place = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.expr("concat(p_name, ' \"}\\n{[ ', p_brand)").alias("title"), F.struct(F.concat(F.lit("S"), "p_size").alias("size")).alias("nested")))
    groups = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 500")).agg(F.count("*").alias("n"), F.concat_ws(", ", F.collect_list(place)).alias("all"))
    path = scratch(spark, "exports")
    groups.select(F.format_string('{"generated_at": "t", "count": %d, "places": [%s]}', "n", "all")).write.text(path)
    return exports.read_large_export(spark, path, "id long, title string, nested struct<size:string>").select("id", "title", "nested.size")


#: Candidates by part: each knows its key, a place id and a cid; the catalogue has one of the three, or none.
KNOWN_BY = "CASE WHEN p_partkey % 5 = 1 THEN 'key' WHEN p_partkey % 5 = 2 THEN 'place_id' WHEN p_partkey % 5 = 3 THEN 'cid' WHEN p_partkey % 35 = 0 THEN 'all' ELSE 'none' END"


@query(f"SELECT p_partkey AS id, {KNOWN_BY} <> 'none' AS is_known FROM part")
def exclude_existing(spark, sf_dir):
    """Candidates that the catalogue knows by one id only, by all, by a blank one, or not."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{KNOWN_BY} AS known_by")
    own = part.selectExpr("id", "concat('k', id) AS key", "CASE WHEN known_by = 'cid' THEN ' ' ELSE concat('p', id) END AS place_id", "CASE WHEN known_by = 'place_id' THEN NULL ELSE CAST(id AS STRING) END AS cid")
    has = lambda k, v: f"CASE WHEN known_by IN ('{k}', 'all') THEN {v} ELSE ' ' END AS {k}"
    catalogue = part.selectExpr(has("key", "concat('k', id)"), has("place_id", "concat(' p', id)"), has("cid", "CAST(id AS STRING)"))
    return discovery.exclude_existing(own, catalogue.unionByName(catalogue)).select("id", "is_known")


CHORD = "2 * 6371.0088 * asin(least(1, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) / 2))"
VECTOR = "cos(radians({lat})) * cos(radians({lng})) AS {p}x, cos(radians({lat})) * sin(radians({lng})) AS {p}y, sin(radians({lat})) AS {p}z"
POLE_POINT = ["p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN 89.95e0 WHEN 1 THEN -89.9e0 ELSE (p_partkey % 100) / 50e0 END AS latitude", "CASE p_partkey % 3 WHEN 0 THEN 179.9e0 WHEN 1 THEN -179.9e0 ELSE (p_partkey % 360) - 180e0 END AS longitude"]
POLE_CENTER = ["s_suppkey AS center_id", "CASE s_suppkey % 3 WHEN 0 THEN 89.9e0 WHEN 1 THEN -89.9e0 ELSE 0.5e0 END AS c_lat", "CASE s_suppkey % 2 WHEN 0 THEN 180e0 ELSE -180e0 + s_suppkey END AS c_lng"]


@query(f"""WITH p AS (SELECT *, {VECTOR.format(lat='latitude', lng='longitude', p='')} FROM (SELECT {', '.join(POLE_POINT)} FROM part)), c AS (SELECT *, {VECTOR.format(lat='c_lat', lng='c_lng', p='c')} FROM (SELECT {', '.join(POLE_CENTER)} FROM supplier))
 SELECT id, center_id FROM p JOIN c ON {CHORD} <= 60.5""")
def radius_join_everywhere(spark, sf_dir):
    """Around the poles and over the date line, with crowded cells."""
    points, centers = table(spark, sf_dir, "part").selectExpr(*POLE_POINT), table(spark, sf_dir, "supplier").selectExpr(*POLE_CENTER)
    return discovery.radius_join(points, centers, 60.5, 100).select("id", "center_id")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN concat('new ', p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 0 THEN concat('new ', p_name) ELSE p_name END AS name FROM part")
def apply_title_corrections(spark, sf_dir):
    """Corrections of a quarter of the titles, applied twice, with older ones after them; a third of the translations is of the source that may change."""
    part, root = table(spark, sf_dir, "part"), scratch(spark, "corrected")
    places = part.selectExpr("p_partkey AS id", "p_name AS title", "timestamp'2024-01-01 00:00:00' AS changed_at")
    upsert.upsert(f"{root}/places", places, "id")
    upsert.upsert(f"{root}/translations", places.selectExpr("id", "title AS name", "CASE WHEN id % 3 = 0 THEN 'LEGACY' ELSE 'EDITOR' END AS source", "changed_at"), "id")
    broken = places.where("id % 4 = 0").selectExpr("id", "title AS old", "concat('new ', title) AS new")
    for text, day in ((broken, "2024-02-02"), (broken, "2024-02-02"), (broken.withColumn("new", F.lit("stale")), "2023-01-01")):
        upsert.apply_corrections(f"{root}/places", f"{root}/translations", files.title_corrections(text), F.lit(day).cast("timestamp"))
    return upsert.read_table(spark, f"{root}/places").select("id", "title").join(upsert.read_table(spark, f"{root}/translations").select("id", "name"), "id")


@query("SELECT concat('ChIJ', p_partkey) AS key, CASE WHEN p_partkey % 5 = 0 THEN 'PUT' ELSE 'POST' END AS method, sha256(concat('ChIJ', p_partkey, '|', p_name)) AS request_key, CASE p_partkey % 4 WHEN 0 THEN 'DELIVERED' WHEN 1 THEN 'ALREADY_DELIVERED' WHEN 2 THEN 'DELIVERED' ELSE 'FAILED' END AS delivery FROM part")
def record_import_responses(spark, sf_dir):
    """Two attempts at each payload: what was delivered at first stays so, what failed is delivered by the second, or fails again."""
    part, path = table(spark, sf_dir, "part"), scratch(spark, "outbox")
    sent = part.selectExpr("concat('ChIJ', p_partkey) AS key", "p_name AS payload", "p_partkey % 5 = 0 AS known")
    reply = lambda codes: part.selectExpr("concat('ChIJ', p_partkey) AS key", f"{codes} AS http_status", "'' AS code")
    for attempt, codes in enumerate(("CASE p_partkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 409 ELSE 500 END", "CASE p_partkey % 4 WHEN 2 THEN 201 ELSE 503 END"), 1):
        upsert.record_responses(path, files.import_outbox(sent, reply(codes)).withColumn("attempt", F.lit(attempt)))
    return upsert.read_table(spark, path).select("key", "method", "request_key", "delivery")


@query("SELECT place_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY pos) AS k FROM (SELECT user_id AS place_id, event_id AS pos, event_id % 7 AS size, row_number() OVER (PARTITION BY user_id, event_id % 90 ORDER BY event_id) AS n FROM events WHERE event_id % 5 > 0) WHERE n = 1 AND size > 1) WHERE k <= 30")
def page_photos(spark, sf_dir):
    """A photo in five is an avatar; sizes of two in seven are those of icons."""
    url = "concat('https://lh3.googleusercontent.com/', CASE WHEN event_id % 5 = 0 THEN 'a-/' ELSE 'p/' END, event_id % 90, CASE event_id % 7 WHEN 0 THEN '=s64-c' WHEN 1 THEN '=k-w32-h32' ELSE '=w203' END) AS url"
    return urls.page_photos(table(spark, sf_dir, "events").selectExpr("user_id AS place_id", "event_id AS pos", url)).select("place_id", "pos")


@query("""SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('http://i/', event_id) END AS http_image, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'vi=Quán' ELSE 'en=Good' END AS review_text FROM events""")
def scoring_review_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "concat('r', event_id) AS review_id", "event_id AS place_id", "'A' AS author", "5 AS rating", "'' AS review_date", "CASE event_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Quán' ELSE 'Good ' END AS text",
        "array('data:x', CASE WHEN event_id % 4 = 0 THEN ' http://no' ELSE concat('http://i/', event_id) END) AS images",
    )
    return reviews.scoring_reviews(rows, 5).select("seq", F.array_join("user_images", ",").alias("http_image"), F.array_join(F.transform(F.map_entries("review_text"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("review_text"))


@query("""SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'data:x' ELSE concat('data:x,i', event_id) END AS user_images, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'other=Good' END AS review_text, CASE WHEN event_id % 2 = 0 THEN '2024-05-06' ELSE '2024-06-01' END AS review_date FROM events WHERE event_id % 7 > 0""")
def refresh_review_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "concat('r', event_id) AS review_id", "'A' AS author", "5 AS rating", "CASE WHEN event_id % 2 = 0 THEN ' 2024-05-06' ELSE 'last week' END AS review_date", "CASE WHEN event_id % 3 > 0 THEN 'Good ' END AS text",
        "CASE WHEN event_id % 7 = 0 THEN array(' ') ELSE array(' data:x ', CASE WHEN event_id % 4 = 0 THEN ' ' ELSE concat('i', event_id) END) END AS images",
    )
    return reviews.refresh_reviews(rows, "2024-06-01").select("seq", F.array_join("user_images", ",").alias("user_images"), F.array_join(F.transform(F.map_entries("review_text"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("review_text"), "review_date")


@query("""WITH o AS (SELECT p_partkey % 13 AS region, p_partkey % 7 = 0 AS known, p_partkey % 11 > 0 AS url, p_partkey % 17 = 0 AS broken, p_partkey % 19 = 0 AS outside, p_partkey % 3 = 0 AS rejected, p_partkey % 23 > 0 AS id, p_partkey % 5 > 0 AS imported, p_partkey % 10 < 4 AS saved,
  p_partkey % 29 = 0 AS unread, p_partkey % 4 AS scoring FROM part), m AS (SELECT *, NOT known AND url AND NOT broken AND NOT outside AS met FROM o),
 c AS (SELECT region, count(*) AS discovered, count(*) FILTER (known OR url) AS processed, count(*) FILTER (met AND NOT rejected) AS eligible, count(*) FILTER (met AND id AND imported) AS imported,
  count(*) FILTER (known OR url AND NOT broken AND outside OR met AND id AND (saved OR NOT imported)) AS skipped, count(*) FILTER (NOT known AND (NOT url OR broken) OR met AND NOT id) AS failed, count(*) FILTER (met AND id AND saved) AS rejected_score,
  count(*) FILTER (met AND id AND imported AND NOT saved) AS insufficient_photo, count(*) FILTER (met AND id AND NOT rejected AND unread) AS no_reviews_captured, count(*) FILTER (met AND id AND NOT rejected AND NOT unread AND scoring = 0) AS no_scoring_reviews FROM m GROUP BY region
  UNION ALL SELECT 99, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0 UNION ALL SELECT 3, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0)
 SELECT region, CAST(sum(discovered) AS BIGINT) AS discovered, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(imported) AS BIGINT) AS imported, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(failed) AS BIGINT) AS failed,
  CAST(sum(rejected_score) AS BIGINT) AS rejected_score, CAST(sum(insufficient_photo) AS BIGINT) AS insufficient_photo, CAST(sum(no_reviews_captured) AS BIGINT) AS no_reviews_captured, CAST(sum(no_scoring_reviews) AS BIGINT) AS no_scoring_reviews FROM c GROUP BY ROLLUP (region)""")
def region_counters(spark, sf_dir):
    """Every way that a candidate can go, and two regions that failed whole, one of them without a candidate."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 13 AS region", "p_partkey % 7 = 0 AS is_known", "p_partkey % 11 > 0 AS has_url", "p_partkey % 17 = 0 AS scrape_failed", "p_partkey % 19 = 0 AS outside", "CASE WHEN p_partkey % 3 = 0 THEN 'NON_FOOD' END AS reason",
        "p_partkey % 23 > 0 AS has_id", "p_partkey % 5 > 0 AS imported", "p_partkey % 10 < 4 AS saved", "TRUE AS rejected_score", "p_partkey % 10 >= 4 AS insufficient", "p_partkey % 29 = 0 AS unread", "p_partkey % 4 AS scoring",
    )
    lost = spark.createDataFrame([(99,), (99,), (3,)], "region long")
    return discovery.region_counters(rows.withColumn("final_reason", discovery.later_reason(F.col("reason"), F.col("unread"), F.col("scoring"))), lost)


@query("""SELECT p_partkey AS id, p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 5 = 1 AS in_country, CASE WHEN p_partkey % 3 = 0 THEN 'Asia/Saigon' ELSE 'UTC' END AS timezone FROM part""")
def infer_locale(spark, sf_dir):
    """Coordinates in the country's box, or an address with its name as whole words."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN 10.5e0 ELSE 1.5e0 END AS latitude", "105e0 AS longitude", "CASE p_partkey % 5 WHEN 0 THEN 'Hanoi, VIETNAM' WHEN 1 THEN 'Huế, việt nam.' WHEN 2 THEN 'Vietnamese Street 5' WHEN 3 THEN NULL ELSE 'x' END AS address")
    return classify.infer_locale(rows).select("id", "in_country", "timezone")


@query("""SELECT event_id AS job_id, CASE WHEN k = 0 THEN 'own' WHEN k = 1 THEN 'SCRAPE_FAILED' WHEN k = 2 THEN 'IMPORT_FAILED' WHEN k = 3 THEN 'JOB_FAILED' WHEN k = 4 AND event_id % 2 = 0 THEN 'JOB_FAILED' END AS error_code, CASE k WHEN 0 THEN 'm' WHEN 1 THEN 'closed' WHEN 2 THEN 'refused' WHEN 3 THEN 'plain' ELSE CASE WHEN k = 4 AND event_id % 2 = 0 THEN 'late' END END AS error_message,
 CASE WHEN k = 1 OR k = 2 OR k = 5 THEN CASE WHEN k = 5 THEN 'success' ELSE 'failed' END END AS import_status FROM (SELECT event_id, event_id % 7 AS k FROM events)""")
def job_poll_view(spark, sf_dir):
    """Errors of each kind, of single and of batch jobs, and results of jobs that are over."""
    kind = lambda *v: "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(v)) + " END"
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS job_id", "CASE WHEN event_id % 7 = 4 THEN 'place-detail-refresh' ELSE 'scrape' END AS job_type", f"{kind(*['\"failed\"'] * 4, '\"completed\"', '\"completed\"', '\"running\"')} AS status".replace('"', "'"), "ts AS created_at", "ts AS started_at", "ts AS finished_at",
        f"{kind(repr('{"code":"own","message":"m"}'), 'NULL', 'NULL', repr('plain'), 'CASE WHEN event_id % 2 = 0 THEN ' + repr('late') + ' END', 'NULL', repr('ignored'))} AS error",
        f"{kind('NULL', repr('{"scrapeError":"closed","upload":{"error":"x"}}'), repr('{"upload":{"error":"refused","statusCode":500}}'), repr('{}'), repr('{"n":1}'), repr('{"success":true,"place":{"title":"T"}}'), repr('{"success":true}'))} AS result",
    )
    return refresh.job_poll_view(rows).select("job_id", "error_code", "error_message", F.get_json_object("result", "$.importStatus").alias("import_status"))


@query("SELECT event_type AS job_type, arg_min(event_id, (ts, event_id)) AS job_id FROM events WHERE event_id % 3 > 0 GROUP BY event_type")
def first_active_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS job_id", "event_type AS job_type", "ts AS created_at", "CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'RUNNING' ELSE 'pending' END AS status")
    return refresh.first_active_jobs(rows).select("job_type", "job_id")


@query("""SELECT conv_id AS post_id, count(*) FILTER (turn % 5 < 2) AS n_rejected, concat_ws(',', CASE WHEN bool_or(turn % 5 = 0) THEN concat('generic_or_unnamed_place=', count(*) FILTER (turn % 5 = 0)) END, CASE WHEN bool_or(turn % 5 = 1) THEN concat('missing_name=', count(*) FILTER (turn % 5 = 1)) END) AS reasons FROM conversations GROUP BY conv_id""")
def validation_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id AS post_id", "'UNRESOLVED' AS status", "CASE turn % 5 WHEN 0 THEN 'generic_or_unnamed_place' WHEN 1 THEN 'missing_name' WHEN 2 THEN 'confidence_below_threshold' END AS reason")
    return mentions.validation_summary(rows).select("post_id", "n_rejected", F.array_join(F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("reasons"))


@query("SELECT conv_id AS post_id, count(*) AS map_input, count(*) FILTER (turn % 3 = 0) AS map_verified, CAST(0 AS BIGINT) AS map_rejected, count(*) FILTER (turn % 3 > 0) AS n_unresolved FROM conversations GROUP BY conv_id")
def map_summary(spark, sf_dir):
    return mentions.map_summary(table(spark, sf_dir, "conversations").selectExpr("conv_id AS post_id", "CASE turn % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'UNRESOLVED' END AS status"))


@query("SELECT conv_id % 20 AS url, role AS model, array_to_string(list_sort(list(DISTINCT concat('t', turn % 4, '=', n))), ',') AS by_type FROM (SELECT *, count(*) OVER (PARTITION BY conv_id % 20, role, turn % 4) AS n FROM conversations WHERE turn % 4 > 0) GROUP BY ALL")
def extraction_eval_types(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id % 20 AS url", "role AS model", "TRUE AS ok", "'UNRESOLVED' AS status", "CASE WHEN turn % 4 > 0 THEN concat('t', turn % 4) END AS mention_type")
    found = ai_log.extraction_eval(rows, rows).where(F.size("by_type") > 0)
    return found.select("url", "model", F.array_join(F.transform(F.map_entries("by_type"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("by_type"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'chat' END AS operation, CASE turn % 2 WHEN 0 THEN 'm1' END AS model, lower(role) AS provider, CASE WHEN turn % 5 = 0 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM conversations""")
def ai_call_texts(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").selectExpr("struct(conv_id, turn) AS trace_id", "CASE turn % 3 WHEN 0 THEN ' chat ' WHEN 1 THEN ' ' END AS operation", "CASE turn % 2 WHEN 0 THEN 'm1' ELSE '' END AS model", "concat(' ', upper(role)) AS provider", "turn % 5 = 0 AS ok", "5 AS latency_ms", "'{}' AS response")
    return ai_log.ai_call_rows(calls).select("trace_id.conv_id", "trace_id.turn", "operation", "model", "provider", "status")


@query("SELECT user_id AS worker, count(*) FILTER (event_id % 4 < 3) AS in_database, count(*) FILTER (event_id % 4 = 1) AS eligible, count(*) FILTER (event_id % 4 = 3) AS processed FROM events GROUP BY user_id")
def refresh_report_totals(spark, sf_dir):
    """A quarter of a worker's events are runs, the others places of its catalogue."""
    rows = table(spark, sf_dir, "events")
    log = rows.where("event_id % 4 = 3").selectExpr("user_id AS worker", "FALSE AS blocked", "event_id % 8 = 3 AS raised")
    return refresh.refresh_report(log, rows.where("event_id % 4 < 3").selectExpr("user_id AS worker", "event_id % 4 = 1 AS is_eligible")).select("worker", "in_database", "eligible", "processed")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 4 > 0 THEN 'REJECTED_TOPIC' ELSE 'PROCEED' END AS verdict FROM conversations")
def reject_posts_with_text(spark, sf_dir):
    """Off the topic, each with a text of another kind or, one in four, with none."""
    texts = ["CASE WHEN turn % 4 = 1 THEN text ELSE ' ' END AS caption", "CASE WHEN turn % 4 = 2 THEN array('tag') END AS tags", "CASE WHEN turn % 4 = 3 THEN 't' END AS transcript"]
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "5 AS duration", "CASE WHEN turn % 3 = 0 THEN FALSE WHEN turn % 3 = 1 THEN TRUE END AS on_topic", *texts)
    return linking.reject_posts(rows, 300).select("conv_id", "turn", "verdict")


@query("""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY (id * 7) % 1000, id) AS n FROM fx_place WHERE visibility = 'ACTIVE' AND contains(link, 'google.com/maps') AND NOT contains(link, '/maps/@')) WHERE n <= 30""")
def ranked_refresh_candidates(spark, sf_dir):
    """Places that their source has ranked: all were scraped just now, and the rank decides."""
    rows = view(spark, sf_dir, "fx_place").withColumns({"last_scraped_at": F.lit("2024-06-01").cast("timestamp"), "source_rank": F.expr("(id * 7) % 1000")})
    return refresh.review_refresh_candidates(rows, "2024-06-01 00:00:00", 24, 30, ranked="source_rank").select("id")


@query("SELECT page_id, concat('/q', page_id, ',/s x,/u') AS links FROM pages")
def page_links(spark, sf_dir):
    """Links in double, single and no quotes, one of them with other attributes before; an attribute of another name counts for nothing."""
    html = "concat('<a class=\"x\" HREF=\"/q', page_id, '\">t</a><a href = ''/s x''>s</a> <abbr href=\"/no\"> <a data-href=\"/no\">n</a><a href=/u>u</a>') AS html"
    return captures.place_info_from_pages(table(spark, sf_dir, "pages").selectExpr("page_id", html)).select("page_id", F.array_join("links", ",").alias("links"))
