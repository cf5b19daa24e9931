"""Registered queries of captures, categories, names and links, with their SQL for DuckDB.

Captured texts are put together from the driver's tables; the SQL states what must come out of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.operators import ai_log, captures, classify, discovery, linking, refresh, reviews, urls
from cartolake.plans.registry import query, view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT p_partkey AS id, trim(concat(p_name, ' 5')) AS address, CASE p_partkey % 3 WHEN 0 THEN '+84 5' WHEN 1 THEN '' ELSE '9' END AS phone, '1-2' AS price_range,
 CASE WHEN p_partkey % 2 = 0 THEN 'Open' WHEN p_partkey % 4 = 1 THEN 'Permanently closed' ELSE 'Busy' END AS current_open_status, CASE WHEN p_partkey % 4 = 1 THEN 'Permanently closed' ELSE '' END AS status FROM part""")
def normalize_info(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat('Address:  ', p_name, '  5 ') AS address", "CASE p_partkey % 3 WHEN 0 THEN 'Phone: +84  5' WHEN 1 THEN 'Send to phone' ELSE 'Điện thoại: 9' END AS phone",
        "'' AS plus_code", "'Price range: 1-2, Reported by 5 people' AS price_range", "CASE WHEN p_partkey % 2 = 0 THEN 'Open Show open hours for the week' END AS current_open_status",
        "CASE WHEN p_partkey % 4 = 1 THEN 'Permanently  closed' ELSE 'Busy' END AS status",
    )
    return captures.normalize_info(rows).drop("plus_code")


@query("SELECT concat('p', p_partkey) AS place_id, CAST(s AS VARCHAR) AS stars, (p_partkey % 50) * s * 1000 AS n FROM part, (VALUES (1), (3), (5)) t(s) WHERE p_partkey % 50 > 0")
def rating_breakdown(spark, sf_dir):
    stars = table(spark, sf_dir, "part").selectExpr("p_partkey", "explode(array(1, 3, 5)) AS s")
    labels = stars.selectExpr("concat('p', p_partkey) AS place_id", "s AS pos", "concat(s, ' stars, ', (p_partkey % 50) * s, CASE WHEN p_partkey % 50 > 0 THEN ',000' ELSE '' END) AS label")
    return captures.rating_breakdown(labels).select("place_id", F.explode("breakdown").alias("stars", "n"))


@query("""SELECT place_id, CASE WHEN id % 2 = 0 THEN 4.5 ELSE rating END AS rating, CASE WHEN id % 2 = 0 THEN CASE WHEN review_count = 0 THEN 7 ELSE review_count END ELSE review_count END AS review_count,
 CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS n_stars FROM fx_place""")
def merge_rating_summary(spark, sf_dir):
    own = view(spark, sf_dir, "fx_place")
    places = own.selectExpr("place_id", "rating", "review_count", "map('5', 9L) AS breakdown")
    summary = own.where("id % 2 = 0").selectExpr("place_id", "4.5e0 AS new_rating", "CAST(NULL AS BIGINT) AS new_review_count", "map('5', 3L, '4', 4L) AS new_breakdown")
    return captures.merge_rating_summary(places, summary).select("place_id", "rating", "review_count", F.size("breakdown").alias("n_stars"))


@query("""SELECT p_partkey AS place_id, d AS day, r AS range_no, CASE WHEN r = 1 THEN '5 PM - 11 PM' WHEN d = 'Monday' THEN concat(1 + p_partkey % 9, ' AM - 2 PM') ELSE concat(1 + p_partkey % 9, ' AM to 2 PM') END AS hours
 FROM part, (VALUES ('Monday'), ('Sunday')) t(d), (VALUES (0), (1)) u(r)""")
def parse_opening_hours(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS place_id", "concat(1 + p_partkey % 9, ' AM to 2 PM') AS first")
    old = part.selectExpr("place_id", "0 AS pos", "'Monday, Closed, Copy open hours' AS label", "CAST(NULL AS array<string>) AS cells")
    label = part.selectExpr("place_id", "1 AS pos", "concat('monday, ', first, ', 5 PM to 11 PM, Copy open hours') AS label", "CAST(NULL AS array<string>) AS cells")
    cells = part.selectExpr("place_id", "2 AS pos", "'' AS label", "array('Sunday', concat(first, ', 5 PM - 11 PM'), 'Copy open hours') AS cells")
    return captures.parse_opening_hours(old.unionByName(label).unionByName(cells))


@query("SELECT user_id AS place_id, 'Friday' AS day, CAST(event_id % 24 AS INTEGER) AS hour, CAST(arg_max(least(event_id % 130, 100), event_id) AS INTEGER) AS percent FROM events GROUP BY user_id, event_id % 24")
def parse_popular_times(spark, sf_dir):
    clock = "concat(CASE WHEN event_id % 12 = 0 THEN 12 ELSE event_id % 12 END, CASE WHEN event_id % 24 < 12 THEN ' AM' ELSE ' PM' END)"
    labels = table(spark, sf_dir, "events").selectExpr("user_id AS place_id", "'Fridays' AS day", "event_id AS pos", f"concat(event_id % 130, '% busy at ', {clock}, '.') AS label")
    return captures.parse_popular_times(labels)


@query("SELECT p_partkey AS place_id, 'dining_options' AS section_id, t.pos, name, enabled FROM part, (VALUES (0, 'Dessert', TRUE), (1, 'seating', FALSE), (3, 'Solo dining', TRUE)) t(pos, name, enabled)")
def normalize_about(spark, sf_dir):
    options = spark.createDataFrame([(0, "Serves dessert", "Dessert"), (1, "Does not have seating", ""), (2, "no dessert", None), (3, "  Solo   dining", None), (4, None, " ")], "pos int, label string, visible_text string")
    places = table(spark, sf_dir, "part").selectExpr("p_partkey AS place_id", "'Dining options' AS section")
    return captures.normalize_about(places.crossJoin(F.broadcast(options)))  # a fixture of five rows


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('http://r/', p_partkey) END AS reservation_url, concat('http://o/', p_partkey) AS order_url FROM part")
def action_links(spark, sf_dir):
    one = "CASE WHEN p_partkey % 2 = 0 THEN named_struct('label', 'Reserve a table', 'url', concat('http://r/', p_partkey)) ELSE named_struct('label', 'Menu', 'url', 'http://m') END"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"array({one}, named_struct('label', 'Order online', 'url', concat('http://o/', p_partkey))) AS links")
    return captures.action_links(rows, "links", "reserve|book", "order").select("id", "reservation_url", "order_url")


@query("SELECT p_partkey AS id, concat('u', CASE WHEN p_partkey % 3 = 0 THEN 'h' ELSE '1' END, '=w100') AS thumbnail, CASE WHEN p_partkey % 3 = 0 THEN 'uh=w100,u1=w100,u2=w100' ELSE 'u1=w100,u2=w100' END AS images FROM part")
def assemble_images(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN array('u1=w10', 'u2=w10') END AS preview", "array('u1=w10', 'u2=w10') AS dom", "CASE WHEN p_partkey % 3 = 0 THEN 'uh=w10' END AS hero")
    return captures.assemble_images(rows).select("id", "thumbnail", F.array_join("images", ",").alias("images"))


@query("SELECT place_id, CASE WHEN id % 3 = 0 THEN 'INACTIVE' ELSE visibility END AS visibility, category FROM fx_place")
def apply_overrides(spark, sf_dir):
    places = view(spark, sf_dir, "fx_place").select("place_id", "visibility", "category")
    curated = view(spark, sf_dir, "fx_place").where("id % 3 = 0").selectExpr("place_id", "'INACTIVE' AS visibility", "CAST(NULL AS STRING) AS category")
    return captures.apply_overrides(places, curated, "place_id", ["visibility", "category"])


@query("SELECT place_id, place_id AS id_in, CAST(review_count AS VARCHAR) AS count_in, title AS title_in, visibility AS visibility_in, nullif(link, '') AS link_in FROM fx_place")
def place_payload(spark, sf_dir):
    at = lambda p, to: F.get_json_object("payload", f"$.{p}").alias(to)
    names = ("placeId", "id_in"), ("reviewCount", "count_in"), ("title", "title_in"), ("visibility", "visibility_in"), ("googleMapsLink", "link_in")
    return captures.place_payload(view(spark, sf_dir, "fx_place")).select("place_id", *(at(*n) for n in names))


@query("SELECT place_id, title, category, nullif(link, '') AS link, rating, review_count FROM fx_place")
def place_summary(spark, sf_dir):
    return captures.place_summary(view(spark, sf_dir, "fx_place"))


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)), '') AS canonical,
 len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), ',') AS mails FROM pages""")
def place_info_from_pages(spark, sf_dir):
    return captures.place_info_from_pages(table(spark, sf_dir, "pages")).drop("links")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'TIKTOK' WHEN 1 THEN 'INSTAGRAM' END AS platform, page_id % 3 < 2 AS is_social, page_id % 3 = 0 AS is_carousel, CASE page_id % 3 WHEN 0 THEN concat('https://www.tiktok.com/@u/photo/', page_id) WHEN 1 THEN concat('https://www.instagram.com/p/', page_id) ELSE regexp_replace(url, '[?#].*$', '') END AS canonical FROM pages")
def canonical_social_url(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "CASE page_id % 3 WHEN 0 THEN concat('https://m.tiktok.com/@u/photo/', page_id, '?x=1') WHEN 1 THEN concat('https://www.instagram.com/p/', page_id, '?igsh=2') ELSE url END AS url")
    # every other carousel is known by a short link only, which leads to it
    short = F.expr("CASE WHEN page_id % 6 = 0 THEN concat('https://vt.tiktok.com/', page_id, '/') ELSE url END")
    redirects = rows.where("page_id % 6 = 0").select(short.alias("short_url"), F.col("url").alias("target"))
    return urls.canonical_social_url(rows.withColumn("url", short), "url", redirects).select("page_id", "platform", "is_social", "is_carousel", "canonical")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat('https://maps.example/place/', page_id) ELSE concat('t', page_id) END AS source_url FROM pages")
def resolve_source_url(spark, sf_dir):
    title = "CASE page_id % 3 WHEN 0 THEN url ELSE concat('t', page_id) END AS title"
    link = "CASE page_id % 3 WHEN 2 THEN '' ELSE concat('https://g.example/sorry/index?continue=https%3A%2F%2Fmaps.example%2Fplace%2F', page_id, '&q=1') END AS link"
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", title, link).select("page_id", urls.resolve_source_url(F.col("title"), F.col("link")).alias("source_url"))


@query("SELECT n_name AS location, CAST(n AS INTEGER) AS query_no, q AS query FROM nation, (VALUES (1, 'food'), (2, 'night market'), (3, 'coffee'), (4, 'pho'), (5, 'cafe')) t(n, q)")
def expand_location_queries(spark, sf_dir):
    templates = spark.createDataFrame([(0, "{food} food {region}"), (1, "food"), (2, " night {area} market, "), (3, "coffee"), (4, " {area} ")], "pos int, template string")
    return discovery.expand_location_queries(table(spark, sf_dir, "nation").selectExpr("n_name AS location"), templates, 5, defaults=("food", "pho", "cafe", "rice"))


@query("SELECT p_partkey AS id, CAST(3 AS INTEGER) AS n_lines, concat(1 + p_partkey % 5, ',5 (', p_partkey, ')') AS rating_line, concat(1 + p_partkey % 5, ',5 (', p_partkey, ')') AS reviews_line FROM part")
def parse_hit_text(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat(p_name, ' \n', 1 + p_partkey % 5, ',5 (', p_partkey, ')\n\n', p_name, '\n17 reviews') AS text")
    return discovery.parse_hit_text(rows, "text").select("id", F.size("lines").alias("n_lines"), "rating_line", "reviews_line")


@query("SELECT place_id, CASE WHEN link = '' THEN concat('found', id) ELSE link END AS link, latitude FROM fx_place")
def fill_identity(spark, sf_dir):
    own = view(spark, sf_dir, "fx_place")
    details = own.selectExpr("place_id", "link", "CASE WHEN id % 2 = 0 THEN latitude END AS latitude")
    return discovery.fill_identity(details, own.selectExpr("place_id", "concat('found', id) AS link", "latitude"), "place_id", ["link", "latitude"])


@query("SELECT id, CAST(CASE WHEN rating <= 4.0 THEN 1 ELSE 3 END AS INTEGER) AS n_images, CAST(CASE WHEN rating <= 4.0 THEN 0 ELSE 1 END AS INTEGER) AS n_reviews, CASE WHEN rating <= 4.0 THEN 'INACTIVE' ELSE visibility END AS visibility FROM fx_place")
def inactive_projection(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_place").selectExpr("id", "visibility", "CASE WHEN rating <= 4.0 THEN 'GOOGLE_RATING' END AS reason", "array('a', 'b', 'c') AS images", "array('r') AS reviews")
    return discovery.inactive_projection(rows).select("id", F.size("images").alias("n_images"), F.size("reviews").alias("n_reviews"), "visibility")


@query("SELECT count(*) FILTER (p_partkey % 4 = 0 AND p_partkey % 30 < 20) AS insufficient, count(*) FILTER (p_partkey % 4 IN (1, 2, 3)) AS skipped, count(*) FILTER (p_partkey % 4 = 1) AS rejected_score FROM part")
def classify_import_outcome(spark, sf_dir):
    status = "CASE p_partkey % 4 WHEN 0 THEN 'IMPORTED' WHEN 1 THEN 'SAVED_INACTIVE_ADJUSTED_RATING' WHEN 2 THEN 'SAVED_INACTIVE_OTHER' END AS status"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey % 4 <> 3 AS imported", status, "p_partkey % 30 AS n_reviews")
    return discovery.classify_import_outcome(rows, 20).agg(*(F.count_if(c).alias(c) for c in ("insufficient", "skipped", "rejected_score")))


@query("SELECT id, concat_ws(',', category, 'X', CASE WHEN id % 2 = 0 THEN 'Y' END) AS all_categories FROM fx_place")
def collect_categories(spark, sf_dir):
    raw = "CASE id % 3 WHEN 0 THEN 'not json' WHEN 1 THEN '{\"categories\":[\"X\"]}' END AS raw_data"
    rows = view(spark, sf_dir, "fx_place").selectExpr("id", "category", "array('X', ' ', CASE WHEN id % 2 = 0 THEN ' Y' END, category) AS categories", raw)
    return classify.collect_categories(rows).select("id", F.array_join("all_categories", ",").alias("all_categories"))


FOOD, NOT_FOOD, STAY = "restaurant|coffee|noodle|snack|bar|market", "night market", "hotel|villa"


@query("SELECT id, CASE WHEN category IN ('Coffee shop', 'Seafood restaurant', 'Vietnamese restaurant', 'Snack bar') THEN 'FOOD_AND_DRINK' WHEN category = 'Noodle_shop & bar' THEN 'FOOD_AND_DRINK' WHEN category = 'Hotel' OR id % 5 = 0 THEN 'ACCOMMODATION' ELSE 'ATTRACTIONS' END AS place_group FROM fx_place")
def place_group(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_place").selectExpr("id", "CASE WHEN id % 5 = 0 THEN array(category, 'Villa with restaurant') ELSE array(category) END AS categories")
    return rows.select("id", classify.place_group(F.col("categories"), FOOD, NOT_FOOD, STAY).alias("place_group"))


@query("SELECT id, CASE category WHEN 'Coffee shop' THEN 'CAFE' WHEN 'Noodle_shop & bar' THEN 'NOODLES,NIGHTLIFE' WHEN 'Snack bar' THEN 'NIGHTLIFE' WHEN 'Tourist attraction' THEN 'LANDMARK' WHEN 'Museum' THEN 'HERITAGE' ELSE '' END AS sub_types FROM fx_place")
def sub_types(spark, sf_dir):
    rules = [("CAFE", "coffee|cafe", "internet cafe", None), ("NOODLES", "noodle", None, None), ("NIGHTLIFE", "bar|pub", None, "NIGHTLIFE")]
    rows = view(spark, sf_dir, "fx_place").selectExpr("id", "array(category) AS categories", "CASE category WHEN 'Museum' THEN 'CULTURE_AND_HERITAGE' ELSE 'attractions' END AS place_group")
    return classify.sub_types(rows, "categories", "place_group", rules, {"CULTURE_AND_HERITAGE": "HERITAGE"}, "tourist attraction").select("id", F.array_join("sub_types", ",").alias("sub_types"))


@query("SELECT id, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN concat('Quán ', title) END AS vi, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN title END AS en FROM fx_place")
def title_translations(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_place").selectExpr("id", "title", "CASE WHEN id % 3 = 0 THEN upper(title) ELSE concat('Quán ', title) END AS local_title", "id % 2 = 0 AS in_country")
    return classify.title_translations(rows).select("id", F.try_element_at("translations", F.lit("vi")).alias("vi"), F.try_element_at("translations", F.lit("en")).alias("en"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '[àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ]') THEN 'vi' ELSE 'en' END AS language FROM documents")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.detect_language(F.col("text")).alias("language"))


@query("SELECT event_id AS seq, concat('User ', user_id) AS author, 1 + event_id % 5 AS stars, event_id % 9 AS likes, event_id % 2 = 0 AS is_local_guide, 1000 + event_id AS total_reviews, event_id % 7 AS total_photos FROM events")
def parse_review_snapshot(spark, sf_dir):
    info = "concat(CASE WHEN event_id % 2 = 0 THEN 'Local Guide · ' ELSE '' END, format_number(1000 + event_id, 0), ' reviews · ', event_id % 7, ' photos') AS reviewer_info"
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS seq", "'' AS author", "concat('Photo of User ', user_id) AS profile_label", "concat(1 + event_id % 5, ' stars') AS rating_label", "concat(event_id % 9, ' likes') AS likes_text", info, "array('x=w1', 'x=w1') AS photos")
    return reviews.parse_review_snapshot(rows).select("seq", "author", F.col("rating").cast("bigint").alias("stars"), "likes", "is_local_guide", "total_reviews", "total_photos")


@query("""SELECT review_id AS "reviewId", place_id AS "googlePlaceId", author AS name, rating, total_reviews AS "totalReviews", coalesce(review_date, 'yesterday') AS reviewed_when FROM fx_review""")
def format_reviews(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_review").withColumn("raw_date", F.lit("yesterday"))
    return reviews.format_reviews(rows).select("reviewId", "googlePlaceId", "name", "rating", "totalReviews", F.col("when").alias("reviewed_when"))


@query("""SELECT p_partkey AS place_id, CAST(CASE WHEN ok IS NULL THEN 1 ELSE 0 END AS INTEGER) AS group_no, p_partkey AS pos FROM part LEFT JOIN
 (SELECT user_id, arg_max(event_type <> 'error', event_id) AS ok FROM events GROUP BY user_id) ON user_id = p_partkey WHERE ok IS NULL OR NOT ok""")
def rerun_selection(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("user_id AS place_id", "event_type <> 'error' AS success", "event_id AS seq")
    return refresh.rerun_selection(log, table(spark, sf_dir, "part").selectExpr("p_partkey AS place_id", "p_partkey AS pos"), "FAILED_AND_NOT_EXECUTED")


@query("SELECT conv_id % 20 AS url, role AS model, count(*) AS n_calls, count(*) FILTER (turn % 2 = 0) AS n_ok, count(*) AS n_mentions, count(*) FILTER (turn % 3 = 0) AS n_verified, count(*) FILTER (turn % 3 = 1) AS n_unresolved, count(*) FILTER (turn % 3 = 2) AS n_discarded FROM conversations GROUP BY ALL")
def extraction_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id % 20 AS url", "role AS model", "turn % 2 = 0 AS ok", "CASE turn % 3 WHEN 0 THEN 'EVIDENCE_VERIFIED' WHEN 1 THEN 'UNRESOLVED' ELSE 'DISCARDED' END AS status")
    return ai_log.extraction_eval(rows, rows)


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(replace(strip_accents(lower(coalesce(text, ''))), 'đ', 'd'), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS normal FROM documents")
def match_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(linking.match_text(F.col("text")), 256).alias("normal"))


@query()
def quote_support(spark, sf_dir):
    """Each turn, whole, against the turn before it, and against its own text with every fourth word left out: the ratio has no SQL form."""
    rows = table(spark, sf_dir, "conversations")
    own = rows.selectExpr("conv_id", "turn", "'own' AS against", "text AS quote", "array_join(filter(split(text, ' '), (x, i) -> i % 4 < 3), ' ') AS text")
    prior = rows.selectExpr("conv_id", "turn + 1 AS turn", "text AS before")
    other = rows.join(prior, ["conv_id", "turn"]).selectExpr("conv_id", "turn", "'before' AS against", "text AS quote", "before AS text")
    return linking.quote_support(own.unionByName(other), "quote", "text").select("conv_id", "turn", "against", "supported")


@query("SELECT id, category IN ('Coffee shop', 'Hotel') AS is_generic FROM fx_place")
def generic_name(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_place").selectExpr("id", "concat('Hà Nội ', category) AS name", "'hanoi, ha noi' AS region_hint", "'Ha Noi' AS city_hint", "'' AS country_hint")
    return linking.generic_name(rows, ["coffee shop", "hotel"]).select("id", "is_generic")


EVIDENCE = """SELECT conv_id AS post_id, CASE WHEN turn % 7 = 6 THEN 'generic_or_unnamed_place' WHEN turn % 5 = 4 THEN 'ai_identity_not_confirmed' WHEN turn % 3 = 2 THEN 'confidence_below_threshold'
 WHEN conv_id % 2 = 0 THEN 'accepted' ELSE 'evidence_guardrail_failed' END AS reason, turn AS pos FROM conversations"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    mention = rows.selectExpr(
        "conv_id AS post_id", "turn AS pos", "concat(conv_id, '/', turn) AS mention_id", "'Some Place' AS name", "turn % 7 = 6 AS is_generic", "CASE WHEN turn % 5 = 4 THEN 'guess' ELSE ' Confirmed' END AS identity_status",
        "'exact visible-sign' AS mention_type", "false AS inference_used", "CASE WHEN turn % 3 = 2 THEN 71 ELSE 72 END AS confidence",
    )
    evidence = rows.selectExpr("concat(conv_id, '/', turn) AS mention_id", "'Frame' AS source", "'sign' AS quote", "1 + conv_id % 2 AS frame_index", "1 AS frame_count", "true AS supports_identity", "false AS supported")
    return linking.evidence_decision(mention, evidence)


@query(EVIDENCE)
def evidence_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("post_id", "reason", "pos")


@query(f"SELECT post_id, pos + 1 AS sequence, CASE WHEN reason = 'accepted' THEN 'EVIDENCE_VERIFIED' ELSE 'UNRESOLVED' END AS status FROM ({EVIDENCE}) WHERE reason <> 'generic_or_unnamed_place'")
def retain_mentions(spark, sf_dir):
    return linking.retain_mentions(decided(spark, sf_dir)).select("post_id", "sequence", "status")


@query()
def name_similarity(spark, sf_dir):
    """Places' names against their brand's: the ratio has no SQL form."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS a", "concat(p_type, ' ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' s' ELSE '' END) AS b")
    return linking.name_similarity(rows, "a", "b").select("id", F.round("similarity", 9).alias("similarity"))


@query()
def link_to_catalogue(spark, sf_dir):
    """Mentions of parts (with a word too many) against the parts' names and brands: the ratio has no SQL form."""
    part = table(spark, sf_dir, "part")
    mentions = part.selectExpr("p_partkey AS mention_id", "concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' old' WHEN 1 THEN '' ELSE 'x' END, ' ', p_brand) AS name")
    return linking.link_to_catalogue(mentions, part.selectExpr("p_partkey AS identity", "concat(p_name, ' ', p_brand) AS title"))


@query()
def link_with_hints(spark, sf_dir):
    """As link_to_catalogue, with the brand as a hint of the place's address, and for a third of the mentions the name as an alias."""
    part = table(spark, sf_dir, "part")
    mentions = part.selectExpr("p_partkey AS mention_id", "CASE p_partkey % 3 WHEN 0 THEN 'some place' ELSE p_name END AS name", "CASE p_partkey % 3 WHEN 0 THEN array(p_name) END AS aliases", "array(p_brand) AS hints")
    return linking.link_to_catalogue(mentions, part.selectExpr("p_partkey AS identity", "p_name AS title", "concat(p_brand, ' street') AS address", "p_type AS category"))


@query("""SELECT concat(conv_id, '/', turn) AS mention_id, CASE WHEN turn % 4 = 0 THEN 'missing_map_query' WHEN turn % 4 = 1 THEN 'map_search_failed' WHEN conv_id % 2 = 1 THEN 'weak_or_ambiguous_map_match' END AS reason,
 CASE WHEN turn % 4 > 1 AND conv_id % 2 = 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status FROM conversations""")
def enrich_mentions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "concat(conv_id, '/', turn) AS mention_id", "CASE WHEN turn % 4 = 0 THEN ' ' ELSE 'q' END AS map_query", "turn % 4 = 1 AS search_failed")
    return linking.enrich_mentions(rows, rows.where("conv_id % 2 = 0").selectExpr("mention_id", "1 AS identity", "0.9e0 AS score")).select("mention_id", "reason", "status")


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'DURATION_UNAVAILABLE' WHEN length(text) > 300 THEN 'REJECTED_DURATION' WHEN turn % 2 = 1 THEN 'REJECTED_TOPIC' ELSE 'PROCEED' END AS verdict FROM conversations")
def reject_posts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 5 > 0 THEN length(text) END AS duration", "turn % 2 = 0 AS on_topic")
    return linking.reject_posts(rows, 300).select("conv_id", "turn", "verdict")


@query()
def drop_near_identical(spark, sf_dir):
    """A fold over the frames in order, which SQL has not."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("floor(vec_id / 50) AS video", "vec_id AS pos", "embedding AS vector")
    return linking.drop_near_identical(rows, 0.2, 4)


@query("SELECT conv_id AS post_id, turn AS pos, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2 THEN 'DONE' ELSE 'PENDING' END AS stage, least(2, count(*) OVER (PARTITION BY conv_id)) AS n_done, greatest(0, count(*) OVER (PARTITION BY conv_id) - 2) AS n_pending FROM conversations")
def progress_view(spark, sf_dir):
    return linking.progress_view(table(spark, sf_dir, "conversations").selectExpr("conv_id AS post_id", "turn AS pos"), 2)


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0.9e0 WHEN 3 THEN 0e0 WHEN 4 THEN round(0.6e0 * 2 / 3 + 0.4e0 * 0.5, 9) WHEN 5 THEN 1e0 END AS similarity FROM part""")
def name_similarity_rules(spark, sf_dir):
    """Pairs whose ratio is plain to see: equal beyond case and accents, blank, a subset, without a common letter, half."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 6 WHEN 0 THEN concat('PHỞ ', p_partkey) WHEN 1 THEN ' ' WHEN 2 THEN 'pho hoa' WHEN 3 THEN 'abc' WHEN 4 THEN 'ab' ELSE concat('x-', p_partkey) END AS a",
        "CASE p_partkey % 6 WHEN 0 THEN concat(' pho  ', p_partkey) WHEN 1 THEN p_name WHEN 2 THEN concat('pho hoa quan so ', 100000 + p_partkey) WHEN 3 THEN 'xyz' WHEN 4 THEN 'ab xyz' ELSE concat('X ', p_partkey) END AS b",
    )
    return linking.name_similarity(rows, "a", "b").select("id", F.round("similarity", 9).alias("similarity"))


@query("""SELECT conv_id, turn, turn % 5 IN (0, 2, 4) AS supported FROM conversations""")
def quote_support_rules(spark, sf_dir):
    """Quotes that the words alone decide: contained, too few words of it, four words of five, one word, in other order."""
    quote = "CASE turn % 5 WHEN 0 THEN 'One, TWO three' WHEN 1 THEN 'one x y z' WHEN 2 THEN 'five one x two three' WHEN 3 THEN 'fiv' ELSE 'five four three two one' END AS quote"
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", quote, "'zero one two three four five' AS text")
    return linking.quote_support(rows, "quote", "text").select("conv_id", "turn", "supported")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.86e0 WHEN 2 THEN 1e0 ELSE 0.14e0 END AS score FROM part")
def match_score_rules(spark, sf_dir):
    """Pairs with plain scores: an alias and the whole context, a name with a context that has no letter of the hint, no hints, a hint alone."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN 'qqq' WHEN 3 THEN 'qqq' ELSE concat('abc ', p_partkey) END AS name", "CASE p_partkey % 4 WHEN 0 THEN array('', concat('abc ', p_partkey)) END AS aliases",
        "CASE p_partkey % 4 WHEN 0 THEN array('zzz', concat('street food abc ', p_partkey)) WHEN 1 THEN array('zzz') WHEN 3 THEN array(concat('street food abc ', p_partkey)) END AS hints",
        "concat('ABC ', p_partkey) AS title", "'street' AS address", "'food' AS category",
    )
    return linking.match_score(rows).select("id", F.round("score", 9).alias("score"))


#: Evidence of each source, one or two a mention, with and without a quote, support, identity and a frame in range.
SOURCES = """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'Frame' WHEN 2 THEN 'caption context' ELSE 'slide' END AS source FROM conversations
 UNION ALL SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN ' frame' ELSE 'AUDIO' END FROM conversations WHERE conv_id % 3 = 0"""
TYPES = "CASE turn % 5 WHEN 0 THEN 'explicit audio name' WHEN 1 THEN 'Exact-visible-sign' WHEN 2 THEN 'multimodal_confirmed' WHEN 3 THEN 'creator caption' ELSE 'guessed' END"


@query(f"""WITH e AS (SELECT conv_id, turn, replace(lower(trim(source)), ' ', '_') AS source, (conv_id + turn) % 6 > 0 AS quoted, conv_id % 5 > 0 AS supported, conv_id % 6 > 0 AND (conv_id % 2 = 0 OR conv_id % 6 <= 3) AS framed FROM ({SOURCES}) WHERE (conv_id + turn) % 7 < 6),
 f AS (SELECT conv_id, turn, bool_or(source = 'audio' AND quoted AND supported) AS audio, bool_or(source = 'caption_context' AND quoted AND supported) AS caption, bool_or(source IN ('frame', 'slide') AND quoted AND framed) AS visual FROM e GROUP BY conv_id, turn),
 m AS (SELECT DISTINCT c.conv_id, c.turn, CASE WHEN c.turn % 5 = 0 AND audio THEN 'ai_confirmed_audio' WHEN c.turn % 5 = 1 AND visual THEN 'ai_confirmed_visual' WHEN c.turn % 5 = 2 AND audio AND visual THEN 'ai_confirmed_multimodal' WHEN c.turn % 5 = 3 AND caption THEN 'ai_confirmed_caption' END AS mode
  FROM conversations c LEFT JOIN f ON c.conv_id = f.conv_id AND c.turn = f.turn),
 r AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 'ai_marked_inferred_or_generic' WHEN conv_id % 11 = 0 THEN 'ai_used_identity_inference' WHEN mode IS NULL THEN 'evidence_guardrail_failed' ELSE 'accepted' END AS reason FROM m)
 SELECT conv_id, turn, reason, CASE WHEN reason = 'accepted' THEN mode END AS mode FROM r""")
def evidence_rules(spark, sf_dir):
    """Every type of mention with evidence of every source."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    mention = turns.selectExpr("*", "concat(conv_id, '/', turn) AS mention_id", "'Place' AS name", "FALSE AS is_generic", "'confirmed' AS identity_status", f"{TYPES} AS mention_type", "conv_id % 11 = 0 AS inference_used", "'90' AS confidence")
    evidence = spark.sql(SOURCES.replace("FROM conversations", "FROM {turns}"), turns=turns).selectExpr(
        "concat(conv_id, '/', turn) AS mention_id", "source", "CASE WHEN (conv_id + turn) % 6 > 0 THEN 'q' ELSE ' ' END AS quote", "CAST(conv_id % 6 AS INT) AS frame_index", "CASE WHEN conv_id % 2 > 0 THEN 3 END AS frame_count",
        "(conv_id + turn) % 7 < 6 AS supports_identity", "conv_id % 5 > 0 AS supported",
    )
    return linking.evidence_decision(mention, evidence).select("conv_id", "turn", "reason", "mode")


WORDS = {"spark": r"filter(split(regexp_replace(lower(text), '[^a-z0-9_]+', ' '), ' '), x -> x <> '')", "duckdb": r"list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '')"}


@query(f"SELECT doc_id, doc_id % 4 < 2 AS supported FROM (SELECT doc_id, {WORDS['duckdb']} AS w FROM documents WHERE lang = 'en' AND regexp_matches(text, '^[\\x00-\\x7F]*$')) WHERE len(w) >= 8")
def quote_support_in_documents(spark, sf_dir):
    """Whole documents against quotes of their own words: a run of four, four of five in other order, one of five, a word that no document has."""
    docs = table(spark, sf_dir, "documents").where(r"lang = 'en' AND text RLIKE '^[\\x00-\\x7F]*$'").selectExpr("doc_id", "text", f"{WORDS['spark']} AS w").where("size(w) >= 8")
    quote = "CASE doc_id % 4 WHEN 0 THEN array_join(slice(w, 2, 4), ', ') WHEN 1 THEN concat_ws(' ', w[7], 'zzqx', w[5], w[3], w[1]) WHEN 2 THEN concat_ws(' ', w[1], 'zzqx', 'zzqy', 'zzqz', 'zzqv') ELSE 'zzqx' END AS quote"
    return linking.quote_support(docs.selectExpr("doc_id", "text", quote), "quote", "text").select("doc_id", "supported")
