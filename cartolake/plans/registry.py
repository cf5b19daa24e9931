"""The registered queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.operators import ai_log, classify, discovery, mentions, refresh, reviews, urls
from cartolake.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FOOD = ["restaurant", "noodle", "coffee", "snack"]

#: Views in the words of both engines; {d:name} is a table.
PLACE = """SELECT concat('ChIJ', p_partkey) AS place_id, p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'Coffee shop' WHEN 1 THEN 'Barber shop' WHEN 2 THEN 'Hotel'
  WHEN 3 THEN 'Buddhist temple' WHEN 4 THEN 'Seafood restaurant' WHEN 5 THEN 'Night market' WHEN 6 THEN 'Vietnamese restaurant' WHEN 7 THEN 'Museum'
  WHEN 8 THEN 'Noodle_shop & bar' WHEN 9 THEN 'Tourist attraction' WHEN 10 THEN 'Snack bar' ELSE 'Amusement park' END AS category,
  8.5e0 + (p_partkey % 1500) / 100e0 AS latitude, 102.5e0 + ((p_partkey * 37) % 700) / 100e0 AS longitude, 1 + ((p_partkey * 13) % 41) / 10e0 AS rating,
  (p_partkey * 97) % 400 AS review_count, p_name AS title, CASE p_partkey % 4
  WHEN 0 THEN concat('https://www.google.com/maps/place/A+B%20', p_partkey, '/@', 8.5e0 + (p_partkey % 1500) / 100e0, ',105.25,15z/data=!1s0x31752:0x', p_partkey, 'a!hl=vi?hl=vi&x=1')
  WHEN 1 THEN 'https://www.google.com/maps/@10.5,106.5,15z' WHEN 2 THEN concat('https://example.com/', p_partkey) ELSE '' END AS link,
  CASE WHEN p_partkey % 5 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS visibility FROM part"""
HIT = """SELECT concat('ChIJ', l_partkey) AS place_id, '' AS cid, '' AS link, '' AS resolved_url, n_name AS region, n_nationkey AS region_no, l_orderkey % 20 AS query_no,
  l_linenumber AS hit_rank, l_orderkey, l_suppkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
REVIEW = """SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('r', event_id % 4000) END AS review_id, event_id AS seq, concat('ChIJ', user_id) AS place_id, event_type AS author,
  event_id % 7 AS rating, event_id % 3 AS n_images, event_id % 60 - 5 AS total_reviews, event_id % 130 AS total_photos, event_id % 2 = 0 AS is_local_guide,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '4 days ago' ELSE '2024-05-06' END AS review_date, props AS text FROM events"""
RUNS = """SELECT user_id AS worker, event_id AS seq, event_type = 'error' OR event_type = 'view' AS blocked, event_type = 'signup' AS raised FROM events"""
MENTION = """SELECT conv_id AS post_id, turn AS pos, concat(conv_id, '/', turn) AS mention_id, CASE WHEN turn % 2 = 0 THEN '' ELSE concat('c', conv_id % 5) END AS candidate_ref, role, text,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN 'EVIDENCE_VERIFIED' ELSE 'UNRESOLVED' END AS status, CASE WHEN turn % 4 = 1 THEN 'generic' END AS reason FROM conversations"""
#: A pair of URLs of each shape; the id that the pair holds is in place_key.
PAIR = """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN concat('https://maps.app.goo.gl/s', p_partkey) WHEN 1 THEN concat('https://maps.google.com/?q=x&cid=', p_partkey, '#f')
  WHEN 2 THEN concat('https://maps.google.com/?ftid=ChIJaaaaaaaaaaaa', 10000000 + p_partkey) WHEN 6 THEN concat('https://goo.gl/maps/q', p_partkey, '/?a=b') WHEN 8 THEN 'https://goo.gl/maps/lost'
  ELSE concat('https://example.com/', p_partkey) END AS original, CASE p_partkey % 9
  WHEN 0 THEN concat('https://www.google.com/maps/place/X/@10,106,15z/data=!1sChIJabcdefghijklmnop', 1000000 + p_partkey, '!8m2')
  WHEN 2 THEN concat('https://www.google.com/maps/place/X/@-10.5,106/data=!1s0x31:0x', p_partkey, 'a!3d1.5!4d2.5') WHEN 3 THEN concat('https://www.google.com/maps/place/X/ChAJ0123456789abcdef', 10000000 + p_partkey, '?x=1')
  WHEN 4 THEN concat('https://www.google.com/maps/place/X/data=!4m2!16s%2Fg%2F11b', p_partkey, '_x') WHEN 5 THEN concat('https://www.google.com/maps/place/X/data=!1s0x31752:0x', p_partkey, 'b!3d10.25!4d106')
  WHEN 7 THEN concat('https://www.google.com/maps/place/X/data=!1sChIJshort', p_partkey, '!3d1.2.3!4d5') WHEN 8 THEN concat('https://www.google.com/maps?ftid=0x5:0x6&CID=1&cid=%20', p_partkey) END AS resolved,
  CASE p_partkey % 9 WHEN 0 THEN concat('ChIJabcdefghijklmnop', 1000000 + p_partkey) WHEN 1 THEN concat('cid:', p_partkey) WHEN 2 THEN concat('ChIJaaaaaaaaaaaa', 10000000 + p_partkey)
  WHEN 3 THEN concat('ChAJ0123456789abcdef', 10000000 + p_partkey) WHEN 4 THEN concat('g:11b', p_partkey, '_x') WHEN 5 THEN concat('0x31752:0x', p_partkey, 'b') WHEN 6 THEN concat('short:q', p_partkey)
  WHEN 7 THEN 'url' WHEN 8 THEN concat('cid:', p_partkey) END AS place_key FROM part"""
VIEWS = {"fx_pair": PAIR, "fx_place": PLACE, "fx_hit": HIT, "fx_review": REVIEW, "fx_runs": RUNS, "fx_mention": MENTION}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables that it names."""
    sql, frames = VIEWS[name], {}
    for t in ("part", "lineitem", "supplier", "nation", "events", "conversations"):
        if f" {t}" in sql:
            sql, frames[t] = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}"), spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **frames)


def query(sql: str | None = None):
    """Registers a query; its SQL may read the fixture views."""

    def register(make: Callable) -> Callable:
        QUERIES[make.__name__] = make
        if sql:
            used = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in sql]
            SQL[make.__name__] = (f"WITH {', '.join(used)} " if used else "") + sql
        return make

    return register


FOOD_SQL = "(" + " OR ".join(f"contains(lower(category), '{m}')" for m in FOOD) + ")"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = view(spark, sf_dir, "fx_hit")
    first = discovery.dedupe_candidates(hits, ["region_no", "query_no", "hit_rank", "l_orderkey", "l_suppkey", "l_partkey"])
    places = view(spark, sf_dir, "fx_place")
    known = discovery.exclude_existing(first.select("key", "region"), places.where("id % 7 = 0").select(F.col("place_id").alias("key")))
    met = known.join(places.withColumnRenamed("place_id", "key"), "key")
    judged = met.withColumn("reason", discovery.filter_reason(discovery.food_gate(F.col("category"), FOOD, F.expr("CASE WHEN id % 9 = 1 THEN 'food_and_drink' ELSE 'OTHER' END")), 101, 4.0))
    # what the import answered for the eligible ones
    eligible = ~F.col("is_known") & F.col("reason").isNull()
    answered = judged.withColumns({
        "imported": eligible & F.expr("id % 3 > 0"), "status": F.expr("CASE id % 5 WHEN 0 THEN 'SAVED_INACTIVE_ADJUSTED_RATING' WHEN 1 THEN 'SAVED_INACTIVE' ELSE 'IMPORTED' END"),
        "n_reviews": F.expr("id % 4"), "failed": eligible & F.expr("id % 31 = 0"),
    })
    return discovery.classify_import_outcome(answered, 2).withColumn("skipped", eligible & F.col("skipped"))


FUNNEL = f"""SELECT region, count(*) AS discovered, count(*) FILTER (known OR fits AND (id % 3 = 0 OR id % 5 <= 1)) AS skipped, count(*) FILTER (fits AND id % 3 > 0) AS imported,
 count(*) FILTER (fits AND id % 31 = 0) AS failed, count(*) FILTER (fits AND id % 3 > 0 AND id % 5 = 0) AS rejected_score, count(*) FILTER (fits AND id % 3 > 0 AND id % 5 > 1 AND id % 4 < 2) AS insufficient_photo, count(*) FILTER (NOT known AND reason IS NULL) AS eligible,
 count(*) FILTER (NOT known AND reason = 'NON_FOOD') AS non_food, count(*) FILTER (NOT known AND reason = 'REVIEW_COUNT') AS low_reviews,
 count(*) FILTER (NOT known AND reason = 'GOOGLE_RATING') AS low_rating
 FROM (SELECT h.region, p.id, p.id % 7 = 0 AS known, CASE WHEN NOT ({FOOD_SQL} OR p.id % 9 = 1) THEN 'NON_FOOD' WHEN review_count < 101 THEN 'REVIEW_COUNT' WHEN rating <= 4.0 THEN 'GOOGLE_RATING' END AS reason,
  p.id % 7 > 0 AND ({FOOD_SQL} OR p.id % 9 = 1) AND review_count >= 101 AND rating > 4.0 AS fits FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY region_no, query_no, hit_rank, l_orderkey, l_suppkey, l_partkey) AS n FROM fx_hit) h
  JOIN fx_place p USING (place_id) WHERE n = 1) GROUP BY ROLLUP (region)"""


@query(FUNNEL)
def discovery_funnel(spark, sf_dir):
    return discovery.crawl_counters(outcomes(spark, sf_dir))


@query("SELECT place_id, region FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY region_no, query_no, hit_rank, l_orderkey, l_suppkey, l_partkey) AS n FROM fx_hit) WHERE n = 1")
def dedupe_candidates(spark, sf_dir):
    return discovery.dedupe_candidates(view(spark, sf_dir, "fx_hit"), ["region_no", "query_no", "hit_rank", "l_orderkey", "l_suppkey", "l_partkey"]).select("place_id", "region")


HAVERSINE = "2 * 6371.0088 * atan2(sqrt(a), sqrt(1 - a))"
HALF = "pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)"


@query(f"SELECT place_id, round(d, 3) AS distance_km FROM (SELECT place_id, {HAVERSINE} AS d FROM (SELECT place_id, {HALF.format(lat1='16.0', lng1='106.0', lat2='latitude', lng2='longitude')} AS a FROM fx_place)) WHERE d <= 300")
def within_radius(spark, sf_dir):
    return discovery.within_radius(view(spark, sf_dir, "fx_place"), 16.0, 106.0, 300.0).select("place_id", "distance_km")


@query(f"SELECT place_id, center_id, round(d, 3) AS distance_km FROM (SELECT place_id, center_id, {HAVERSINE} AS d FROM (SELECT p.place_id, c.s_suppkey AS center_id, {HALF.format(lat1='c_lat', lng1='c_lng', lat2='latitude', lng2='longitude')} AS a FROM fx_place p JOIN (SELECT s_suppkey, 8.5e0 + (s_suppkey % 15) AS c_lat, 102.5e0 + (s_suppkey % 7) AS c_lng FROM supplier) c ON TRUE)) WHERE d <= 25")
def radius_join(spark, sf_dir):
    centers = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS center_id", "8.5e0 + (s_suppkey % 15) AS c_lat", "102.5e0 + (s_suppkey % 7) AS c_lng")
    return discovery.radius_join(view(spark, sf_dir, "fx_place"), centers, 25.0).select("place_id", "center_id", F.round("distance_km", 3).alias("distance_km"))


@query("SELECT lower(n_name) AS code, CAST(row_number() OVER (ORDER BY 70 + (n_nationkey * 7) % 31 DESC, n_name) AS INTEGER) AS sequence_no FROM nation")
def select_regions(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("lower(n_name) AS code", "n_name AS name", "70 + (n_nationkey * 7) % 31 AS priority")
    return discovery.select_regions(own).select("code", "sequence_no")


@query("""SELECT lower(n_name) AS code, CAST(row_number() OVER (PARTITION BY n_name ORDER BY pos) AS INTEGER) AS query_no, CASE pos WHEN 0 THEN concat('food in ', n_name) ELSE concat('night market, ', n_name) END AS query
 FROM nation CROSS JOIN (VALUES (0), (1)) t(pos)""")
def expand_region_queries(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("lower(n_name) AS code", "n_name AS name")
    templates = spark.createDataFrame([(0, "food in {region}"), (1, "night market"), (2, "food in {region}")], "pos int, template string")
    return discovery.expand_region_queries(own, templates, 20)


@query("""SELECT query, link, CAST(r AS INTEGER) AS hit_rank FROM (SELECT query, link, row_number() OVER (PARTITION BY query ORDER BY hit_rank, hit_id) AS r FROM (SELECT concat(region, '/', query_no) AS query, place_id AS link, hit_rank, concat(l_orderkey, '/', l_suppkey, '/', l_partkey) AS hit_id,
 row_number() OVER (PARTITION BY concat(region, '/', query_no), place_id ORDER BY hit_rank, concat(l_orderkey, '/', l_suppkey, '/', l_partkey)) AS n FROM fx_hit) WHERE n = 1) WHERE r <= 40""")
def rank_hits(spark, sf_dir):
    hits = view(spark, sf_dir, "fx_hit").selectExpr("concat(region, '/', query_no) AS query", "place_id AS link", "hit_rank AS rank", "concat(l_orderkey, '/', l_suppkey, '/', l_partkey) AS hit_id")
    return discovery.rank_hits(hits, 40).selectExpr("query", "link", "rank AS hit_rank")


MAPS_RE = r"'(?i)https?://((www\.)?google\.com/maps|maps\.google\.com|maps\.app\.goo\.gl|goo\.gl/maps)'"
#: Links with and without a name, views with and without a zoom, other hosts, a URL inside a text.
LINK = """CASE id % 8 WHEN 0 THEN concat('https://www.google.com/maps/place//@1,', id) WHEN 1 THEN concat('HTTP://google.com/maps/place/?q=', id) WHEN 2 THEN 'https://www.google.com/maps/@10,106.5,15z' WHEN 3 THEN 'https://www.google.com/maps/@10,106.5'
 WHEN 4 THEN concat('https://www.google.com/maps/place/X', id, '/place') WHEN 5 THEN concat('https://www.google.de/maps/', id) WHEN 6 THEN concat('see https://goo.gl/maps/', id) ELSE link END"""


@query(f"SELECT id, id % 8 <= 4 OR id % 8 = 6 OR regexp_matches(link, {MAPS_RE}) AND id % 8 = 7 AS is_maps_url, id % 8 = 2 OR id % 8 = 7 AND contains(link, '/maps/@') AS is_viewport_url, id % 8 <= 1 AS is_missing_name FROM fx_place")
def classify_map_url(spark, sf_dir):
    return urls.classify_map_url(view(spark, sf_dir, "fx_place").withColumn("link", F.expr(LINK)), "link").select("id", "is_maps_url", "is_viewport_url", "is_missing_name")


@query("""SELECT id, CASE id % 9 WHEN 2 THEN concat('0x31:0x', id, 'a') WHEN 5 THEN concat('0x31752:0x', id, 'b') END AS data_id,
 CASE id % 9 WHEN 0 THEN 10e0 WHEN 2 THEN -10.5e0 WHEN 5 THEN 10.25e0 END AS lat, CASE id % 9 WHEN 0 THEN 106e0 WHEN 2 THEN 106e0 WHEN 5 THEN 106e0 WHEN 7 THEN 5e0 END AS lng,
 CASE id % 9 WHEN 2 THEN CAST(CAST(concat('0x', id, 'a') AS UBIGINT) AS VARCHAR) WHEN 5 THEN CAST(CAST(concat('0x', id, 'b') AS UBIGINT) AS VARCHAR) WHEN 8 THEN CAST(id AS VARCHAR) END AS cid FROM fx_pair""")
def parse_url_parts(spark, sf_dir):
    lat, lng = urls.parse_coords(F.col("resolved"))
    return view(spark, sf_dir, "fx_pair").select("id", urls.parse_data_id(F.col("resolved")).alias("data_id"), lat.alias("lat"), lng.alias("lng"), urls.parse_cid(F.col("resolved")).alias("cid"))


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN concat('A B ', id) END AS title FROM fx_place""")
def decode_title_from_url(spark, sf_dir):
    return view(spark, sf_dir, "fx_place").select("id", urls.decode_title(F.col("link")).alias("title"))


@query("SELECT id, place_key FROM fx_pair")
def parse_place_identity(spark, sf_dir):
    """Every shape of a pair of URLs; a hash is shown without its digits."""
    key = urls.parse_place_identity(F.col("original"), F.col("resolved"))
    return view(spark, sf_dir, "fx_pair").select("id", F.regexp_replace(key, "^url:.*$", "url").alias("place_key"))


@query("SELECT place_id, trim(replace(replace(category, '_', ' '), '&', 'and')) AS category, CASE WHEN latitude > 8 AND latitude < 24 AND longitude > 102 AND longitude < 110 THEN 'Asia/Saigon' ELSE 'UTC' END AS timezone FROM fx_place")
def normalize_places(spark, sf_dir):
    return classify.infer_locale(view(spark, sf_dir, "fx_place")).select("place_id", classify.normalize_category(F.col("category")).alias("category"), "timezone")


@query("""SELECT id, CASE WHEN id % 13 = 2 THEN 'VIEWPORT_URL' WHEN id % 13 = 3 THEN 'MISSING_NAME' WHEN id % 7 = 6 THEN 'SCRAPE_FAILED' WHEN id % 8 = 1 THEN 'BLANK_TITLE' WHEN id % 8 IN (0, 4) THEN 'GENERIC_TITLE'
 WHEN id % 8 = 3 THEN 'URL_TITLE' END AS reject_reason FROM fx_place WHERE id % 13 BETWEEN 2 AND 4 OR NOT contains(link, '/maps/@')""")
def place_gate(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_place").withColumns({
        "title": F.expr("CASE id % 8 WHEN 0 THEN ' Dropped   Pin' WHEN 1 THEN ' ' WHEN 2 THEN 'Httpster' WHEN 3 THEN 'HTTPS://x' WHEN 4 THEN 'this location' ELSE title END"),
        "link": F.expr("CASE id % 13 WHEN 2 THEN 'https://google.com/maps/@10,106.5,15.5z' WHEN 3 THEN 'https://www.google.com/maps/place//@1,2' WHEN 4 THEN 'https://www.google.com/maps/@10,106' ELSE link END"),
        "scrape_status": F.expr("CASE WHEN id % 7 = 6 THEN 'Failed' END"),
    }).where("id % 13 BETWEEN 2 AND 4 OR link NOT LIKE '%/maps/@%'")
    return classify.place_gate(rows).select("id", "reject_reason")


@query("SELECT id, rating AS x, review_count AS n FROM fx_place")
def parse_numbers(spark, sf_dir):
    text = F.concat(F.col("rating").cast("string"), F.lit(" stars"))
    count = F.concat(F.lit("("), F.format_number("review_count", 0), F.lit(" reviews)"))
    return view(spark, sf_dir, "fx_place").select("id", classify.first_float(text).alias("x"), classify.first_int(count).alias("n"))


@query("SELECT review_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY place_id, review_id ORDER BY seq) AS n FROM fx_review) WHERE n = 1 OR review_id = ''")
def dedupe_reviews(spark, sf_dir):
    return reviews.dedupe_reviews(view(spark, sf_dir, "fx_review")).select("review_id", "seq")


@query("""SELECT seq, round(0.15 * (CASE WHEN length(trim(text)) > 0 THEN 1 ELSE 0 END) + 0.25 * least(length(trim(text)) / 200e0, 1) + 0.25 * (CASE WHEN n_images > 0 THEN 1 ELSE 0 END)
 + 0.35 * (greatest(least(total_reviews / 50e0, 1), 0) + least(total_photos / 100e0, 1) + CASE WHEN is_local_guide THEN 1 ELSE 0 END) / 3 + 1e-9, 4) AS authenticity_score FROM fx_review""")
def authenticity_score(spark, sf_dir):
    return reviews.authenticity_score(view(spark, sf_dir, "fx_review")).select("seq", "authenticity_score")


@query("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY place_id ORDER BY seq) AS n FROM fx_review WHERE n_images > 0) WHERE n <= 50")
def recent_reviews_with_images(spark, sf_dir):
    return reviews.recent_reviews_with_images(view(spark, sf_dir, "fx_review"), 0).select("seq")


@query("SELECT seq, content_hash FROM (SELECT seq, sha256(concat(author, '|', rating, '|', coalesce(trim(text), ''), '|', coalesce(nullif(trim(review_date), ''), '1970-01-01'))) AS content_hash, row_number() OVER (PARTITION BY place_id ORDER BY seq) AS n FROM fx_review WHERE review_id <> '' AND author <> '' AND rating BETWEEN 1 AND 5) WHERE n <= 20")
def scoring_reviews(spark, sf_dir):
    return reviews.scoring_reviews(view(spark, sf_dir, "fx_review"), 20).select("seq", "content_hash")


@query("SELECT seq, sha256(concat(review_id, '|', rating, '|', coalesce(trim(text), ''), '|', CASE WHEN starts_with(review_date, '2024') THEN review_date ELSE '2024-06-01' END)) AS content_hash FROM fx_review WHERE review_id <> '' AND author <> '' AND rating BETWEEN 1 AND 5 AND n_images > 0")
def refresh_reviews(spark, sf_dir):
    return reviews.refresh_reviews(view(spark, sf_dir, "fx_review"), "2024-06-01").select("seq", "content_hash")


@query("SELECT place_id, count(*) AS n_reviews, count(*) FILTER (review_id = '') AS no_id, count(*) FILTER (author = '') AS no_author, count(*) FILTER (coalesce(trim(text), '') = '') AS no_text, count(*) FILTER (seq % 3 = 0) AS no_profile_url FROM fx_review GROUP BY place_id")
def review_quality_report(spark, sf_dir):
    return reviews.review_quality_report(view(spark, sf_dir, "fx_review").withColumn("profile_url", F.expr("CASE seq % 6 WHEN 0 THEN ' ' WHEN 3 THEN NULL ELSE 'https://u' END")))


@query(rf"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY link ORDER BY id) AS n FROM fx_place WHERE visibility = 'ACTIVE' AND regexp_matches(link, {MAPS_RE}) AND NOT contains(link, '/maps/@')) WHERE n = 1")
def detail_refresh_candidates(spark, sf_dir):
    return refresh.detail_refresh_candidates(view(spark, sf_dir, "fx_place")).select("id")


STREAK = """SELECT worker, seq, CAST(streak AS BIGINT) AS streak, CASE WHEN blocked THEN CASE streak WHEN 2 THEN 60 WHEN 3 THEN 300 WHEN 4 THEN 900 END END AS wait_s, blocked AND streak > 4 AS stop FROM
 (SELECT *, sum(CASE WHEN blocked THEN 1 ELSE 0 END) OVER (PARTITION BY worker, island ORDER BY seq) AS streak FROM
 (SELECT *, sum(CASE WHEN NOT blocked AND NOT raised THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY seq) AS island FROM fx_runs))"""


@query(STREAK)
def block_streaks(spark, sf_dir):
    return refresh.block_streaks(view(spark, sf_dir, "fx_runs")).select("worker", "seq", "streak", "wait_s", "stop")


@query("SELECT worker, count(*) AS processed, count(*) FILTER (NOT blocked AND NOT raised) AS succeeded, count(*) FILTER (blocked OR raised) AS failed, bool_and(NOT blocked AND NOT raised) AS all_succeeded FROM fx_runs GROUP BY worker")
def refresh_report(spark, sf_dir):
    return refresh.refresh_report(view(spark, sf_dir, "fx_runs"))


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY user_id")
def job_latest_state(spark, sf_dir):
    return refresh.job_latest_state(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnsRenamed({"user_id": "job_id", "event_type": "status"}))


@query("SELECT post_id, count(*) AS n_input, count(*) FILTER (status = 'EVIDENCE_VERIFIED') AS n_verified, count(*) FILTER (status = 'UNRESOLVED') AS n_unresolved, count(reason) AS n_reasons FROM fx_mention GROUP BY post_id")
def validation_summary(spark, sf_dir):
    return mentions.validation_summary(view(spark, sf_dir, "fx_mention")).drop("n_rejected", "reasons")


@query("""SELECT post_id, pos, CASE WHEN n = 1 THEN base ELSE concat(base, '-', lpad(CAST(pos + 1 AS VARCHAR), 4, '0')) END AS ref FROM (SELECT *, row_number() OVER (PARTITION BY post_id, base ORDER BY pos) AS n FROM
 (SELECT *, coalesce(nullif(candidate_ref, ''), concat('social-', lpad(CAST(pos + 1 AS VARCHAR), 4, '0'))) AS base FROM fx_mention))""")
def unique_refs(spark, sf_dir):
    return mentions.unique_refs(view(spark, sf_dir, "fx_mention")).select("post_id", "pos", "ref")


@query("SELECT conv_id, turn, greatest(0e0, least(1e0, CASE WHEN x > 1 AND x <= 100 THEN x / 100 ELSE x END)) AS confidence FROM (SELECT conv_id, turn, CAST(length(text) AS DOUBLE) / 5 AS x FROM conversations)")
def mention_confidence(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", mentions.confidence((F.length("text") / 5.0).cast("string")).alias("confidence"))


@query("""SELECT mention_id, identity, round(score, 4) AS score FROM (SELECT *, row_number() OVER w AS n, lead(identity) OVER w AS other, lead(score) OVER w AS next_score
 FROM (SELECT l_orderkey AS mention_id, l_partkey % 50 AS identity, l_quantity / 50 AS score, l_partkey * 100000 + l_suppkey AS pos FROM lineitem)
 WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, pos, identity)) WHERE n = 1 AND score >= 0.68 AND (other IS NULL OR other = identity OR score - next_score >= 0.08)""")
def resolve_matches(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS mention_id", "l_partkey % 50 AS identity", "l_quantity / 50 AS score", "l_partkey * 100000 + l_suppkey AS pos")
    return mentions.resolve_matches(pairs)


@query("SELECT conv_id, turn, lower(role) AS provider, CASE WHEN turn % 2 = 0 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, length(text) AS input_tokens, turn AS cached_tokens, 3 AS output_tokens FROM conversations")
def ai_call_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    usage = F.to_json(F.struct(F.struct(F.length("text").alias("prompt_tokens"), F.struct(F.col("turn").alias("cached_tokens")).alias("prompt_tokens_details"), F.lit(3).alias("completion_tokens")).alias("usage")))
    calls = rows.select(F.struct("conv_id", "turn").alias("trace_id"), F.upper("role").alias("provider"), (F.col("turn") % 2 == 0).alias("ok"), F.lit(5).alias("latency_ms"), usage.alias("response"))
    return ai_log.ai_call_rows(calls).select("trace_id.conv_id", "trace_id.turn", "provider", "status", "input_tokens", "cached_tokens", "output_tokens")


@query("SELECT id, scope, only_source FROM (SELECT id FROM fx_place WHERE id % 4 = 0) CROSS JOIN (VALUES ('places', NULL), ('translations', 'LEGACY')) t(scope, only_source)")
def title_corrections(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_place").select("id", F.col("link").alias("old"), urls.decode_title(F.col("link")).alias("new"))
    return files.title_corrections(rows).select("id", "scope", "only_source")


@query("SELECT concat('ChIJ', p_partkey) AS key, CASE p_partkey % 4 WHEN 0 THEN 'DELIVERED' WHEN 1 THEN 'ALREADY_DELIVERED' WHEN 2 THEN 'FAILED' ELSE 'PENDING' END AS delivery FROM part")
def import_outbox(spark, sf_dir):
    keys = view(spark, sf_dir, "fx_place").selectExpr("place_id AS key", "id")
    answers = keys.where("id % 4 < 3").selectExpr("key", "CASE id % 4 WHEN 0 THEN 200 WHEN 1 THEN 409 ELSE 500 END AS http_status", "'' AS code")
    return files.import_outbox(keys.select("key"), answers)
