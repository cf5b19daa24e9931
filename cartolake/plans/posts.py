"""Registered queries of posts, model output, matches, model calls and streams, with their SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions.storage import scratch
from cartolake.operators import ai_log, extraction, linking, mentions
from cartolake.plans.captures import table
from cartolake.plans.registry import STREAK, query, view
from cartolake.streaming import events as stream_events
from cartolake.streaming import ingest, jobs


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(trim(text)) > 5 THEN sha256(trim(text)) ELSE sha256('short') END AS caption, CASE WHEN doc_id % 3 = 0 THEN concat('p', doc_id) END AS tag,
 'own' AS uploader, 't1' AS thumbnail FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS text FROM documents)""")
def social_context(spark, sf_dir):
    """Posts with a short caption; the page's own one is the document's text, where the platform has such pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text"))
    posts = docs.selectExpr(
        "doc_id AS post_id", "'' AS extractor_key", "'x' AS extractor", "' T ' AS title", "' ' AS thumbnail", "array('', 't1', 't2') AS thumbnails", "'short' AS description",
        "CAST(NULL AS STRING) AS uploader", "'own' AS channel", "5 AS duration", "concat(CASE doc_id % 3 WHEN 0 THEN 'https://www.TikTok.com/@u/video/' ELSE 'https://x.example/' END, doc_id) AS webpage_url", "'' AS original_url",
    )
    pages = docs.selectExpr("doc_id AS post_id", "text AS caption", "concat('p', doc_id) AS name", "'' AS address", "'C' AS city", "'' AS province", "'' AS category")
    rows = extraction.social_context(posts, pages)
    return rows.select(F.col("post_id").alias("doc_id"), F.sha2("caption", 256).alias("caption"), F.col("tagged_location.name").alias("tag"), "uploader", F.col("thumbnail_url").alias("thumbnail"))


#: Model output around a page's id: fenced, with words around it, without a comma, unreadable.
OUTPUT = (
    r"""CASE page_id % 4 WHEN 0 THEN concat('```json\n{"a":', page_id, '}\n```') WHEN 1 THEN concat('Here: {"a":', page_id, '} as asked') """
    r"""WHEN 2 THEN concat('{"a":', page_id, '\n  "b":2}') ELSE '{"a":' END AS output"""
)


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN CAST(page_id AS VARCHAR) END AS a, page_id % 4 = 2 AS repaired FROM pages")
def parse_ai_output(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", OUTPUT)
    return extraction.parse_ai_output(rows, "output").select("page_id", F.get_json_object("json", "$.a").alias("a"), "repaired")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'ITINERARY' ELSE 'PLACE_LIST' END AS content_type, CASE WHEN turn > 0 THEN CAST(turn AS INTEGER) END AS duration_days, 1e0 AS duration_confidence,
 CAST(2 AS INTEGER) AS n_candidates, concat('n', conv_id) AS query, CASE WHEN turn > 0 THEN CAST(turn AS INTEGER) ELSE 1 END AS sequence, CAST(2 AS INTEGER) AS next_sequence, 'EXACT_VISIBLE_SIGN' AS mention_type, 'alias' AS aliases, 'frame' AS sources, TRUE AS supports FROM conversations""")
def normalize_extraction(spark, sf_dir):
    """An object per turn with two candidates and an element that is none."""
    evidence = '[{"source":" Frame","quote":" q ","frame_index":"2","supports_identity":"Yes"},{"source":"frame"},5]'
    json = F.concat(
        F.lit('{"contentType":"'), F.when(F.col("turn") % 2 == 0, " itinerary").otherwise("other"), F.lit('","durationDays":'), F.col("turn").cast("string"), F.lit(',"durationConfidence":"7","candidates":[{"name":" n'),
        F.col("conv_id").cast("string"), F.lit('","sequence":'), F.col("turn").cast("string"), F.lit(f',"mention_type":"exact visible-sign","aliases":" alias ","evidence":{evidence}}},7,{{"name":"second"}}]}}'),
    )
    rows = extraction.normalize_extraction(table(spark, sf_dir, "conversations").select("conv_id", "turn", json.alias("json")), "json")
    first, second = F.col("extraction.candidates")[0], F.col("extraction.candidates")[1]
    return rows.select(
        "conv_id", "turn", "extraction.content_type", "extraction.duration_days", "extraction.duration_confidence", F.size("extraction.candidates").alias("n_candidates"), first["query"].alias("query"),
        first["sequence"].alias("sequence"), second["sequence"].alias("next_sequence"), first["mention_type"].alias("mention_type"), F.array_join(first["aliases"], ",").alias("aliases"),
        F.array_join(first["evidence_sources"], ",").alias("sources"), first["evidence"][0]["supports_identity"].alias("supports"),
    )


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN concat(p_name, ' Hanoi') ELSE concat(p_name, ' ', p_brand, ' Hanoi') END AS map_query FROM part")
def map_query(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE ' ' END AS query", "' ' AS name", "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE concat(' ', p_brand) END AS a", "'Hanoi' AS b", "'hanoi' AS c")
    return mentions.map_query(rows, ["a", "b", "c"]).select("id", "map_query")


@query()
def match_score(spark, sf_dir):
    """Parts' names and brands against the next part's: the ratio has no SQL form."""
    part = table(spark, sf_dir, "part")
    near = part.selectExpr("p_partkey + 1 AS p_partkey", "concat(p_name, ' ', p_brand) AS title", "p_type AS address", "CAST(p_size AS STRING) AS category")
    own = part.selectExpr("p_partkey", "p_name AS name", "CASE WHEN p_partkey % 2 = 0 THEN array(concat(p_brand, ' ', p_name)) END AS aliases", "CASE WHEN p_partkey % 3 > 0 THEN array(p_type, ' ') END AS hints")
    return linking.match_score(own.join(near, "p_partkey")).select(F.col("p_partkey").alias("id"), F.round("score", 9).alias("score"))


@query("""SELECT p_partkey AS video_id, CAST(k AS INTEGER) AS frame_no, CASE WHEN d = 1 THEN 0.5e0 WHEN 1 + 3 * k = d THEN d - 0.05e0 ELSE 1e0 + 3 * k END AS at_s
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 40 + 1 END AS d FROM part), range(0, 10) r(k) WHERE CASE WHEN d = 1 THEN k = 0 ELSE d IS NULL OR 1 + 3 * k <= d END""")
def frame_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS video_id", "CASE WHEN p_partkey % 9 > 0 THEN CAST(p_partkey % 40 + 1 AS DOUBLE) END AS duration")
    return mentions.frame_grid(rows, 3, 10).select("video_id", "frame_no", "at_s")


@query("""SELECT conv_id AS mention_id, CAST(arg_min(1 + turn % 6, CASE WHEN turn % 3 = 0 THEN turn ELSE 1000 + turn END) AS BIGINT) AS frame_index FROM conversations WHERE turn % 4 < 3 AND 1 + turn % 6 <= 4 GROUP BY conv_id""")
def evidence_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id AS mention_id", "turn AS ev_no", "CASE turn % 4 WHEN 3 THEN 'audio' WHEN 2 THEN ' Slide' ELSE 'FRAME' END AS source", "turn % 3 = 0 AS supports", "1 + turn % 6 AS frame_index", "4 AS frame_count")
    return mentions.evidence_frame(rows).select("mention_id", F.col("frame_index").cast("long").alias("frame_index"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('<base64 ', 512 + page_id % 7, ' chars>') WHEN 1 THEN 'a <data-url 86 chars> b <data-url 96 chars>' ELSE url END AS payload FROM pages""")
def redact_payload(spark, sf_dir):
    inline = "concat('a data:image/png;base64,', repeat('A', 64), ' b data:image/png;base64,', repeat('B', 74))"
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"CASE page_id % 3 WHEN 0 THEN repeat('Q', CAST(512 + page_id % 7 AS INT)) WHEN 1 THEN {inline} ELSE url END AS payload")
    return ai_log.redact_payload(rows, "payload")


def replay(spark: SparkSession, rows: DataFrame, tag: str) -> DataFrame:
    """rows written to the shared folder and read as a stream."""
    path = scratch(spark, tag)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, tag: str) -> DataFrame:
    """All that a stream in append mode gives for the data there are, as a table."""
    path = scratch(spark, tag)
    with jobs.state_store(spark):
        out = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def totalled(spark: SparkSession, stream: DataFrame, tag: str) -> DataFrame:
    """What a stream in complete mode says after the data there are, as a table; every batch writes it anew."""
    path = scratch(spark, tag)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("SELECT user_id AS job_id, count(*) AS n_events, sum(event_id % 3) AS imported FROM events GROUP BY user_id")
def live_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS job_id", "event_id % 3 AS imported")
    return totalled(spark, stream_events.live_counters(replay(spark, rows, "counted")), "counters")


#: Files that a part of a replay has.
FILES = 2


def replay_in_parts(spark: SparkSession, rows: DataFrame, order: str, tag: str, parts: int = 4) -> DataFrame:
    """rows as a stream of `parts` batches by falling age: each has its share of the range of order, a Column's text."""
    path, key = scratch(spark, tag), F.expr(order)
    edges = rows.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)]).alias("at")).first()["at"] or []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        above = F.lit(True) if low is None else key > low
        rows.where(above if high is None else above & (key <= high)).repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def changes(spark: SparkSession, stream: DataFrame, tag: str, mode: str = "update") -> DataFrame:
    """What every batch of a stream gave, with batch_no; a batch that runs again writes its folder anew."""
    path = scratch(spark, tag)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch_no={number}")
    with jobs.state_store(spark):
        out = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(stream.schema.add("batch_no", "integer")).parquet(f"{path}/out")


#: Events of jobs (users) and their regions; one type ends a job or region.
JOB_EVENT = ["user_id AS job_id", "CASE event_id % 3 WHEN 1 THEN 'north' WHEN 2 THEN 'south' END AS region", "event_type AS status", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "event_id % 7 AS progress"]


@query("""SELECT user_id AS job_id, CASE event_id % 3 WHEN 1 THEN 'north' WHEN 2 THEN 'south' ELSE '' END AS region, arg_max(event_type, (event_type = 'purchase', ts, event_id)) AS status,
 arg_max(event_id % 7, (event_type = 'purchase', ts, event_id)) AS progress FROM events GROUP BY 1, 2""")
def live_job_state(spark, sf_dir):
    """The last state that the stream told of each job and region; an event of one type ends it. Four batches."""
    rows = table(spark, sf_dir, "events").selectExpr(*JOB_EVENT)
    told = changes(spark, jobs.live_job_state(replay_in_parts(spark, rows, "unix_micros(ts)", "states"), ("purchase",), keep_hours=24 * 60), "job-states")
    last = told.groupBy("job_id", "region").agg(F.max_by(F.struct("status", "progress"), "batch_no").alias("last"))
    return last.select("job_id", "region", "last.status", "last.progress")


@query("""WITH own AS (SELECT user_id AS job_id, CASE event_id % 3 WHEN 1 THEN 'north' WHEN 2 THEN 'south' ELSE '' END AS region, date_trunc('hour', ts) AS h, event_id % 7 AS progress FROM events),
 over AS (SELECT * FROM own WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
 SELECT job_id, region, CAST(epoch_ms(h) / 1000 AS BIGINT) AS started, count(*) AS n_events, CAST(sum(progress) AS BIGINT) AS progress FROM over GROUP BY GROUPING SETS ((job_id, region, h), (job_id, h))""")
def live_region_counters(spark, sf_dir):
    """Windows that are over, of regions and of jobs, from four batches in which every event comes twice."""
    rows = table(spark, sf_dir, "events").selectExpr(*JOB_EVENT)
    stream = replay_in_parts(spark, rows.unionByName(rows), "unix_micros(ts)", "windows")
    told = changes(spark, jobs.window_counters(stream, ["progress"]), "window-counters", "append")
    return told.select("job_id", "region", F.unix_seconds("window_start").alias("started"), "n_events", "progress")


@query("""WITH done AS (SELECT conv_id, CAST(arg_max(turn / 2, turn) AS INTEGER) AS n FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id),
 listed AS (SELECT DISTINCT conv_id, turn FROM conversations), numbered AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM listed)
 SELECT l.conv_id AS post_id, CAST(l.turn AS INTEGER) AS sequence, concat(l.conv_id, '/', l.turn) AS name, CASE WHEN l.n <= coalesce(d.n, 0) THEN 'DONE' ELSE 'PENDING' END AS status,
 CAST(least(coalesce(d.n, 0), total) AS INTEGER) AS n_done, CAST(total - least(coalesce(d.n, 0), total) AS INTEGER) AS n_pending FROM numbered l LEFT JOIN done d ON d.conv_id = l.conv_id""")
def live_progress_stream(spark, sf_dir):
    """The last list that the stream told of each post, from four batches of mentions and reports."""
    turns = table(spark, sf_dir, "conversations")
    mentioned = turns.selectExpr("conv_id AS post_id", "turn AS seq", "turn AS sequence", "concat(conv_id, '/', turn) AS name", "CAST(NULL AS STRING) AS stage", "CAST(NULL AS INT) AS done")
    reports = turns.where("turn % 2 = 0").selectExpr("conv_id AS post_id", "1000 + turn AS seq", "CAST(NULL AS INT) AS sequence", "CAST(NULL AS STRING) AS name", "role AS stage", "CAST(turn / 2 AS INT) AS done")
    stream = replay_in_parts(spark, mentioned.selectExpr("post_id", "CAST(seq AS BIGINT) AS seq", "CAST(sequence AS INT) AS sequence", "name", "stage", "done").unionByName(reports.withColumn("seq", F.col("seq").cast("long"))), "seq % 1000", "mentions")
    told = changes(spark, jobs.live_progress(stream), "progress")
    last = told.groupBy("post_id").agg(F.max("batch_no").alias("batch_no"))
    return told.join(last, ["post_id", "batch_no"]).select("post_id", "sequence", "name", "status", "n_done", "n_pending")


@query("SELECT event_id, count(*) AS n FROM events GROUP BY event_id")
def dedupe_events_stream(spark, sf_dir):
    """Every event sent twice comes once."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    once = drained(spark, stream_events.dedupe_events(replay(spark, rows.unionByName(rows), "sent")), "deduped")
    return once.groupBy("event_id").agg(F.count("*").alias("n"))


@query(STREAK)
def block_guard_stream(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_runs").selectExpr("CAST(worker AS BIGINT) AS worker", "CAST(seq AS BIGINT) AS seq", "blocked", "raised")
    return drained(spark, stream_events.live_block_guard(replay(spark, rows, "runs")), "guard")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 1 THEN concat(p_name, ' street') END AS address, CASE p_partkey % 5 WHEN 0 THEN 'BLANK_TITLE' WHEN 1 THEN 'GENERIC_TITLE' END AS reject_reason FROM part")
def ingest_places_stream(spark, sf_dir):
    """Captures through the stream; the places and the rejects that come out of it."""
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Dropped pin' ELSE p_name END AS title", "'' AS link", "concat('Address: ', p_name, ' street') AS address",
        *(f"'' AS {c}" for c in ("phone", "plus_code", "price_range", "current_open_status", "status")),
    )
    stream, out = replay(spark, part, "captures"), scratch(spark, "ingested")
    ingest.ingest_places(stream, out, f"{out}/state").awaitTermination()
    good = ingest.committed(spark, out, "places").selectExpr("id", "address", "CAST(NULL AS STRING) AS reject_reason")
    bad = ingest.committed(spark, out, "rejects").selectExpr("id", "CAST(NULL AS STRING) AS address", "reject_reason")
    return good.unionByName(bad)


@query("""WITH own AS (SELECT p_partkey AS id, concat('ChIJ', p_partkey) AS place_id, p_name, p_partkey % 20 + 1 AS h FROM part WHERE p_partkey % 7 > 0)
 SELECT place_id, 'places' AS kind, concat(4.5 - id % 3, ' ', id % 500, ' ', upper(p_name)) AS value FROM own WHERE id % 11 > 0
 UNION ALL SELECT place_id, 'places', concat(4.5 - id % 3, ' ', id % 500, ' curated') FROM own WHERE id % 11 = 0
 UNION ALL SELECT place_id, 'hours', concat('Monday 0 ', h, ' AM - 10 PM') FROM own WHERE h <= 12
 UNION ALL SELECT place_id, 'popular_times', concat('Tuesday 12 ', least(100, id % 150)) FROM own
 UNION ALL SELECT place_id, 'about', concat('service 0 ', CASE WHEN id % 2 = 0 THEN 'delivery' ELSE 'Delivery' END, ' ', CASE WHEN id % 2 = 0 THEN 'false' ELSE 'true' END) FROM own
 UNION ALL SELECT place_id, 'images', concat('0 p', id) FROM own UNION ALL SELECT place_id, 'images', concat('1 q', id) FROM own
 UNION ALL SELECT concat('ChIJ', p_partkey), 'rejects', 'GENERIC_TITLE' FROM part WHERE p_partkey % 7 = 0""")
def ingest_place_tables_stream(spark, sf_dir):
    """Captures with nested labels through the stream in four batches; what the tables hold of whole batches, as text."""
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS capture_no", "concat('ChIJ', p_partkey) AS place_id", "CASE WHEN p_partkey % 7 = 0 THEN 'Dropped pin' ELSE upper(p_name) END AS title", "concat('https://example.com/', p_partkey) AS link",
        "concat(4.5 - p_partkey % 3, ' stars') AS rating_text", "concat('(', p_partkey % 500, ' reviews)') AS reviews_text", "array(concat('p', p_partkey), concat('q', p_partkey)) AS preview",
        "array(struct(concat('Monday, ', CASE WHEN p_partkey % 20 < 12 THEN concat(p_partkey % 20 + 1, ' AM to 10 PM, ') ELSE '' END, 'Copy open hours') AS label, CAST(NULL AS ARRAY<STRING>) AS cells)) AS hours",
        "array(struct('Tuesdays' AS day, concat(p_partkey % 150, '% busy at 12 PM.') AS label)) AS popular",
        "array(struct('Service' AS section, CASE WHEN p_partkey % 2 = 0 THEN 'No delivery' ELSE 'Delivery' END AS label, '' AS visible_text)) AS about",
    )
    out = scratch(spark, "ingested")
    curated = part.where("capture_no % 11 = 0").selectExpr("place_id", "'curated' AS title")
    ingest.ingest_places(replay_in_parts(spark, part, "capture_no", "nested-captures"), out, f"{out}/state", curated, ["title"]).awaitTermination()
    values = {
        "places": "concat(rating, ' ', review_count, ' ', title)", "hours": "concat(day, ' ', range_no, ' ', hours)", "popular_times": "concat(day, ' ', hour, ' ', percent)",
        "about": "concat(section_id, ' ', pos, ' ', name, ' ', enabled)", "images": "concat(pos, ' ', url)", "rejects": "reject_reason",
    }
    return reduce(DataFrame.unionByName, (ingest.committed(spark, out, t).selectExpr("place_id", f"'{t}' AS kind", f"{v} AS value") for t, v in values.items()))
