"""A stream of captures of place pages to several tables, which show a batch wholly or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from cartolake.functions.text import first_truthy
from cartolake.operators import captures as own
from cartolake.operators.classify import first_float, first_int, infer_locale, place_gate
from cartolake.operators.urls import parse_place_identity

#: Columns of a capture; those that are missing count as null.
CAPTURE = {
    "capture_no": "long", "place_id": "string", "title": "string", "link": "string", "resolved_url": "string", "category": "string", "scrape_status": "string", "visibility": "string", "place_group": "string",
    "latitude": "double", "longitude": "double", "rating_text": "string", "reviews_text": "string", "address": "string", "phone": "string", "plus_code": "string", "price_range": "string",
    "current_open_status": "string", "status": "string", "actions": "string", "hero": "string", "preview": "array<string>", "dom": "array<string>", "stars": "array<string>",
    "hours": "array<struct<label:string,cells:array<string>>>", "popular": "array<struct<day:string,label:string>>", "about": "array<struct<section:string,label:string,visible_text:string>>",
    "links": "array<struct<label:string,url:string>>",
}
TABLES = ("places", "hours", "popular_times", "about", "images", "rejects")
RESERVE, ORDER = "reserv|book", "order|deliver"


def with_all_columns(captures: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in CAPTURE.items() if c not in captures.columns}
    return captures.withColumns(missing) if missing else captures


def listed(places: DataFrame, column: str) -> DataFrame:
    """place_id, pos and the fields of an array of structs, a row an element."""
    return places.select("place_id", F.posexplode(column).alias("pos", "x")).select("place_id", "pos", "x.*")


def day_map(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """place_id and a map of days, from rows that have a value each."""
    days = rows.groupBy("place_id", "day").agg(value.alias("value"))
    by_day = lambda x, y: F.when(x["day"] < y["day"], -1).when(x["day"] > y["day"], 1).otherwise(0)
    return days.groupBy("place_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "value")), by_day)).alias(name))


def judged_captures(captures: DataFrame) -> DataFrame:
    """Normalised captures, the last one of each place, with reject_reason. A capture without an identity of its own is known
    by its URLs; one without either has a null place_id and goes its own way."""
    rows = own.normalize_info(with_all_columns(captures))
    found = F.when(first_truthy(F.col("link"), F.col("resolved_url")).isNotNull(), parse_place_identity(F.coalesce("link", F.lit("")), F.coalesce("resolved_url", F.lit(""))))
    rows = rows.withColumns({"place_id": F.coalesce(first_truthy(F.col("place_id")), found), "rating": first_float(F.col("rating_text")), "review_count": first_int(F.col("reviews_text"))})
    last = F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc_nulls_last("capture_no"), F.xxhash64(*(c for c, t in rows.dtypes if "map<" not in t))))
    one = rows.where("place_id IS NOT NULL").withColumn("n_", last).where("n_ = 1").drop("n_")
    return place_gate(one.unionByName(rows.where("place_id IS NULL")))


def place_tables(judged: DataFrame, curated: DataFrame | None = None, curated_columns: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of judged captures: places (with payload), hours, popular_times, about, images and rejects.

    curated: place_id and curated_columns, whose values win. Works on tables and on batches of a stream alike.
    """
    good = judged.where("reject_reason IS NULL").drop("reject_reason")
    # rows without an identity have no rows of their own in the other tables
    named = good.where("place_id IS NOT NULL")
    hours, popular = own.parse_opening_hours(listed(named, "hours")), own.parse_popular_times(listed(named, "popular"))
    about = own.normalize_about(listed(named, "about"))
    stars = own.rating_breakdown(named.select("place_id", F.posexplode("stars").alias("pos", "label")))
    pictured = own.assemble_images(good)
    merged = own.merge_rating_summary(
        pictured.withColumn("breakdown", F.lit(None).cast("map<string,bigint>")),
        stars.select("place_id", F.lit(None).cast("double").alias("new_rating"), F.lit(None).cast("long").alias("new_review_count"), F.col("breakdown").alias("new_breakdown")),
    )
    options = about.groupBy("place_id", "section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "enabled"))), lambda x: F.struct(x["name"].alias("name"), x["enabled"].alias("enabled"))).alias("options"))
    sections = options.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct(F.col("section_id").alias("id"), "options"))).alias("about"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("range_no", "hours"))), lambda x: x["hours"])
    by_hour = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("hour").cast("string"), "percent"))))
    whole = own.action_links(own.normalize_menu(merged, "actions"), "links", RESERVE, ORDER).drop("hours", "popular", "about").withColumnsRenamed({"orders": "order_online"})
    for extra in (day_map(hours, in_order, "open_hours"), day_map(popular.where("hour >= 0"), by_hour, "popular_times"), sections):
        whole = whole.join(extra, "place_id", "left")
    whole = infer_locale(whole)
    if curated is not None:
        whole = own.apply_overrides(whole, curated, "place_id", curated_columns or [])
    places = whole.withColumn("payload", F.to_json(own.payload_fields(whole)))
    return {
        "places": places, "hours": hours, "popular_times": popular, "about": about,
        "images": pictured.where("place_id IS NOT NULL").select("place_id", F.posexplode("images").alias("pos", "url")), "rejects": judged.where("reject_reason IS NOT NULL"),
    }


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def ingest_places(stream: DataFrame, root: str, checkpoint: str, curated: DataFrame | None = None, curated_columns: list[str] | None = None) -> StreamingQuery:
    """Every batch of captures to the tables in root, by way of root/staged, and last a marker of its own in root/commits.

    Readers go by the markers (committed), so a batch that was ended between two tables shows nowhere. When it runs again, its
    folders are written anew and nothing is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        staged = f"{root}/staged/batch_no={number}"
        write_table(judged_captures(batch), staged)
        judged = batch.sparkSession.read.parquet(staged)
        for name, rows in place_tables(judged, curated, curated_columns).items():
            write_table(rows, f"{root}/{name}/batch_no={number}")
        write_table(batch.sparkSession.range(1).select(F.lit(number).alias("number")), f"{root}/commits/batch_no={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table, with batch_no, of batches that are whole."""
    done = spark.read.parquet(f"{root}/commits").select("batch_no").distinct()
    return spark.read.parquet(f"{root}/{table}").join(done, "batch_no", "left_semi")


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table that belong to the last whole batch in which their place came."""
    last = committed(spark, root, "places").where("place_id IS NOT NULL").groupBy("place_id").agg(F.max("batch_no").alias("batch_no"))
    return committed(spark, root, table).join(last, ["place_id", "batch_no"], "left_semi")
