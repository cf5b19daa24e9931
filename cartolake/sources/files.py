"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: the lines of text files, without blank ones and those that begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_place_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per place of exports {generated_at, count, places: [...]}; schema: of a place."""
    whole = spark.read.schema(f"generated_at string, count long, places array<struct<{schema}>>").json(path, multiLine=True)
    return whole.select(F.inline("places"))


def write_place_export(places: DataFrame, path: str) -> None:
    """JSON lines with missing arrays and maps filled with empty ones."""
    filled = {c: F.coalesce(c, F.from_json(F.lit("{}" if t.startswith("map") else "[]"), t)) for c, t in places.dtypes if t.startswith(("map", "array"))}
    places.withColumns(filled).write.mode("append").json(path)


def import_outbox(payloads: DataFrame, responses: DataFrame) -> DataFrame:
    """payloads (key, perhaps payload and known) with delivery: DELIVERED, ALREADY_DELIVERED, FAILED, or PENDING without a
    response (key, http_status, code); where there is a payload also with method and request_key.

    method is PUT where known says that the receiver has the place, else POST. request_key is the same for the same key and
    payload, so that a receiver can tell a repeat from a change.
    """
    if "payload" in payloads.columns:
        known = F.coalesce(F.col("known"), F.lit(False)) if "known" in payloads.columns else F.lit(False)
        payloads = payloads.withColumns({"method": F.when(known, "PUT").otherwise("POST"), "request_key": F.sha2(F.concat_ws("|", F.col("key").cast("string"), F.col("payload").cast("string")), 256)})
    done = F.when(F.col("http_status").isin(200, 201), "DELIVERED").when((F.col("http_status") == 409) | (F.col("code") == "ALREADY_PROCESSED"), "ALREADY_DELIVERED")
    return payloads.join(responses, "key", "left").withColumn("delivery", F.coalesce(done, F.when(F.col("http_status").isNull(), "PENDING"), F.lit("FAILED"))).drop("http_status", "code")


def title_corrections(places: DataFrame) -> DataFrame:
    """Two corrections a place (id, old, new): its title, and its translation in the default locale, if that came from source
    LEGACY (only_source): one that somebody has edited stays."""
    scopes = F.array(F.struct(F.lit("places").alias("scope"), F.lit(None).cast("string").alias("only_source")), F.struct(F.lit("translations").alias("scope"), F.lit("LEGACY").alias("only_source")))
    return places.where("new IS NOT NULL AND old <> new").select("id", "old", "new", F.inline(scopes))


def unwrap_place_list(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(places, rejects) of JSON texts: a list, {data: [...]}, or {data: {items | content | places: [...]}}."""
    paths = ("$", "$.data", "$.data.items", "$.data.content", "$.data.places")
    lists = [F.get_json_object(column, p) for p in paths]
    rows = raw.withColumn("list_", F.coalesce(*(F.when(F.trim(x).startswith("["), x) for x in lists)))
    items = rows.where("list_ IS NOT NULL").select(F.explode(F.from_json("list_", "array<string>")).alias("item")).where(F.trim("item").startswith("{"))
    return items.select(F.from_json("item", schema).alias("p")).select("p.*"), rows.where("list_ IS NULL").drop("list_")


def read_search_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(templates: pos, template; foods: region, food) of a JSON file {templates: [...], foods: {region: [...]}}."""
    whole = spark.read.schema("templates array<string>, foods map<string,array<string>>").json(path, multiLine=True)
    foods = whole.select(F.explode("foods").alias("region", "list")).select("region", F.explode("list").alias("food"))
    return whole.select(F.posexplode("templates").alias("pos", "template")), foods


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """code, name, priority, tourist_areas of a JSON file, a list of regions."""
    return spark.read.schema("code string, name string, priority int, tourist_areas array<string>").json(path, multiLine=True)
