"""A Parquet table that takes changes by key: applied twice they give what they give once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table: a change rewrites those that hold its keys.
BUCKETS = 64


def manifest(spark: SparkSession, path: str) -> dict[int, int]:
    """The valid version of each bucket; empty for a table that isn't there. As many numbers as the table has buckets."""
    try:
        rows = spark.read.schema("part int, version int, number int").parquet(f"{path}/manifests")
        return {r["part"]: r["version"] for r in rows.where(F.col("number") == rows.agg(F.max("number")).first()[0]).collect()}
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def folders(path: str, versions: dict[int, int]) -> list[str]:
    return [f"{path}/data/part={p}/version={v}" for p, v in sorted(versions.items())]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table's last whole version."""
    return spark.read.option("basePath", f"{path}/data").parquet(*folders(path, manifest(spark, path))).drop("part", "version")


def commit(spark: SparkSession, path: str, rows: DataFrame, before: dict[int, int]) -> None:
    """rows (with part) as a new version of their buckets; then the manifest, by which readers go, so that what a run
    that was ended before it has written counts for nothing and is written over by the next."""
    number = max(before.values(), default=0) + 1
    rows.withColumn("version", F.lit(number)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(f"{path}/data")
    fresh = spark.read.parquet(f"{path}/data").where(F.col("version") == number).select("part").distinct().collect()  # BUCKETS at most
    now = before | {r["part"]: number for r in fresh}
    spark.createDataFrame([(p, v) for p, v in sorted(now.items())], "part int, version int").write.mode("overwrite").parquet(f"{path}/manifests/number={number}")


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def upsert(path: str, changes: DataFrame, key: str, order: str = "changed_at", only: Column | None = None, insert: bool = True, buckets: int = BUCKETS) -> int:
    """Applies changes (key, order and any of the table's columns) to the table in path; returns how many took effect.

    Of changes to one key the last by order counts, and it takes effect where it is newer than the row's own order, so
    repeats and stragglers change nothing. Columns that changes don't have keep their value. only: a further condition over
    old.* and new.*, for keys that the table has. insert: whether new keys come in; they have nulls where changes lack a
    column. A change without a key goes. A table keeps the columns, the buckets and the key it began with; one writer at
    a time.
    """
    spark, before = changes.sparkSession, manifest(changes.sparkSession, path)
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*changes.columns), F.struct(order)).alias("new")).select("new.*").withColumn("part", bucket(key, buckets))
    if not before:
        rows = last if insert else last.limit(0)
        n = rows.count()
        if n:
            commit(spark, path, rows, before)
        return n
    old = read_table(spark, path)
    whole = old.withColumn("part", bucket(key, buckets)).alias("old").join(last.alias("new"), key, "full")
    known, given = F.col("old.part").isNotNull(), F.col("new.part").isNotNull()
    newer = F.col(f"old.{order}").isNull() | (F.col(f"new.{order}") > F.col(f"old.{order}"))
    fits = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    takes = F.when(~given, False).when(known, newer & fits).otherwise(F.lit(insert))
    merged = {c: F.when(takes, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in changes.columns else F.col(f"old.{c}") for c in old.columns if c != key}
    kept = whole.where(known | takes).select(key, *(v.cast(old.schema[c].dataType).alias(c) for c, v in merged.items()), F.coalesce("old.part", "new.part").alias("part"), takes.alias("takes_"))
    touched = {r["part"]: r["n"] for r in kept.where("takes_").groupBy("part").agg(F.count("*").alias("n")).collect()}  # BUCKETS at most
    if touched:
        commit(spark, path, kept.where(F.col("part").isin(list(touched))).select(*old.columns, "part"), before)
    return sum(touched.values())


def apply_corrections(places: str, translations: str, corrections: DataFrame, changed_at: Column) -> tuple[int, int]:
    """Brings title_corrections (id, new, scope, only_source) into the tables of places (id, title, changed_at) and of
    translations (id, name, source, changed_at); how many took effect in each. Only translations of the correction's source change."""
    own = corrections.withColumn("changed_at", changed_at)
    titles = own.where("scope = 'places'").select("id", F.col("new").alias("title"), "changed_at")
    names = own.where("scope = 'translations'").select("id", F.col("new").alias("name"), "only_source", "changed_at")
    of_source = F.col("new.only_source").isNull() | (F.col("old.source") == F.col("new.only_source"))
    return upsert(places, titles, "id", insert=False), upsert(translations, names, "id", only=of_source, insert=False)


def record_responses(outbox: str, delivered: DataFrame) -> int:
    """Brings import_outbox's rows (request_key, delivery, attempt and others) into the table of requests: one row a
    request_key, the last attempt's. A request that was delivered stays so, whatever a later attempt says."""
    done = F.col("old.delivery").isin("DELIVERED", "ALREADY_DELIVERED")
    return upsert(outbox, delivered, "request_key", "attempt", only=~F.coalesce(done, F.lit(False)))
