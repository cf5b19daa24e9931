"""Refresh selection, run analysis and the job log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions.text import first_truthy
from cartolake.operators.urls import classify_map_url


def detail_refresh_candidates(catalogue: DataFrame, include_inactive: bool = False, most: int | None = None) -> DataFrame:
    """Places with a valid map URL that is no viewport, the first of each URL by id; with most, so many by id."""
    own = classify_map_url(catalogue, "link").where("is_maps_url AND NOT is_viewport_url")
    own = own if include_inactive else own.where("visibility = 'ACTIVE'")
    first = own.groupBy(F.trim("link").alias("url_")).agg(F.min_by(F.struct(*catalogue.columns), "id").alias("first_")).select("first_.*")
    return first.orderBy("id").limit(most) if most and most > 0 else first


def review_refresh_candidates(catalogue: DataFrame, now: str, max_age_hours: int, most: int, ids: list | None = None, include_recent: bool = False, ranked: str | None = None) -> DataFrame:
    """Active places that were never scraped or not since the cutoff, the oldest first.

    With ids only those places, whatever their age; with include_recent all, whatever their age. ranked names a column by
    which their source has ordered them: then that order counts, and no age.
    """
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(max(1, max_age_hours)))
    own = classify_map_url(catalogue, "link").where("is_maps_url AND NOT is_viewport_url AND visibility = 'ACTIVE'")
    if ranked:
        return own.select(*catalogue.columns).orderBy(F.asc_nulls_last(ranked), "id").limit(most)
    if ids:
        own = own.where(F.col("id").cast("string").isin([str(i) for i in ids]))
    due = own if ids or include_recent else own.where(F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") <= cutoff))
    return due.select(*catalogue.columns).orderBy(F.asc_nulls_first("last_scraped_at"), "id").limit(most)


def block_streaks(run_log: DataFrame, waits: tuple[int, ...] = (60, 300, 900), free: int = 1) -> DataFrame:
    """Per worker: the running count of blocked rows, the wait after each and whether the run stops there.

    A row that is neither blocked nor raised ends a streak; a raised one leaves it as it is.
    """
    upto = Window.partitionBy("worker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(~F.col("blocked") & ~F.col("raised"), 1).otherwise(0)).over(upto)
    rows = run_log.withColumn("island", island)
    within = Window.partitionBy("worker", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(F.col("blocked").cast("int")).over(within)
    wait = F.get(F.array(*map(F.lit, waits)), (F.col("streak") - free - 1).cast("int"))
    return rows.withColumn("streak", streak).withColumn("wait_s", F.when(F.col("blocked"), wait)).withColumn("stop", F.col("blocked") & (F.col("streak") > free + len(waits))).drop("island")


def refresh_report(run_log: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Per worker: processed, succeeded, failed, all_succeeded.

    With selection (worker, is_eligible: a row for each place of the catalogue) also in_database and eligible, and a row for a
    worker that has processed nothing yet, for which all_succeeded is null.
    """
    ok = ~F.col("blocked") & ~F.col("raised")
    done = run_log.groupBy("worker").agg(F.count("*").alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.bool_and(ok).alias("all_succeeded"))
    if selection is None:
        return done
    sizes = selection.groupBy("worker").agg(F.count("*").alias("in_database"), F.count_if("is_eligible").alias("eligible"))
    names = ["in_database", "eligible", "processed", "succeeded", "failed"]
    return sizes.join(done, "worker", "full").select("worker", *(F.coalesce(c, F.lit(0)).alias(c) for c in names), "all_succeeded")


def job_latest_state(events: DataFrame) -> DataFrame:
    """Per job: the status of the last event and the times of the first and last."""
    last = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(F.max_by("status", last).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events"))


def job_retention(jobs: DataFrame, now: str, ttl_hours: int, most: int) -> DataFrame:
    """jobs with kept: active ones, and the `most` newest of the finished ones that are young enough.

    A job's time is finished_at, else created_at, else now. The newest are found as a top-k, whose size is a parameter.
    """
    at = F.coalesce("finished_at", "created_at", F.lit(now).cast("timestamp"))
    active = F.coalesce(F.lower("status").isin("pending", "running"), F.lit(False))
    young = at >= F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(ttl_hours))
    newest = jobs.where(~active & young).orderBy(at.desc(), F.desc("job_id")).limit(most).select("job_id", F.lit(True).alias("newest_"))
    return jobs.join(newest, "job_id", "left").withColumn("kept", active | F.coalesce("newest_", F.lit(False))).drop("newest_")


#: Types of jobs whose result is shown as it is; of the first only a failed one shows its error, of the others any that has one.
SINGLE_RAW = ("social-location-extract",)
BATCH_RAW = ("scrape-and-import-batch", "place-detail-refresh", "place-review-refresh", "nationwide-place-import")
#: Fields of a result that are shown where they are there.
OPTIONAL_FIELDS = ("reviewsPublished", "contributorsAdded")


def job_poll_view(jobs: DataFrame, optional: tuple[str, ...] = OPTIONAL_FIELDS) -> DataFrame:
    """job_id, status, created_at, started_at, completed_at, error_code, error_message, result: what a poll of a job shows.

    jobs: job_id, job_type, status, created_at, started_at, finished_at, error (a text, or JSON with a code), result (JSON).
    The code is the error's own, else SCRAPE_FAILED or IMPORT_FAILED by what the result says, else JOB_FAILED. The result
    of a job of one place is a summary with importStatus, once the job is over; that of others is as it is.
    """
    at = lambda path: F.get_json_object("result", path)
    none = F.lit(None).cast("string")
    own = first_truthy(F.when(F.trim("error").startswith("{"), F.get_json_object("error", "$.code")))
    scrape, upload, text = first_truthy(at("$.scrapeError")), first_truthy(at("$.upload.error")), F.when(~F.trim("error").startswith("{"), first_truthy(F.col("error")))
    code = F.when(own.isNotNull(), own).when(scrape.isNotNull(), "SCRAPE_FAILED").when(upload.isNotNull(), "IMPORT_FAILED").otherwise("JOB_FAILED")
    message = F.when(own.isNotNull(), F.get_json_object("error", "$.message")).otherwise(F.coalesce(scrape, upload, text, F.lit("Unknown error")))
    failed = F.col("status") == "failed"
    shows = F.when(F.col("job_type").isin(*BATCH_RAW), first_truthy(F.col("error")).isNotNull()).otherwise(failed)
    flag = lambda path: F.coalesce(F.lower(at(path)) == "true", F.lit(False))
    summary = F.to_json(F.struct(
        F.coalesce(first_truthy(at("$.googlePlaceId"), at("$.place.placeId")), F.lit("")).alias("googlePlaceId"), F.coalesce(first_truthy(at("$.title"), at("$.place.title")), F.lit("")).alias("title"),
        flag("$.placeAlreadyExists").alias("placeAlreadyExists"), F.when(flag("$.success"), "success").otherwise("failed").alias("importStatus"),
        F.coalesce(at("$.importHttpStatus"), at("$.upload.statusCode")).try_cast("int").alias("importHttpStatus"), *(at(f"$.{f}").alias(f) for f in optional),
    ))
    over = F.when(failed, first_truthy(F.nullif(F.trim("result"), F.lit("{}"))).isNotNull()).otherwise((F.col("status") == "completed") & F.col("result").isNotNull())
    result = F.when(F.col("job_type").isin(*SINGLE_RAW, *BATCH_RAW), F.col("result")).when(over, summary)
    return jobs.select("job_id", "status", "created_at", "started_at", F.col("finished_at").alias("completed_at"), F.when(shows, code).otherwise(none).alias("error_code"), F.when(shows, message).otherwise(none).alias("error_message"), result.alias("result"))


def first_active_jobs(jobs: DataFrame) -> DataFrame:
    """The job of each type that is pending or running, the oldest where there are several: what a new request of its type gets."""
    active = jobs.where(F.lower("status").isin("pending", "running"))
    return active.groupBy("job_type").agg(F.min_by(F.struct(*jobs.columns), F.struct("created_at", "job_id")).alias("first_")).select("first_.*")


def idempotent_requests(jobs: DataFrame) -> DataFrame:
    """jobs with is_first: whether it is the first of its request key; a null key never matches another."""
    n = F.row_number().over(Window.partitionBy("request_key").orderBy("created_at", "job_id"))
    return jobs.where("request_key IS NOT NULL").withColumn("is_first", n == 1).unionByName(jobs.where("request_key IS NULL").withColumn("is_first", F.lit(True)))


def rerun_selection(run_log: DataFrame, planned: DataFrame, mode: str) -> DataFrame:
    """place_id, group_no, pos of planned (place_id, pos) to run again: ALL, FAILED, NOT_EXECUTED or FAILED_AND_NOT_EXECUTED.

    Each place once; by group_no and pos, failed ones go before those without a run.
    """
    last = run_log.groupBy("place_id").agg(F.max_by("success", "seq").alias("success"))
    first = planned.groupBy("place_id").agg(F.min("pos").alias("pos")).join(last, "place_id", "left")
    failed, absent = F.coalesce(~F.col("success"), F.lit(False)), F.col("success").isNull()
    wanted = {"ALL": F.lit(True), "FAILED": failed, "NOT_EXECUTED": absent, "FAILED_AND_NOT_EXECUTED": failed | absent}[mode]
    group = F.lit(0) if mode == "ALL" else F.when(failed, 0).otherwise(1)
    return first.where(wanted).select("place_id", group.alias("group_no"), "pos")
