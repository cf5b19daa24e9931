"""Mentions of places: confidence, summaries, matches, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions.text import first_truthy

MIN_SCORE, MIN_GAP = 0.68, 0.08
#: The reasons for which a mention isn't retained.
REJECTED_REASONS = ("invalid_candidate", "missing_name", "generic_or_unnamed_place")


def confidence(value: Column) -> Column:
    """0 to 1; what isn't a number is 0, and numbers above 1 up to 100 are percent."""
    x = F.coalesce(value.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((x > 1) & (x <= 100), x / 100.0).otherwise(x)))


def validation_summary(mentions: DataFrame) -> DataFrame:
    """Per post: mentions, verified, unresolved, those with a reason, the rejected ones (REJECTED_REASONS) and how often each
    of these reasons occurs, as a map by name."""
    status = lambda s: F.count_if(F.col("status") == s)
    rejected = F.col("reason").isin(*REJECTED_REASONS)
    counts = F.array(*(F.struct(F.lit(r).alias("reason"), F.count_if(F.col("reason") == r).alias("n")) for r in sorted(REJECTED_REASONS)))
    reasons = F.map_from_entries(F.filter(counts, lambda x: x["n"] > 0))
    return mentions.groupBy("post_id").agg(F.count("*").alias("n_input"), status("EVIDENCE_VERIFIED").alias("n_verified"), status("UNRESOLVED").alias("n_unresolved"), F.count_if(F.col("reason").isNotNull()).alias("n_reasons"), F.count_if(rejected).alias("n_rejected"), reasons.alias("reasons"))


def map_summary(enriched: DataFrame) -> DataFrame:
    """Per post, after the map search: the mentions that went into it, and those that it resolved, rejected (none: all are kept) and left open."""
    resolved = F.col("status") == "RESOLVED"
    return enriched.groupBy("post_id").agg(F.count("*").alias("map_input"), F.count_if(resolved).alias("map_verified"), F.lit(0).cast("long").alias("map_rejected"), F.count_if(~F.coalesce(resolved, F.lit(False))).alias("n_unresolved"))


#: Longest ref.
REF_CHARS = 128


def unique_refs(mentions: DataFrame) -> DataFrame:
    """Adds ref: candidate_ref, cut to REF_CHARS, or a number of the place in the post (pos); what a mention before it has
    already gets the place as a suffix, and a counter where that is taken too.

    Posts without such a clash need a window only; the others, where a new ref meets another one, go through their
    mentions in order.
    """
    place = F.lpad((F.col("pos") + 1).cast("string"), 4, "0")
    base = F.coalesce(F.nullif(F.substring(F.trim("candidate_ref"), 1, REF_CHARS), F.lit("")), F.concat(F.lit("social-"), place))
    suffixed = lambda base, suffix: F.concat(F.left(base, F.lit(REF_CHARS) - F.length(suffix)), suffix)
    n = F.row_number().over(Window.partitionBy("post_id", "base_").orderBy("pos"))
    rows = mentions.withColumn("base_", base).withColumn("ref", F.when(n == 1, F.col("base_")).otherwise(suffixed(F.col("base_"), F.concat(F.lit("-"), place))))
    clash = rows.groupBy("post_id", "ref").agg(F.count("*").alias("n_")).where("n_ > 1").select("post_id").distinct()

    def step(done: Column, x: Column) -> Column:
        tail = F.concat(F.lit("-"), F.lpad((x["pos"] + 1).cast("string"), 4, "0"))
        tails = F.concat(F.array(F.lit("")), F.array(tail), F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda k: F.concat(tail, F.lit("-"), k.cast("string"))))
        free = F.filter(F.transform(tails, lambda t: suffixed(x["base_"], t)), lambda r: ~F.array_contains(done, r))
        return F.concat(done, F.array(F.get(free, F.lit(0))))

    ordered = rows.join(clash, "post_id", "left_semi").groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("pos", "base_"))).alias("all_"))
    refs = ordered.select("post_id", "all_", F.aggregate("all_", F.array().cast("array<string>"), step).alias("refs_"))
    mended = refs.select("post_id", F.explode(F.arrays_zip(F.col("all_")["pos"].alias("pos"), F.col("refs_").alias("ref_"))).alias("x")).select("post_id", "x.pos", "x.ref_")
    return rows.join(mended, ["post_id", "pos"], "left").withColumn("ref", F.coalesce("ref_", "ref")).select(*mentions.columns, "ref")


def map_query(df: DataFrame, hints: list[str]) -> DataFrame:
    """Adds map_query: the query (or, if blank, the name) with each hint that it doesn't hold yet, ignoring case, in order. Without both it is empty."""
    add = lambda acc, h: F.when((F.coalesce(F.trim(h), F.lit("")) == "") | F.contains(F.lower(acc), F.lower(F.trim(h))), acc).otherwise(F.concat_ws(" ", acc, F.trim(h)))
    first = first_truthy(*(F.col(c) for c in ("query", "name") if c in df.columns))
    return df.withColumn("map_query", F.when(first.isNull(), "").otherwise(F.aggregate(F.array(*hints), first, add)))


def resolve_matches(pairs: DataFrame) -> DataFrame:
    """The best hit of each mention: good enough, and clear of the runner-up if that has another identity."""
    n = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "pos", "identity"))
    two = pairs.where(F.col("identity").isNotNull()).withColumn("n_", n).where("n_ <= 2")
    of = lambda k, c: F.max(F.when(F.col("n_") == k, F.col(c)))
    best = two.groupBy("mention_id").agg(of(1, "identity").alias("identity"), of(1, "score").alias("score"), of(2, "identity").alias("other"), of(2, "score").alias("next"))
    clear = F.col("other").isNull() | (F.col("other") == F.col("identity")) | (F.col("score") - F.col("next") >= MIN_GAP)
    return best.where((F.col("score") >= MIN_SCORE) & clear).select("mention_id", "identity", F.round("score", 4).alias("score"))


def frame_grid(videos: DataFrame, interval: int, most: int) -> DataFrame:
    """video_id, frame_no, at_s: one frame a second in, then every interval, while they last; an unknown duration gives all.

    A frame at the very end moves 0.05 s forward; a video of a second or less has one frame, in its middle.
    """
    last = F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor((F.col("duration") - 1) / interval))).cast("int")
    rows = videos.select("video_id", "duration", F.explode(F.sequence(F.lit(0), F.when(F.col("duration") <= 1, 0).otherwise(last))).alias("frame_no"))
    at = (1 + F.col("frame_no") * interval).cast("double")
    at = F.when(at == F.col("duration"), F.greatest(F.lit(1.0), at - 0.05)).otherwise(at)
    return rows.withColumn("at_s", F.when(F.col("duration") <= 1, F.greatest(F.lit(0.0), F.col("duration") / 2)).otherwise(at))


def evidence_frame(evidence: DataFrame) -> DataFrame:
    """Per mention the first frame or slide that supports the identity, else the first one (source, frame_index, frame_count, supports, ev_no)."""
    source = F.regexp_replace(F.lower(F.trim("source")), "^[^a-z0-9]+|[^a-z0-9]+$", "")
    order = Window.partitionBy("mention_id").orderBy(F.desc("supports"), "ev_no")
    own = evidence.where(source.isin("frame", "slide")).where("frame_index >= 1 AND frame_index <= frame_count")
    return own.withColumn("n_", F.row_number().over(order)).where("n_ = 1").select("mention_id", "frame_index")
