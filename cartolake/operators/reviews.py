"""Review scoring, validation and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions.text import blank_to_null
from cartolake.operators.classify import detect_language, first_float, first_int
from cartolake.operators.urls import upscale_image


def dedupe_reviews(reviews: DataFrame) -> DataFrame:
    """Per place the first row of each review id; rows without an id all stay."""
    bare = F.coalesce(F.trim("review_id"), F.lit("")) == ""
    order = F.row_number().over(Window.partitionBy("place_id", "review_id").orderBy("seq"))
    # rows without an id don't need the window: they go around it, so that they aren't one hot group
    named = reviews.where(~bare).withColumn("n_", order).where("n_ = 1").drop("n_")
    return named.unionByName(reviews.where(bare))


def authenticity_score(reviews: DataFrame) -> DataFrame:
    """Adds authenticity_score, 0 to 1 with four decimals; ties go up whatever their binary form."""
    size = F.length(F.coalesce(F.trim("text"), F.lit("")))
    share = lambda c, most: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) / F.lit(float(most)), F.lit(1.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    trust = (share("total_reviews", 50) + share("total_photos", 100) + flag(F.coalesce("is_local_guide", F.lit(False)))) / 3.0
    # fixed values: the weights, and the lengths and totals that count in full
    score = 0.15 * flag(size > 0) + 0.25 * F.least(size / 200.0, F.lit(1.0)) + 0.25 * flag(F.coalesce("n_images", F.lit(0)) > 0) + 0.35 * trust
    return reviews.withColumn("authenticity_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) + 1e-9, 4))


def recent_reviews_with_images(reviews: DataFrame, n: int) -> DataFrame:
    """Per place the first n rows with images, in source order; n <= 0 means 50, and 200 is the most."""
    n = min(n if n > 0 else 50, 200)
    return reviews.where(F.col("n_images") > 0).withColumn("n_", F.row_number().over(Window.partitionBy("place_id").orderBy("seq"))).where(F.col("n_") <= n).drop("n_")


def texts_by_language(language: Column, text: Column) -> Column:
    """A map with the text under its language; an empty one without a text."""
    none = F.create_map().cast("map<string,string>")
    return F.when(text != "", F.create_map(language, text)).otherwise(none)


def images_of(reviews: DataFrame) -> Column:
    return F.coalesce("images", F.array().cast("array<string>")) if "images" in reviews.columns else F.array().cast("array<string>")


def scoring_reviews(reviews: DataFrame, n: int) -> DataFrame:
    """Valid rows (id, author, rating 1 to 5), the first n of each place, with content_hash, user_images (those of images that
    are http URLs) and review_text, the text by its language (vi or en)."""
    fine = (F.trim("review_id") != "") & (F.trim("author") != "") & F.col("rating").between(1, 5)
    text, date = F.coalesce(F.trim("text"), F.lit("")), F.coalesce(blank_to_null(F.col("review_date")), F.lit("1970-01-01"))
    kept = reviews.where(fine).withColumns({
        "content_hash": F.sha2(F.concat_ws("|", "author", F.col("rating").cast("string"), text, date), 256),
        "user_images": F.filter(images_of(reviews), lambda x: x.startswith("http")), "review_text": texts_by_language(detect_language(text), text),
    })
    return kept.withColumn("n_", F.row_number().over(Window.partitionBy("place_id").orderBy("seq"))).where(F.col("n_") <= n).drop("n_")


def refresh_reviews(reviews: DataFrame, scraped_at: str) -> DataFrame:
    """The refresh contract: as scoring_reviews, but with an image, the date of the scrape for a blank or unreadable one,
    another hash, user_images that aren't blank, whatever they are, and the text under the language `other`.

    Without a column images, n_images says whether there are any.
    """
    images = F.filter(F.transform(images_of(reviews), lambda x: F.trim(x)), lambda x: x != "")
    some = F.size(images) > 0 if "images" in reviews.columns else F.col("n_images") > 0
    fine = (F.trim("review_id") != "") & (F.trim("author") != "") & F.col("rating").between(1, 5) & some
    given = blank_to_null(F.col("review_date"))
    readable = F.rlike(given, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")) & given.try_cast("timestamp").isNotNull()
    text, date = F.coalesce(F.trim("text"), F.lit("")), F.when(readable, given).otherwise(scraped_at)
    return reviews.where(fine).withColumns({
        "content_hash": F.sha2(F.concat_ws("|", "review_id", F.col("rating").cast("string"), text, date), 256),
        "user_images": images, "review_text": texts_by_language(F.lit("other"), text), "review_date": date,
    })


def review_quality_report(reviews: DataFrame) -> DataFrame:
    """Per place how many reviews lack an id, an author, a text, and a profile URL where there is such a column."""
    lacks = lambda c: F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "")
    profile = [lacks("profile_url").alias("no_profile_url")] if "profile_url" in reviews.columns else []
    return reviews.groupBy("place_id").agg(F.count("*").alias("n_reviews"), lacks("review_id").alias("no_id"), lacks("author").alias("no_author"), lacks("text").alias("no_text"), *profile)


#: Fixed value: what stands before the author's name in a picture's label.
PHOTO_CAPTION = "photo of"


def parse_review_snapshot(captures: DataFrame) -> DataFrame:
    """author, rating, likes, photos, is_local_guide, total_reviews and total_photos from the texts of captured reviews."""
    author, info = F.trim(F.coalesce("author", F.lit(""))), F.trim(F.coalesce("reviewer_info", F.lit("")))
    total = lambda word: F.coalesce(first_int(F.regexp_extract(info, rf"(?i)([0-9][0-9\s,.]*)\s+{word}s?", 1)), F.lit(0).cast("bigint"))
    photos = F.transform(F.coalesce("photos", F.array().cast("array<string>")), lambda x: upscale_image(F.trim(x)))
    return captures.withColumns({
        "author": F.when(author != "", author).otherwise(F.regexp_replace(F.trim(F.coalesce("profile_label", F.lit(""))), rf"(?i)^{PHOTO_CAPTION}\s+", "")),
        "rating": first_float(F.col("rating_label")), "likes": F.coalesce(first_int(F.col("likes_text")), F.lit(0).cast("bigint")),
        "photos": F.array_distinct(F.filter(photos, lambda x: x.isNotNull() & (x != ""))), "is_local_guide": F.contains(F.lower(info), F.lit("local guide")),
        "total_reviews": total("review"), "total_photos": total("photo"),
    })


def format_reviews(reviews: DataFrame) -> DataFrame:
    """The export's columns in camel case; when is the date, or the raw one, and the score is filled in."""
    blank = lambda c, to: F.coalesce(c, F.lit("")).alias(to)
    number = lambda c, to: F.coalesce(c, F.lit(0)).cast("bigint").alias(to)
    return authenticity_score(reviews).select(
        blank("review_id", "reviewId"), blank("place_id", "googlePlaceId"), blank("author", "name"), F.coalesce("is_local_guide", F.lit(False)).alias("isLocalGuide"),
        number("total_reviews", "totalReviews"), number("total_photos", "totalPhotos"), number("rating", "rating"), blank("text", "description"),
        F.coalesce(F.nullif("review_date", F.lit("")), "raw_date", F.lit("")).alias("when"), F.col("authenticity_score").alias("authenticityScore"),
    )
