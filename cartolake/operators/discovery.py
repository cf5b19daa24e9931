"""Discovery: hits, deduplication, radius, anti-join, eligibility, counters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions.text import EARTH_KM, first_truthy, haversine_km


#: Regions at most.
REGION_ROWS = 10_000


def select_regions(regions: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """The regions of the codes (all, if none), numbered by falling priority, then name.

    The numbering sorts in one task: a dimension, of which more than REGION_ROWS rows are an error.
    """
    if regions.limit(REGION_ROWS + 1).count() > REGION_ROWS:
        raise ValueError(f"more than {REGION_ROWS} regions are no dimension")
    own = regions.where(F.lower("code").isin([c.lower() for c in codes])) if codes else regions
    return own.withColumn("sequence_no", F.row_number().over(Window.orderBy(F.desc("priority"), "name")))


def expand_region_queries(
    regions: DataFrame, templates: DataFrame, most: int, foods: DataFrame | None = None, mode: str = "APPEND", tourist_areas: bool = True, specialties: bool = True
) -> DataFrame:
    """region code, query_no, query: every template filled for every region, repeats dropped, the first `most` kept.

    regions: code, name and perhaps tourist_areas. templates: pos, template and perhaps kind (custom, tourist, province or
    specialty, in this order; province if there is none). foods: code, pos, food. A template with {area} or {food} is filled
    with each of the region's; one that names neither region nor area gets the region's name at its end. REPLACE keeps
    the custom ones only. These are dimensions of a few rows.
    """
    kinds = ["custom"] if mode.upper() == "REPLACE" else ["custom", *["tourist"] * tourist_areas, "province", *["specialty"] * specialties]
    none = F.array().cast("array<string>")
    own = regions.select("code", "name", (F.coalesce("tourist_areas", none) if "tourist_areas" in regions.columns else none).alias("areas"))
    if foods is not None:
        dishes = foods.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("pos", "food")))["food"].alias("dishes"))
        own = own.join(dishes, "code", "left")
    own = own.withColumn("dishes", F.coalesce("dishes", none) if foods is not None else none)
    text = F.trim(F.regexp_replace("template", r"\s+", " "))
    kind = F.col("kind") if "kind" in templates.columns else F.lit("province")
    given = templates.select(kind.alias("kind"), "pos", text.alias("template")).where(F.col("template") != "")
    each = own.select("*", F.posexplode(F.array(*map(F.lit, kinds))).alias("kind_no", "kind")).join(given, "kind")
    values = lambda mark, column: F.when(F.contains("template", F.lit(mark)), F.col(column)).otherwise(F.array(F.lit("")))
    each = each.select("*", F.posexplode(values("{area}", "areas")).alias("area_no", "area")).select("*", F.posexplode(values("{food}", "dishes")).alias("food_no", "food"))
    filled = F.col("template")
    for mark, value in (("{region}", "name"), ("{area}", "area"), ("{food}", "food")):
        filled = F.replace(filled, F.lit(mark), F.col(value))
    filled = F.btrim(filled, F.lit(" ,"))
    query = F.when(F.rlike("template", F.lit(r"\{(region|area)\}")), filled).otherwise(F.concat_ws(", ", filled, "name"))
    first = each.select("code", query.alias("query"), F.struct("kind_no", "pos", "area_no", "food_no").alias("at")).where("query <> ''").groupBy("code", "query").agg(F.min("at").alias("at"))
    return first.withColumn("query_no", F.row_number().over(Window.partitionBy("code").orderBy("at"))).where(F.col("query_no") <= most).drop("at")


def rank_hits(hits: DataFrame, limit: int) -> DataFrame:
    """Per query: the first hit of each link, ranked anew, `limit` of them."""
    first = hits.withColumn("n_", F.row_number().over(Window.partitionBy("query", "link").orderBy("rank", "hit_id"))).where("n_ = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "hit_id"))).where(F.col("rank") <= limit).drop("n_")


def candidate_key() -> Column:
    return first_truthy(F.col("place_id"), F.col("cid"), F.col("link"), F.col("resolved_url"))


def dedupe_candidates(hits: DataFrame, order: list[str]) -> DataFrame:
    """One hit for each key: the first in order, which is total. Blank keys go."""
    keyed = hits.withColumn("key", candidate_key()).where(F.col("key").isNotNull())
    # the least row of each key is found map-side first, so a key with very many hits is no hot group
    first = keyed.groupBy("key").agg(F.min_by(F.struct(*hits.columns), F.struct(*order)).alias("first_"))
    return first.select(*(F.col("first_")[c].alias(c) for c in hits.columns), "key")


def within_radius(df: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """Rows within km of a centre, with distance_km rounded; the comparison isn't. Non-finite coordinates go."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    far = haversine_km(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude"))
    return df.where(fine("latitude") & fine("longitude")).withColumn("d_", far).where(F.col("d_") <= km).withColumn("distance_km", F.round("d_", 3)).drop("d_")


#: Blocks of points of a cell from which on it is cut into parts.
CROWDED = 200_000
#: Rows of one place that make a block, rows of one place that are gathered at once, and pairs of rows that meet in one part of a cell, about.
BLOCK, GATHERED, PAIRS = 128, 10_000, 4_000_000


def located(rows: DataFrame, lat: str, lng: str) -> DataFrame:
    """The rows with finite coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    return rows.where(finite(lat) & finite(lng))


def places(rows: DataFrame, lat: str, lng: str, to: str) -> DataFrame:
    """lat, lng, `to` (how many rows lie there) of the rows with finite coordinates."""
    return located(rows, lat, lng).groupBy(lat, lng).agg(F.count("*").alias(to))


def placed(rows: DataFrame, lat: str, lng: str, to: str) -> DataFrame:
    """lat, lng, `to` (array of up to BLOCK whole rows) of the rows with finite coordinates: those that lie at one place, in blocks."""
    own = located(rows, lat, lng).select(F.col(lat).alias("lat_"), F.col(lng).alias("lng_"), F.struct(*rows.columns).alias("row_"))
    heaps = own.groupBy("lat_", "lng_").agg(F.count("*").alias("n_")).where(F.col("n_") > GATHERED).select("lat_", "lng_", F.ceil(F.col("n_") / GATHERED).cast("int").alias("heaps_"))
    heap = F.pmod(F.xxhash64("row_"), F.coalesce("heaps_", F.lit(1))).alias("heap_")
    gathered = own.join(heaps, ["lat_", "lng_"], "left").groupBy("lat_", "lng_", heap).agg(F.collect_list("row_").alias("rows_"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows_") - 1) / BLOCK).cast("int")), lambda k: F.slice("rows_", k * BLOCK + 1, F.lit(BLOCK)))
    return gathered.select(F.col("lat_").alias(lat), F.col("lng_").alias(lng), F.explode(cut).alias(to))


def tasks_for(n_points: DataFrame, n_centers: DataFrame, key: list[str], least: int) -> int:
    """Tasks for all pairs that meet in the cells (key, points; key, centers): one for PAIRS of them, `least` at least."""
    pairs = n_points.hint("merge").join(n_centers, key).agg(F.sum(F.col("points").cast("double") * F.col("centers"))).first()[0] or 0
    return max(least, math.ceil(pairs / PAIRS))


def radius_join(points: DataFrame, centers: DataFrame, km: float, crowded: int = CROWDED) -> DataFrame:
    """Pairs of points and centers (center_id, c_lat, c_lng) within km: an equi-join on cells, then the exact distance.

    Cells are those of a cube's grid around the globe: points within km lie at most a chord apart, so with cells as wide as
    that chord a centre meets its own cell and the 26 around it, at the poles and the date line as anywhere else. Rows of
    one place travel in blocks, and blocks meet instead of rows: their distance is computed once, and the pairs are spread out
    after it. A cell is cut into parts by the pairs that meet there, both sides by hash, and each side is repeated for the
    other's cuts; also where it has more than `crowded` blocks of points. Parts are dealt over as many tasks as
    spark.sql.shuffle.partitions says, however few bytes they have, and over more where that many pairs meet, since the work
    is in the pairs: these are counted first, by places, so a task's share doesn't grow with the tables. Only the cells that
    are cut are broadcast, one for 2,000 rows (the root of PAIRS) or `crowded` blocks at most; parts are merged, since Spark
    sizes them by the tables' files, before cells and cuts repeat their rows. Points and centers without finite coordinates go;
    longitudes may be beyond 180.
    """
    # a little wider, for the rounding of both distances
    width = max(2 * math.sin(min(km / EARTH_KM, math.pi) / 2) * (1 + 1e-9), 0.0) + 1e-7

    def cell(lat: str, lng: str) -> list[Column]:
        y, x = F.radians(lat), F.radians(lng)
        return [F.floor(v / width) for v in (F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))]

    key = ["gx_", "gy_", "gz_"]
    own = placed(points, "latitude", "longitude", "points_").withColumns(dict(zip(key, cell("latitude", "longitude"), strict=True)))
    around = placed(centers, "c_lat", "c_lng", "centers_")
    for k, at in zip(key, cell("c_lat", "c_lng"), strict=True):
        around = around.withColumn(k, F.explode(F.sequence(at - 1, at + 1)))
    n_points = own.groupBy(*key).agg(F.sum(F.size("points_")).alias("points"), F.count("*").alias("blocks"))
    sizes = n_points.hint("merge").join(around.groupBy(*key).agg(F.sum(F.size("centers_")).alias("centers")), key)
    # a side is cut into pieces of the root of PAIRS rows at least, or of more where the other side has few
    cuts = lambda n, other: F.ceil(F.col(n) / F.greatest(F.lit(math.sqrt(PAIRS)), PAIRS / F.col(other)))
    p_cuts, c_cuts = F.greatest(cuts("points", "centers"), F.ceil(F.col("blocks") / crowded)).cast("int"), cuts("centers", "points").cast("int")
    cut = F.broadcast(sizes.select(*key, p_cuts.alias("p_cuts_"), c_cuts.alias("c_cuts_")).where((F.col("p_cuts_") > 1) | (F.col("c_cuts_") > 1)))
    here = places(points, "latitude", "longitude", "points").withColumns(dict(zip(key, cell("latitude", "longitude"), strict=True)))
    there = places(centers, "c_lat", "c_lng", "centers")
    for k, at in zip(key, cell("c_lat", "c_lng"), strict=True):
        there = there.withColumn(k, F.explode(F.sequence(at - 1, at + 1)))
    sums = (df.groupBy(*key).agg(F.sum(n).alias(n)) for df, n in ((here, "points"), (there, "centers")))
    tasks = tasks_for(*sums, key, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        cuts = lambda side: F.coalesce(f"{side}_cuts_", F.lit(1))
        part = F.pmod(F.xxhash64(*(c for c in df.columns if c not in key)), cuts(mine)).cast("int")
        rows = df.join(cut, key, "left").withColumn(f"{mine}_", part).withColumn(f"{other}_", F.explode(F.sequence(F.lit(0), cuts(other) - 1)))
        # one column, so that cells which are constants don't have the parts dealt anew
        return rows.withColumn("part_", F.concat_ws("/", *key, "p_", "c_")).drop(*key, "p_", "c_", "p_cuts_", "c_cuts_").repartition(tasks, "part_").hint("merge")

    met = dealt(own, "p", "c").join(dealt(around, "c", "p"), "part_")
    far = haversine_km(F.col("c_lat"), F.col("c_lng"), F.col("latitude"), F.col("longitude"))
    near = met.withColumn("distance_km", far).where(F.col("distance_km") <= km).select("points_", "centers_", "distance_km")
    # rows come out of their blocks last
    return near.select(F.inline("points_"), "centers_", "distance_km").select(*points.columns, F.inline("centers_"), "distance_km")


#: By what a candidate can be known, besides its key.
IDENTITIES = ("place_id", "cid")


def exclude_existing(candidates: DataFrame, catalogue: DataFrame, identities: tuple[str, ...] = IDENTITIES) -> DataFrame:
    """Candidates (key, each once) with is_known: whether the catalogue has their key, or one of their identities.

    Those of `identities` count that both tables have; blank ones match nothing. The ids of a candidate become rows of their
    own, each kind of id is met once a distinct value, and the verdicts come back by key: a candidate never doubles,
    however many of its ids are known.
    """
    kinds = ["key", *(c for c in identities if c in candidates.columns and c in catalogue.columns)]

    def ids(df: DataFrame, *more: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(k).alias("kind"), F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).alias("value")) for k in kinds))
        return df.select(*more, F.inline(each)).where("value IS NOT NULL")

    asked = ids(candidates.select(*kinds, F.col("key").alias("own_")), "own_")
    met = asked.join(ids(catalogue).distinct(), ["kind", "value"], "left_semi").select(F.col("own_").alias("key")).distinct()
    return candidates.join(met.withColumn("is_known", F.lit(True)), "key", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def filter_reason(food: Column, min_reviews: int, min_rating: float) -> Column:
    return (
        F.when(~food, "NON_FOOD").when(F.coalesce("review_count", F.lit(0)) < min_reviews, "REVIEW_COUNT")
        .when(F.coalesce("rating", F.lit(0.0)) <= min_rating, "GOOGLE_RATING")
    )


def later_reason(reason: Column, scrape_failed: Column, n_scoring: Column) -> Column:
    """The reason of a place that has come through filter_reason and had its reviews captured: that failed, or none of them scores."""
    return F.coalesce(reason, F.when(F.coalesce(scrape_failed, F.lit(False)), "REVIEW_SCRAPE_FAILED").when(F.coalesce(n_scoring, F.lit(0)) == 0, "NO_SCORING_REVIEWS"))


def food_gate(category: Column, markers: list[str], group: Column | None = None) -> Column:
    """Whether a place's group is FOOD_AND_DRINK or its category holds a marker anywhere."""
    low = F.lower(F.coalesce(category, F.lit("")))
    gate = F.lit(False) if group is None else F.upper(F.coalesce(group, F.lit(""))) == "FOOD_AND_DRINK"
    for marker in markers:
        gate = gate | F.contains(low, F.lit(marker))
    return gate


def region_counters(outcomes: DataFrame, failed_regions: DataFrame) -> DataFrame:
    """Per region, and in total where region is null, the counters that a crawl reports.

    outcomes: region, is_known, has_url, scrape_failed, outside, reason (of filter_reason), final_reason (of later_reason),
    has_id, imported, saved (inactive), rejected_score, insufficient. A known candidate is processed and skipped. One
    without a URL has failed and isn't processed; nor do places count further that couldn't be captured (failed) or lie
    outside the radius (skipped). One without an id fails after it was eligible. failed_regions: region, the number of
    times that a whole region failed; each adds one failure there, though nothing was discovered.
    """
    whole = failed_regions.groupBy("region").agg(F.count("*").alias("lost"))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    fresh = ~is_("is_known")
    captured = fresh & is_("has_url") & ~is_("scrape_failed")
    met = captured & ~is_("outside")
    sent = met & is_("has_id")
    count = lambda c, name: F.count_if(c).alias(name)
    own = outcomes.groupBy("region").agg(
        F.count("*").alias("discovered"), count(~fresh | fresh & is_("has_url"), "processed"), count(met & F.col("reason").isNull(), "eligible"), count(sent & is_("imported"), "imported"),
        count(~fresh | captured & is_("outside") | sent & (is_("saved") | ~is_("imported")), "skipped"), count(fresh & ~is_("has_url") | fresh & is_("has_url") & is_("scrape_failed") | met & ~is_("has_id"), "failed"),
        count(sent & is_("saved") & is_("rejected_score"), "rejected_score"), count(sent & is_("imported") & is_("insufficient"), "insufficient_photo"),
        count(sent & F.col("final_reason").eqNullSafe("REVIEW_SCRAPE_FAILED"), "no_reviews_captured"), count(sent & F.col("final_reason").eqNullSafe("NO_SCORING_REVIEWS"), "no_scoring_reviews"),
    )
    names = own.columns[1:]
    both = own.join(whole, "region", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in names}).withColumn("failed", F.col("failed") + F.coalesce("lost", F.lit(0)))
    # the regions are few: their total is a second, small sum
    return both.rollup("region").agg(*(F.sum(c).alias(c) for c in names))


def crawl_counters(outcomes: DataFrame) -> DataFrame:
    """Per region, and in total where region is null: discovered, skipped, eligible, the rejected by reason, and what became
    of the imports (imported, insufficient, rejected_score, skipped as classify_import_outcome gives them; failed).

    An imported place that was saved as inactive counts as imported and as skipped. Columns that aren't there count 0.
    region_counters tells further steps apart.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in outcomes.columns else F.lit(False)
    count = lambda c, name: F.count_if(c).alias(name)
    reason = lambda r: ~F.col("is_known") & F.col("reason").eqNullSafe(r)
    return outcomes.rollup("region").agg(
        F.count("*").alias("discovered"), count(F.col("is_known") | flag("skipped"), "skipped"), count(~F.col("is_known") & F.col("reason").isNull(), "eligible"),
        count(reason("NON_FOOD"), "non_food"), count(reason("REVIEW_COUNT"), "low_reviews"), count(reason("GOOGLE_RATING"), "low_rating"),
        *(count(flag(c), c) for c in ("imported", "failed", "rejected_score")), count(flag("insufficient"), "insufficient_photo"),
    )


#: The queries of a location where the user gives none.
LOCATION_QUERIES = ("quán ăn", "nhà hàng", "restaurant", "food", "cafe")


def expand_location_queries(locations: DataFrame, custom: DataFrame, most: int, mode: str = "APPEND", defaults: tuple[str, ...] = LOCATION_QUERIES) -> DataFrame:
    """location, query_no, query: the custom templates (pos, template) without their placeholders, then, unless the mode is
    REPLACE, the defaults; blank ones and repeats go, `most` stay. The search is bound to the location's own coordinates,
    so its name isn't added. Templates are a dimension of a few rows.
    """
    bare = F.btrim(F.regexp_replace("template", r"\{(?:region|area|food)\}", ""), F.lit(" ,"))
    given = custom.select(F.lit(0).alias("kind"), "pos", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("query")).where("query <> ''")
    if mode.upper() != "REPLACE":
        own = locations.sparkSession.createDataFrame([(1, k, q) for k, q in enumerate(defaults)], "kind int, pos int, query string")
        given = given.unionByName(own)
    first = given.groupBy("query").agg(F.min(F.struct("kind", "pos")).alias("at")).orderBy("at").limit(most)
    ordered = F.array_sort(F.collect_list(F.struct("at", "query")))
    listed = first.agg(F.transform(ordered, lambda x, k: F.struct((k + 1).alias("query_no"), x["query"].alias("query"))).alias("queries"))
    # one row meets every location
    return locations.crossJoin(F.broadcast(listed)).select("location", F.inline("queries"))


def parse_hit_text(df: DataFrame, text: str, most: int = 12) -> DataFrame:
    """Adds lines (trimmed, each once, `most`), rating_line and reviews_line, the first ones with a rating and a count."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.withColumn("lines", F.slice(F.array_distinct(lines), 1, most))
    first = lambda p: F.get(F.filter("lines", lambda x: F.rlike(x, F.lit(p))), F.lit(0))
    return rows.withColumns({"rating_line": first(r"(?i)(^|[^0-9])[1-5][.,][0-9]([^0-9]|$)"), "reviews_line": first(r"(?i)\([0-9][0-9.,]*\)|[0-9] *(reviews?|đánh giá)")})


def fill_identity(details: DataFrame, candidates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """details with the candidate's value in each of columns that is blank; one candidate a key."""
    own = candidates.select(key, *(F.col(c).alias(f"{c}_found") for c in columns))
    types = dict(details.dtypes)
    kept = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")) if types[c] == "string" else F.col(c), F.col(f"{c}_found"))
    return details.join(own, key, "left").withColumns({c: kept(c) for c in columns}).select(*details.columns)


def inactive_projection(df: DataFrame) -> DataFrame:
    """Rows with a reason keep one image and no reviews, and become INACTIVE."""
    out = F.col("reason").isNotNull()
    types = dict(df.dtypes)
    return df.withColumns({
        "images": F.when(out, F.slice("images", 1, 1)).otherwise(F.col("images")), "reviews": F.when(out, F.array().cast(types["reviews"])).otherwise(F.col("reviews")),
        "visibility": F.when(out, "INACTIVE").otherwise(F.col("visibility")),
    })


def classify_import_outcome(df: DataFrame, wanted: int) -> DataFrame:
    """Adds imported_, insufficient, skipped and rejected_score from imported, status and n_reviews."""
    status = F.coalesce("status", F.lit(""))
    saved = F.col("imported") & status.startswith("SAVED_INACTIVE")
    return df.withColumns({
        "insufficient": F.col("imported") & (status == "IMPORTED") & (F.col("n_reviews") < wanted), "skipped": saved | ~F.col("imported"),
        "rejected_score": saved & F.contains(status, F.lit("ADJUSTED_RATING")),
    })
