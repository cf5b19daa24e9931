"""Operators over URL columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolake.functions.text import blank_to_null, extract

#: The hosts and paths of map URLs, the view without a place, and the characters that end a URL in a text.
MAP_HOST = r"(?i)https?://(?:(?:www\.)?google\.com/maps|maps\.google\.com|goo\.gl/maps|maps\.app\.goo\.gl)"
VIEWPORT = r"(?i)https?://(?:www\.)?google\.com/maps/@-?[0-9.]+,-?[0-9.]+,[0-9]+(?:\.[0-9]+)?z"
URL_ENDS = r"""\s<>"{}|\\^`\[\]"""
#: Fragments of a place URL's data.
PLACE_ID, PLACE_REF, DATA_ID = r"!1s(ChI[JA][A-Za-z0-9_-]{19,})", r"!16s%2Fg%2F([A-Za-z0-9_-]+)", r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)"


def is_missing_name(url: Column) -> Column:
    """A place URL without its name: an empty segment after /place/, or a path that ends there."""
    return F.contains(url, F.lit("/place//")) | F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)).endswith("/place/")


def classify_map_url(df: DataFrame, url: str) -> DataFrame:
    """Adds is_maps_url, is_viewport_url (a view without a place) and is_missing_name (a place URL without its name)."""
    c = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({"is_maps_url": F.rlike(c, F.lit(MAP_HOST)), "is_viewport_url": F.rlike(c, F.lit(VIEWPORT)), "is_missing_name": is_missing_name(c)})


def extract_map_urls(df: DataFrame, text: str) -> DataFrame:
    """A row for each map URL in the text, with its place among all the text's URLs (pos)."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?U)https?://[^{URL_ENDS}]+"), F.lit(0))
    return df.select("*", F.posexplode(found).alias("pos", "url")).where(F.rlike("url", F.lit(MAP_HOST)))


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def parameter(url: Column, name: str) -> Column:
    """The first value of a query's parameter, as far as it is a plain id."""
    own = F.filter(F.split(query_of(url), "&"), lambda x: x.startswith(f"{name}="))
    return extract(F.get(own, F.lit(0)), "=([A-Za-z0-9_-]+)")


def after_name(url: Column) -> Column:
    """The segment that follows a place's name in the path, if it begins like an id: with 20 plain characters or more."""
    segments = F.split(F.get(F.split(url, "/place/"), F.lit(1)), "/")
    return F.when(F.get(segments, F.lit(0)) != "", extract(F.get(segments, F.lit(1)), "^([A-Za-z0-9_-]{20,})"))


def cid_of(url: Column) -> Column:
    """The first filled cid parameter."""
    return blank_to_null(F.try_url_decode(extract(F.concat(F.lit("&"), query_of(url)), r"&cid=([^&]+)")))


def parse_data_id(*urls: Column) -> Column:
    return F.coalesce(*(extract(u, DATA_ID) for u in urls))


def parse_coords(url: Column) -> tuple[Column, Column]:
    """Latitude and longitude: the viewport's pair before the place's own."""
    view, own = r"@(-?[0-9.]+),(-?[0-9.]+)", r"!3d(-?[0-9.]+)!4d(-?[0-9.]+)"
    lat, lng = (F.coalesce(extract(url, view, k), extract(url, own, k)) for k in (1, 2))
    return lat.try_cast("double"), lng.try_cast("double")


def parse_cid(url: Column) -> Column:
    """Decimal text (the number is unsigned, 64 bits): the cid parameter, else the second half of the data id."""
    return F.coalesce(cid_of(url), F.conv(F.split_part(extract(url, DATA_ID), F.lit(":0x"), F.lit(2)), 16, 10))


def parse_place_identity(original: Column, resolved: Column) -> Column:
    """The best id that the URLs hold. Of the resolved one, then of the original: a place id in the data, the path or
    ftid, or a reference (g:); then of each the data id or cid:; then short: of a short original; then url: and a hash."""
    original, resolved = F.coalesce(original, F.lit("")), F.coalesce(resolved, F.lit(""))
    named = lambda c: F.when(c.startswith("ChIJ") | c.startswith("ChAJ"), c)
    steps = []
    for u in (resolved, original):
        steps += [extract(u, PLACE_ID), named(after_name(u)), named(parameter(u, "ftid")), F.concat(F.lit("g:"), extract(u, PLACE_REF))]
    for u in (resolved, original):
        steps += [extract(u, DATA_ID), F.concat(F.lit("cid:"), cid_of(u))]
    host, path = F.regexp_extract(original, r"^[^:/?#]+://([^/?#]*)", 1), F.regexp_extract(original, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1))
    steps.append(F.when(F.contains(host, F.lit("goo.gl")), F.concat(F.lit("short:"), last)))
    return F.coalesce(*steps, F.concat(F.lit("url:"), F.hex(F.xxhash64(F.when(resolved != "", resolved).otherwise(original)))))


def encode_part(part: Column) -> Column:
    """A parameter's name or value decoded and encoded anew, with ~ as it is and * as %2A."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(part), part)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def force_language(df: DataFrame, url: str, language: str = "en") -> DataFrame:
    """Google URLs with hl=language as their last and only hl parameter, all parameters encoded anew; others stay."""
    c = F.col(url)
    host = F.lower(F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1))
    given = F.filter(F.split(query_of(c), "&"), lambda x: (x != "") & (F.lower(F.try_url_decode(F.split_part(x, F.lit("="), F.lit(1)))) != "hl"))
    pair = lambda x: F.concat(encode_part(F.regexp_extract(x, "^([^=]*)", 1)), F.lit("="), encode_part(F.regexp_extract(x, "^[^=]*=(.*)$", 1)))
    query = F.array_join(F.concat(F.transform(given, pair), F.array(F.lit(f"hl={language}"))), "&")
    added = F.concat(F.regexp_extract(c, r"^([^?#]*)", 1), F.lit("?"), query, F.regexp_extract(c, r"(#.+)$", 1))
    return df.withColumn(url, F.when(F.contains(host, F.lit("google.")) | (host == "maps.app.goo.gl"), added).otherwise(c))


def decode_title(url: Column) -> Column:
    """The decoded segment after /place/, or null where it is empty or can't be decoded whole."""
    raw = F.trim(F.try_url_decode(extract(url, r"/place/([^/?#]+)")))
    return F.when((raw != "") & ~F.contains(raw, F.lit("%")), raw)


def find_broken_titles(places: DataFrame) -> DataFrame:
    """Rows whose title is a URL, the first by id."""
    broken = places.where(F.lower("title").startswith("http") & (F.trim("id") != ""))
    return broken.withColumn("n_", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("n_ = 1").drop("n_")


def upscale_image(url: Column, scale: int = 10) -> Column:
    """Every width, height and size parameter (=w, -h, =s) times scale."""
    size = "(?:=w|-h|=s)[0-9]+"
    grown = F.transform(F.regexp_extract_all(url, F.lit(size), F.lit(0)), lambda m: F.concat(F.substring(m, 1, 2), (F.substr(m, F.lit(3)).cast("decimal(30,0)") * scale).cast("decimal(38,0)").cast("string")))
    return F.array_join(F.zip_with(F.split(url, size, -1), grown, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def dedupe_photos(photos: DataFrame) -> DataFrame:
    """Per place the photos of the image host (host, avatar and video marks are fixed values), without avatars and variants of a video, the first of each base (text before =)."""
    own = photos.where(F.rlike("url", F.lit(r"^https://lh[0-9]+\.googleusercontent\.com/")) & ~F.rlike("url", F.lit(r"/a-?/|=(m[0-9]+|mm,[^=]*|[0-9]+)$")))
    base = F.split_part(F.col("url"), F.lit("="), F.lit(1))
    return own.withColumn("n_", F.row_number().over(Window.partitionBy("place_id", base).orderBy("pos"))).where("n_ = 1").drop("n_")


#: What a photo's size begins with where it is an icon; photos of a page.
ICON_SIZE, PAGE_PHOTOS = r"(?i)[=-][wsh](?:32|48|64|96)", 30


def page_photos(photos: DataFrame, most: int = PAGE_PHOTOS) -> DataFrame:
    """Per place the photos that a page shows (place_id, pos, url), without avatars: the first of each base, if that isn't an
    icon by its size, and `most` of them. A larger variant after an icon doesn't stand in for it."""
    own = photos.where(F.contains("url", F.lit("googleusercontent")) & ~F.contains("url", F.lit("/a-/")) & ~F.contains("url", F.lit("/a/")))
    base = F.split_part(F.col("url"), F.lit("="), F.lit(1))
    first = own.withColumn("n_", F.row_number().over(Window.partitionBy("place_id", base).orderBy("pos"))).where("n_ = 1").where(~F.rlike("url", F.lit(ICON_SIZE)))
    return first.withColumn("n_", F.row_number().over(Window.partitionBy("place_id").orderBy("pos"))).where(F.col("n_") <= most).drop("n_")


#: The hosts of posts.
SOCIAL_HOST = r"(?i)https?://(?:www\.|m\.|vt\.|vm\.)?(?:tiktok\.com|instagram\.com|instagr\.am)/"


def canonical_social_url(df: DataFrame, url: str, redirects: DataFrame | None = None) -> DataFrame:
    """Adds platform, is_social, canonical (without parameters) and is_carousel for post URLs of two platforms.

    redirects (short_url, target), each short_url once: where a short link leads, for what the link itself doesn't show.
    """
    own = F.coalesce(F.trim(url), F.lit(""))
    if redirects is not None:
        known = redirects.select(F.trim("short_url").alias("short_url_"), F.trim("target").alias("target_"))
        df = df.join(known, own == F.col("short_url_"), "left")
    c = F.coalesce(F.nullif(F.col("target_"), F.lit("")), own) if redirects is not None else own
    social = F.rlike(c, F.lit(SOCIAL_HOST))
    post = r"(?i)tiktok\.com/(@[^/?#]+/(?:photo|video)/[0-9]+)"
    platform = F.when(~social, None).when(F.rlike(c, F.lit(r"(?i)tiktok\.com/")), "TIKTOK").otherwise("INSTAGRAM")
    return df.withColumns({
        "is_social": social, "platform": platform, "is_carousel": F.rlike(c, F.lit(r"(?i)tiktok\.com/@[^/?#]+/photo/")),
        "canonical": F.coalesce(F.concat(F.lit("https://www.tiktok.com/"), extract(c, post)), F.regexp_replace(c, r"[?#].*$", "")),
    }).drop("short_url_", "target_")


def resolve_source_url(title: Column, link: Column) -> Column:
    """The first of title and link that is a URL and not blocked; else what a blocked one was to continue to; else what there is."""
    title, link = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, link))
    path = lambda c: F.regexp_extract(c, r"^https?://[^/?#]*([^?#]*)", 1)
    open_url = [F.when(c.startswith("http") & ~F.contains(path(c), F.lit("/sorry/")), c) for c in (title, link)]
    target = [F.try_url_decode(F.when(F.contains(c, F.lit("/sorry/")), extract(c, r"[?&]continue=([^&#]*)"))) for c in (link, title)]
    return F.coalesce(*open_url, *(F.when(t.startswith("http"), t) for t in target), F.nullif(title, F.lit("")), link)
