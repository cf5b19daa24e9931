"""Classification and number parsing of places."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.text import blank_to_null
from cartolake.operators.urls import VIEWPORT, is_missing_name

#: Phrases up to which a dictionary is a literal of the plan; characters of one automaton, and of a dictionary at most.
LITERAL_PHRASES, PART_CHARS, DICTIONARY_CHARS = 500, 2_000_000, 20_000_000
#: The lower-cased address on its way to the automata.
FOLDED = "address_folded_"
#: Fixed values.
COUNTRY = "vietnam|việt nam"
GENERIC_TITLES = ("this place", "dropped pin", "this location")
LEGACY_GROUPS = ("CULTURE_AND_HERITAGE", "NATURE_AND_OUTDOORS", "SHOPPING_AND_MARKET", "OTHER")


def normalize_category(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(column, F.lit("_"), F.lit(" ")), "&", " and "), r"\s+", " "))


def fold_legacy_group(group: Column) -> Column:
    code = F.upper(blank_to_null(group))
    return F.when(code.isin(*LEGACY_GROUPS), "ATTRACTIONS").otherwise(code)


def infer_locale(df: DataFrame) -> DataFrame:
    """Adds timezone, the country's where the coordinates lie in its box, else UTC, and in_country: whether they do, or the
    address (if there is such a column) names the country."""
    inside = F.coalesce((F.col("latitude") > 8) & (F.col("latitude") < 24) & (F.col("longitude") > 102) & (F.col("longitude") < 110), F.lit(False))
    named = has_words(F.coalesce("address", F.lit("")), COUNTRY) if "address" in df.columns else F.lit(False)
    return df.withColumns({"timezone": F.when(inside, "Asia/Saigon").otherwise("UTC"), "in_country": inside | named})


def tag_destinations(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds destinations: the sorted codes of all phrases (dimension: code, phrase) that the lower-cased address contains.

    A dictionary of few phrases is a literal of the plan. A larger one becomes automata over its phrases, which tasks run
    along an address once, whatever their number; each holds PART_CHARS characters at most, and a further one takes over
    where the last has ended, without a shuffle. A dictionary above DICTIONARY_CHARS characters is an error. An empty phrase
    stands in every address; a null address holds nothing else.
    """
    known = dictionary.select(F.col("code").cast("string").alias("code"), F.col("phrase").cast("string").alias("phrase")).where("phrase IS NOT NULL AND code IS NOT NULL").distinct()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase") + F.length("code")), F.lit(0)).alias("chars")).first()
    if size["chars"] > DICTIONARY_CHARS:
        raise ValueError(f"a dictionary of {size['chars']} characters is no dimension: {DICTIONARY_CHARS} at most")
    phrases = sorted((r["phrase"], r["code"]) for r in known.collect())
    low = F.lower(F.coalesce("address", F.lit("")))
    if size["n"] <= LITERAL_PHRASES:
        pairs = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(p).alias("phrase")) for p, c in phrases)).cast("array<struct<code:string,phrase:string>>")
        found = F.transform(F.filter(pairs, lambda x: F.contains(low, x["phrase"])), lambda x: x["code"])
        return df.withColumn("destinations", F.array_sort(F.array_distinct(found)))
    always = sorted({c for p, c in phrases if not p})
    rows = df.withColumn("destinations", F.array(*map(F.lit, always)).cast("array<string>")).withColumn(FOLDED, low)
    part, chars = [], 0
    for phrase, code in ((p, c) for p, c in phrases if p):
        if part and chars + len(phrase) > PART_CHARS:
            rows, part, chars = with_phrases(rows, part), [], 0
        part.append((phrase, code))
        chars += len(phrase)
    return (with_phrases(rows, part) if part else rows).drop(FOLDED).withColumn("destinations", F.array_sort(F.array_distinct("destinations")))


def with_phrases(rows: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """rows (destinations, FOLDED) with the codes of the phrases in FOLDED appended to destinations, by an automaton."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)  # PART_CHARS at most
    at, folded = rows.columns.index("destinations"), rows.columns.index(FOLDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, list[str]] = {}
        for phrase, code in shared.value:
            codes.setdefault(phrase, []).append(code)
        words = ahocorasick.Automaton()
        for phrase, own in codes.items():
            words.add_word(phrase, own)
        words.make_automaton()
        for batch in batches:
            found = [sorted({*before, *(c for _, own in words.iter(text) for c in own)}) for before, text in zip(batch.column(at).to_pylist(), batch.column(folded).to_pylist(), strict=True)]
            columns = [pa.array(found, pa.list_(pa.string())) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def first_float(text: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, r"[0-9]+(?:[.,][0-9]+)?", 0), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def first_int(text: Column) -> Column:
    """All digits of the first run of digits and separators."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"[0-9][0-9., ]*", 0), F.lit("")), "[^0-9]", "").try_cast("bigint")


def place_gate(df: DataFrame) -> DataFrame:
    """Adds reject_reason of places (link, title, perhaps scrape_status), null where the place passes."""
    title = F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", " ")))
    link = F.coalesce("link", F.lit(""))
    failed = F.lower(F.coalesce("scrape_status", F.lit(""))) == "failed" if "scrape_status" in df.columns else F.lit(False)
    return df.withColumn(
        "reject_reason",
        F.when(F.rlike(link, F.lit(VIEWPORT)), "VIEWPORT_URL").when(is_missing_name(link), "MISSING_NAME").when(failed, "SCRAPE_FAILED").when(title == "", "BLANK_TITLE")
        .when(title.isin(*GENERIC_TITLES), "GENERIC_TITLE").when(title.startswith("http://") | title.startswith("https://"), "URL_TITLE"),
    )


def collect_categories(df: DataFrame) -> DataFrame:
    """Adds all_categories: category, categories, and those in the JSON raw_data, trimmed, without blanks, each once."""
    inside = F.from_json(F.get_json_object("raw_data", "$.categories"), "array<string>")
    none = F.array().cast("array<string>")
    whole = F.concat(F.array("category"), F.coalesce("categories", none), F.coalesce(inside, none))
    return df.withColumn("all_categories", F.array_distinct(F.filter(F.transform(whole, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))


def has_words(text: Column, words: str) -> Column:
    """Whether one of the alternatives in words stands in text as whole words, ignoring case."""
    return F.rlike(text, F.lit(rf"(?iuU)\b(?:{words})\b"))


def place_group(categories: Column, food: str, not_food: str, stay: str) -> Column:
    """The group of a list of categories, the primary one first; the word patterns are the user's.

    The first category is tried for food, then stay; the others for stay, then food; what is left is an attraction.
    """
    texts = F.transform(categories, normalize_category)
    eats = lambda x: has_words(F.regexp_replace(x, rf"(?iuU)\b(?:{not_food})\b", " "), food)
    codes = lambda stay_first: lambda x: (
        F.when(has_words(x, stay), "ACCOMMODATION").when(eats(x), "FOOD_AND_DRINK") if stay_first else F.when(eats(x), "FOOD_AND_DRINK").when(has_words(x, stay), "ACCOMMODATION")
    )
    others = F.filter(F.transform(F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1))), codes(True)), lambda x: x.isNotNull())
    return F.coalesce(F.get(F.transform(F.slice(texts, 1, 1), codes(False)), F.lit(0)), F.get(others, F.lit(0)), F.lit("ATTRACTIONS"))


def sub_types(df: DataFrame, categories: str, group: str, rules: list[tuple[str, str, str | None, str | None]], fallback: dict[str, str], generic: str) -> DataFrame:
    """Adds sub_types: the codes of all rules (code, words, words to leave out, group that counts as a match) in order.

    Without any: the group's fallback, or LANDMARK where a sight has only a generic category.
    """
    texts, code = F.transform(categories, normalize_category), F.upper(F.coalesce(F.col(group), F.lit("")))
    own = lambda out: (lambda x: F.regexp_replace(x, rf"(?iuU)\b(?:{out})\b", " ")) if out else (lambda x: x)
    hit = lambda words, out, hint: F.exists(texts, lambda x: has_words(own(out)(x), words)) | (code == hint if hint else F.lit(False))
    found = F.array_compact(F.array(*(F.when(hit(words, out, hint), name) for name, words, out, hint in rules)))
    sight = code.isin("ATTRACTIONS", *LEGACY_GROUPS) & F.exists(texts, lambda x: has_words(x, generic))
    rest = F.coalesce(*(F.when(code == g, c) for g, c in fallback.items()), F.when(sight, "LANDMARK"))
    return df.withColumn("sub_types", F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(rest))))


def title_translations(df: DataFrame) -> DataFrame:
    """Adds translations, {vi, en}, where the place is in the country and local_title differs from title beyond case."""
    local, title = blank_to_null(F.col("local_title")), F.coalesce(F.trim("title"), F.lit(""))
    return df.withColumn("translations", F.when(F.col("in_country") & (F.lower(local) != F.lower(title)), F.create_map(F.lit("vi"), local, F.lit("en"), title)))


def detect_language(text: Column) -> Column:
    """vi where a letter with a Vietnamese accent occurs, else en."""
    # fixed values: the letters
    marked = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
    return F.when(F.rlike(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{marked}]")), "vi").otherwise("en")
