"""Names of places: normal form, quote support, evidence, similarity and linking to a catalogue."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DoubleType
from pyspark.sql.window import Window

from cartolake.functions.storage import stored
from cartolake.operators.mentions import MIN_GAP, MIN_SCORE, confidence, resolve_matches

#: The least confidence, and below the thresholds of quotes and similarities.
MIN_CONFIDENCE = 0.72
#: Share of the context in a score.
CONTEXT = 0.14
#: Least score of a runner-up that can make a match ambiguous, and a little for the rounding of differences.
LEAST_SCORE = MIN_SCORE - MIN_GAP - 1e-9
#: Accented Latin letters by their bare form.
BARE = {
    "a": "àáạảãâầấậẩẫăằắặẳẵäåā", "e": "èéẹẻẽêềếệểễëē", "i": "ìíịỉĩîïī", "o": "òóọỏõôồốộổỗơờớợởỡöō",
    "u": "ùúụủũưừứựửữûüū", "y": "ỳýỵỷỹÿ", "d": "đ", "c": "ç", "n": "ñ",
}


def match_text(column: Column) -> Column:
    """Lower case, without accents, words apart by one space; null is empty."""
    marked, bare = "".join(BARE.values()), "".join(k * len(v) for k, v in BARE.items())
    plain = F.regexp_replace(F.replace(F.translate(F.lower(F.coalesce(column, F.lit(""))), marked, bare), F.lit("ß"), F.lit("ss")), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(plain, r"(?U)[^\w]+", " "))


def words_of(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: x != "")


def enum_code(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(column, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype=float)


#: Fixed value: the least ratio of a window.
WINDOW_RATIO = 0.58


def near_window(quote: str, text: str) -> bool:
    """Whether some run of the text's words, nearly as long as the quote, has a ratio of WINDOW_RATIO or more.

    A ratio counts characters in common blocks, which are a common subsequence; so twice the longest one's length over
    both lengths is at least the ratio. From each first word one pass over the words of the longest window gives that
    length for windows of all sizes, in whole-number operations on the quote's characters at once, and without it where the
    characters that both hold in any order are too few. Only a window whose bound is enough is compared in full.
    """
    size, words = len(quote.split()), text.split()
    sizes = range(max(2, size - 2), min(len(words), size + 3) + 1)
    if not sizes:
        return False
    places: dict[str, int] = {}
    for k, c in enumerate(quote):
        places[c] = places.get(c, 0) | 1 << k
    n, whole, wanted = len(quote), (1 << len(quote)) - 1, Counter(quote)
    # characters of the longest window from each first word, each as often as the quote wants it
    own = [Counter(c for c in w if c in places) for w in words]
    window: Counter[str] = Counter()
    for w in own[: sizes[-1] - 1]:
        window.update(w)
    for first in range(len(words) - sizes[0] + 1):
        if first:
            window.subtract(own[first - 1])
        if first + sizes[-1] <= len(words):
            window.update(own[first + sizes[-1] - 1])
        # spaces apart: a window of k words has k - 1 of them
        common = sum(min(m, window[c]) for c, m in wanted.items() if c != " ")
        least = sum(map(len, words[first : first + sizes[0]])) + sizes[0] - 1
        if 2 * (common + min(wanted[" "], sizes[-1] - 1)) < WINDOW_RATIO * (n + least):
            continue
        left, length = whole, 0
        for k, w in enumerate(words[first : first + sizes[-1]], 1):
            for c in w if k == 1 else " " + w:
                met = left & places.get(c, 0)
                left = ((left + met) | (left - met)) & whole
            length += len(w) + (k > 1)
            if k < sizes[0] or 2 * (n - left.bit_count()) < WINDOW_RATIO * (n + length):
                continue
            if SequenceMatcher(None, quote, " ".join(words[first : first + k])).ratio() >= WINDOW_RATIO:
                return True
    return False


@F.pandas_udf(BooleanType())
def window_near(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([near_window(q, t) if q and t else False for q, t in zip(quote, text, strict=True)], dtype=bool)


def quote_support(df: DataFrame, quote: str, text: str) -> DataFrame:
    """Adds supported: the quote's words stand in the text, or most of them do. Only a coverage of 0.6 to 0.8 leaves the JVM."""
    rows = df.withColumns({"q_": match_text(F.col(quote)), "t_": match_text(F.col(text))}).withColumns({"qw_": words_of(F.col("q_")), "tw_": F.array_distinct(words_of(F.col("t_")))})
    covered = F.size(F.filter("qw_", lambda w: F.array_contains("tw_", w))) / F.greatest(F.size("qw_"), F.lit(1))
    whole = F.contains(F.concat(F.lit(" "), "t_", F.lit(" ")), F.concat(F.lit(" "), "q_", F.lit(" ")))
    filled = (F.col("q_") != "") & (F.col("t_") != "")
    rows = rows.withColumn("state_", F.when(~filled, "no").when(whole, "yes").when((F.size("qw_") < 2) | (covered < 0.6), "no").when(covered >= 0.8, "yes").otherwise("near"))
    ask = lambda c: F.when(F.col("state_") == "near", F.col(c))
    checked = rows.withColumn("near_", window_near(ask("q_"), ask("t_")))
    return checked.withColumn("supported", (F.col("state_") == "yes") | F.col("near_")).drop("q_", "t_", "qw_", "tw_", "state_", "near_")


def generic_name(df: DataFrame, names: list[str], hints: tuple[str, ...] = ("city_hint", "region_hint", "country_hint")) -> DataFrame:
    """Adds is_generic: no name, or one of names (in normal form) once the words of the hints are taken out."""
    rest = F.concat(F.lit(" "), match_text(F.col("name")), F.lit(" "))
    for hint in hints:
        words = match_text(F.col(hint))
        rest = F.when(words == "", rest).otherwise(F.replace(rest, F.concat(F.lit(" "), words, F.lit(" ")), F.lit(" ")))
    bare = F.trim(F.regexp_replace(rest, " +", " "))
    return df.withColumn("is_generic", (match_text(F.col("name")) == "") | bare.isin(names))


def evidence_decision(mentions: DataFrame, evidence: DataFrame) -> DataFrame:
    """mentions (mention_id, name, is_generic, identity_status, mention_type, inference_used, confidence) with reason and mode.

    evidence: mention_id, source, quote, frame_index, frame_count (null: unknown), supports_identity, supported.
    """
    source, quoted = enum_code(F.col("source")), F.trim(F.coalesce("quote", F.lit(""))) != ""
    frame = (F.col("frame_index") > 0) & (F.col("frame_count").isNull() | (F.col("frame_index") <= F.col("frame_count")))
    some = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    found = evidence.where("supports_identity").groupBy("mention_id").agg(
        some((source == "audio") & quoted & F.col("supported"), "audio_"), some((source == "caption_context") & quoted & F.col("supported"), "caption_"),
        some(source.isin("frame", "slide") & quoted & frame, "visual_"),
    )
    kind = enum_code(F.col("mention_type"))
    mode = (
        F.when((kind == "explicit_audio_name") & F.col("audio_"), "ai_confirmed_audio").when((kind == "exact_visible_sign") & F.col("visual_"), "ai_confirmed_visual")
        .when((kind == "multimodal_confirmed") & F.col("audio_") & F.col("visual_"), "ai_confirmed_multimodal").when((kind == "creator_caption") & F.col("caption_"), "ai_confirmed_caption")
    )
    reason = (
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "missing_name").when(F.col("is_generic"), "generic_or_unnamed_place")
        .when(enum_code(F.col("identity_status")) != "confirmed", "ai_identity_not_confirmed")
        .when(~kind.isin("explicit_audio_name", "exact_visible_sign", "multimodal_confirmed", "creator_caption"), "ai_marked_inferred_or_generic")
        .when(F.col("inference_used"), "ai_used_identity_inference").when(confidence(F.col("confidence").cast("string")) < MIN_CONFIDENCE, "confidence_below_threshold")
        .when(mode.isNull(), "evidence_guardrail_failed").otherwise("accepted")
    )
    rows = mentions.join(found, "mention_id", "left").withColumn("reason", reason)
    return rows.withColumn("mode", F.when(F.col("reason") == "accepted", mode)).drop("audio_", "caption_", "visual_")


def retain_mentions(decided: DataFrame) -> DataFrame:
    """The named and not generic ones, as EVIDENCE_VERIFIED or UNRESOLVED, in order of their source position (pos)."""
    kept = decided.where(~F.col("reason").isin("missing_name", "generic_or_unnamed_place"))
    return kept.withColumn("status", F.when(F.col("reason") == "accepted", "EVIDENCE_VERIFIED").otherwise("UNRESOLVED")).withColumn("sequence", F.col("pos") + 1)


def token_f1(a: Column, b: Column) -> Column:
    """Of two sets of words; 0 where they share none."""
    return 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))


def similarity(a: Column, b: Column, wa: Column, wb: Column, alike: Column) -> Column:
    """Of normal forms a and b, their word sets and their ratio."""
    shared = F.size(F.array_intersect(wa, wb))
    least = F.least(F.size(wa), F.size(wb))
    score = 0.6 * token_f1(wa, wb) + 0.4 * alike
    score = F.when((least >= 2) & (shared == least), F.greatest(score, F.lit(0.9))).otherwise(score)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(shared == 0, alike * 0.55).otherwise(F.least(score, F.lit(1.0)))


def name_similarity(df: DataFrame, left: str, right: str, to: str = "similarity") -> DataFrame:
    a, b = match_text(F.col(left)), match_text(F.col(right))
    rows = df.withColumns({"a_": a, "b_": b}).withColumns({"wa_": F.array_distinct(words_of(F.col("a_"))), "wb_": F.array_distinct(words_of(F.col("b_")))})
    asked = (F.col("a_") != "") & (F.col("b_") != "") & (F.col("a_") != F.col("b_"))  # else the ratio doesn't count
    rows = rows.withColumn("r_", ratio(F.when(asked, F.col("a_")), F.when(asked, F.col("b_"))))
    return rows.withColumn(to, similarity(F.col("a_"), F.col("b_"), F.col("wa_"), F.col("wb_"), F.col("r_"))).drop("a_", "b_", "wa_", "wb_", "r_")


@F.pandas_udf(ArrayType(DoubleType()))
def ratios(texts: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([[SequenceMatcher(None, x, y).ratio() for x in xs] for xs, y in zip(texts, other, strict=True)], dtype=object)


def best_similarity(texts: Column, other: Column) -> Column:
    """Largest similarity of an array of normal forms to another normal form; 0 for an empty array."""
    words = lambda x: F.array_distinct(words_of(x))
    each = F.zip_with(texts, ratios(texts, other), lambda x, alike: similarity(x, other, words(x), words(other), alike))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def match_score(pairs: DataFrame) -> DataFrame:
    """pairs (name, aliases, hints; title, address, category) with score: of the best name against the title, and with any
    hint also, at 0.14, of the best hint against address, category and title. Null and blank names and hints don't count."""
    forms = lambda c: F.transform(F.filter(c, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), match_text)
    none = F.array().cast("array<string>")
    rows = pairs.withColumns({
        "names_": forms(F.concat(F.array("name"), F.coalesce("aliases", none))), "hints_": forms(F.coalesce("hints", none)),
        "title_": match_text(F.col("title")), "place_": match_text(F.concat_ws(" ", "address", "category", "title")),
    })
    rows = rows.withColumns({"by_name_": best_similarity(F.col("names_"), F.col("title_")), "by_hint_": best_similarity(F.col("hints_"), F.col("place_"))})
    whole = F.least(F.lit(1.0), (1 - CONTEXT) * F.col("by_name_") + CONTEXT * F.col("by_hint_"))
    return rows.withColumn("score", F.when(F.size("hints_") > 0, whole).otherwise(F.col("by_name_"))).drop("names_", "hints_", "title_", "place_", "by_name_", "by_hint_")


#: A word of more distinct names than this is heavy: names that share it alone meet by length too, and only where that can matter.
HEAVY_NAMES = 1_000
#: Names of each side that meet in one sub-block at most, about.
SUB_BLOCK = 2_000
#: Width of the classes of length, as a logarithm.
LENGTH_STEP = 0.1


def word_blocks(names: DataFrame, least: float = LEAST_SCORE, heavy_names: int | None = None) -> DataFrame:
    """side, normal, words, prefix, word, heavy, tail: the words of distinct names (side: a or b, normal), rarest first, without those that can't decide.

    A name's score counts from `least` on. Without a shared word it is 0.55 at most. With one shared word of n + m words
    it is 1.2 / (n + m) + 0.4 of the ratio, which is below 1. For LEAST_SCORE (0.60, names alone) that is too little from
    n + m = 6 on: of four or more words the most frequent one is left out, as names that share it share another, or are a
    name of four words and one of that word alone. These two meet by a key of their own (word with the side of the longer
    one). For a smaller least it is left out where 1.2 / (n + 1) + 0.4 is too little already. So words as common as
    "restaurant" don't pair all the longer names that have them.

    heavy: more than HEAVY_NAMES distinct names have the word; tail: it is heavy and the most frequent word of this name, so
    what meets the name there shares no other word.
    """
    rows = names.select("side", "normal").distinct().withColumn("words", F.array_distinct(words_of(F.col("normal"))))
    each = rows.select("side", "normal", "words", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    ordered = each.join(often, "word").groupBy("side", "normal").agg(F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("often", "word"))).alias("ranked"))
    ordered = ordered.withColumn("prefix", F.col("ranked")["word"])
    last = F.get("prefix", F.size("prefix") - 1)
    alone = lambda side: F.array(F.concat(side, F.lit("="), last))
    long = 4 if least >= LEAST_SCORE else math.ceil(1.2 / (least - 0.4))
    rare = F.when(F.size("prefix") >= long, F.slice("prefix", F.lit(1), F.size("prefix") - 1)).otherwise(F.col("prefix"))
    none = F.array().cast("array<string>")
    own = F.when(F.size("prefix") == 4, alone(F.col("side"))).when(F.size("prefix") == 1, alone(F.translate("side", "ab", "ba"))).otherwise(none) if long == 4 else none
    kept = ordered.withColumns({"last": last, "prefix": F.concat(rare, own)})
    kept = kept.withColumn("word", F.explode("prefix"))
    share = F.filter("ranked", lambda x: (x["word"] == F.col("word")) | F.endswith(F.col("word"), F.concat(F.lit("="), x["word"])))
    kept = kept.withColumn("heavy", F.get(share, F.lit(0))["often"] > F.lit(HEAVY_NAMES if heavy_names is None else heavy_names))
    tail = F.col("heavy") & ((F.col("word") == F.col("last")) | F.contains("word", F.lit("=")))
    return kept.withColumn("tail", tail).select("side", "normal", "words", "prefix", "word", "heavy", "tail")


def sub_blocks(a: DataFrame, b: DataFrame, keys: list[str], most: int = SUB_BLOCK) -> tuple[DataFrame, DataFrame]:
    """a and b (names in columns a and b) with cut_a and cut_b: a block of more than `most` rows on a side is cut there by the
    names' hash, and each name is repeated for the other side's cuts. Blocks that one side lacks go."""
    cuts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = cuts(a, "cuts_a").join(cuts(b, "cuts_b"), keys)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(sizes, keys).withColumn(f"cut_{own}", F.pmod(F.xxhash64(own), F.col(f"cuts_{own}")).cast("int"))
        return rows.withColumn(f"cut_{other}", F.explode(F.sequence(F.lit(0), F.col(f"cuts_{other}") - 1))).drop("cuts_a", "cuts_b")

    return dealt(a, "a", "b"), dealt(b, "b", "a")


def met_in_blocks(a: DataFrame, b: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """a and b, joined by keys in sub-blocks of SUB_BLOCK names a side at most, about; each meets in a task of its own."""
    left, right = sub_blocks(a, b, keys, most or SUB_BLOCK)
    return left.join(right, [*keys, "cut_a", "cut_b"]).drop("cut_a", "cut_b")


def scored(met: DataFrame, floor: Column) -> DataFrame:
    """a, b, score: the pairs met whose score is floor or more. Pairs whose lengths or whose edits rule it out never reach the ratio."""
    chars = F.length("a") + F.length("b")
    score = lambda alike: similarity(F.col("a"), F.col("b"), F.col("wa"), F.col("wb"), alike)
    able = met.where(F.col("a") != F.col("b")).where(score(2.0 * F.least(F.length("a"), F.length("b")) / chars) >= floor)
    # what matches keeps its order, so the rest is as many edits at least
    able = able.where(score(1.0 - F.levenshtein("a", "b") / chars + 1e-9) >= floor)
    return able.withColumn("score", score(ratio("a", "b"))).where(F.col("score") >= floor).select("a", "b", "score")


def block_side(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.where(F.col("side") == side).select("word", F.col("normal").alias(side), F.col("words").alias(f"w{side}"), F.col("prefix").alias(f"p{side}"), "heavy", F.col("tail").alias(f"t{side}"))


def same_names(blocks: DataFrame) -> DataFrame:
    of = lambda s: blocks.where(F.col("side") == s).select("normal").distinct()
    return of("a").join(of("b"), "normal").select(F.col("normal").alias("a"), F.col("normal").alias("b"), F.lit(1.0).alias("score"))


def rare_pairs(blocks: DataFrame, least: float, sub_block: int | None = None) -> DataFrame:
    """a, b, score of different names that share more than a heavy word, or a word that isn't heavy; each at its first shared word."""
    a, b = (block_side(blocks, s).where(~F.col(f"t{s}")).drop("heavy", f"t{s}") for s in "ab")
    met = met_in_blocks(a, b, ["word"], sub_block)
    return scored(met.where(F.col("word") == F.get(F.array_intersect("pa", "pb"), F.lit(0))), F.lit(least))


def tail_pairs(blocks: DataFrame, floors: DataFrame | None, least: float, sub_block: int | None = None) -> DataFrame:
    """a, b, score of different names that share one word, a heavy one, where the score is floor or more: that of floors (a, floor), or least.

    One shared word of n + m leaves a floor to the ratio, and so to the lengths. Names meet by word, number of words and
    class of length, each a at all those that its floor leaves.
    """
    a, b = (block_side(blocks, s).where("heavy").drop("heavy") for s in "ab")
    a = a.join(floors, "a") if floors is not None else a.withColumn("floor", F.lit(least))
    b = b.withColumns({"n_words": F.size("wb"), "class": F.floor(F.log(F.length("b")) / LENGTH_STEP).cast("int")})
    most = int(1.2 / (least - 0.4)) + 1
    a = a.withColumn("n_words", F.explode(F.sequence(F.lit(1), F.lit(most))))
    alike = (F.col("floor") - 1.2 / (F.size("wa") + F.col("n_words"))) / 0.4 - 1e-9
    # two names of one word that share it are the same one
    a = a.withColumn("alike", alike).where((F.col("alike") < 1.0) & (F.size("wa") + F.col("n_words") > 2))
    wide = F.log((2.0 - F.greatest("alike", F.lit(0.01))) / F.greatest("alike", F.lit(0.01))) + 1e-9
    at = lambda x: F.floor(x / LENGTH_STEP).cast("int")
    a = a.withColumn("class", F.explode(F.sequence(at(F.log(F.length("a")) - wide), at(F.log(F.length("a")) + wide))))
    a = a.withColumn("tb", F.explode(F.when(F.col("ta"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))).drop("alike")
    met = met_in_blocks(a, b, ["word", "n_words", "class", "tb"], sub_block)
    return scored(met.where(F.col("word") == F.get(F.array_intersect("pa", "pb"), F.lit(0))), F.col("floor"))


def blocks_of(names: DataFrame, titles: DataFrame, least: float, heavy_names: int | None = None) -> DataFrame:
    rows = names.select(F.lit("a").alias("side"), "normal").unionByName(titles.select(F.lit("b").alias("side"), "normal"))
    return stored(word_blocks(rows, least, heavy_names), "blocks")


def scored_names(names: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """a, b, score: distinct names (normal) and titles (normal) whose similarity is `least` or more and that share a word."""
    blocks = blocks_of(names, titles, least)
    return same_names(blocks).unionByName(rare_pairs(blocks, least)).unionByName(tail_pairs(blocks, None, least))


def deciding_names(names: DataFrame, titles: DataFrame, heavy_names: int | None = None, sub_block: int | None = None) -> DataFrame:
    """a, b, score like scored_names for LEAST_SCORE, but of pairs that share a heavy word alone only those that can decide a match.

    Such a pair of n + m words scores less than 1.2 / (n + m) + 0.4. A name whose best other pair has that and MIN_GAP more
    needs none of them. One without a match so far needs those from MIN_SCORE on, where names are nearly alike; then one
    with a match needs those that come within MIN_GAP of it.
    """
    blocks = blocks_of(names, titles, LEAST_SCORE, heavy_names)
    found = stored(same_names(blocks).unionByName(rare_pairs(blocks, LEAST_SCORE, sub_block)), "pairs")
    asked = blocks.where("side = 'a' AND heavy").select(F.col("normal").alias("a")).distinct()
    best = lambda pairs: asked.join(pairs.groupBy("a").agg(F.max("score").alias("best")), "a", "left")
    open_ = best(found).where(F.coalesce("best", F.lit(0.0)) < MIN_SCORE).select("a", F.lit(MIN_SCORE - 1e-9).alias("floor"))
    found = stored(found.unionByName(tail_pairs(blocks, open_, LEAST_SCORE, sub_block)), "pairs")
    # no pair of three words or more that share one scores 0.8
    close = best(found).where((F.col("best") >= MIN_SCORE) & (F.col("best") < 0.8 + MIN_GAP)).select("a", (F.col("best") - MIN_GAP - 1e-9).alias("floor"))
    return found.unionByName(tail_pairs(blocks, close, LEAST_SCORE, sub_block)).distinct()


def link_to_catalogue(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """mention_id, identity, score: mentions (mention_id, name, perhaps aliases and hints) matched to places (identity, title,
    perhaps address and category), by the rules of match_score and resolve_matches.

    Pairs of which no name shares a word with the title are not met; their score is 0.613 at most. Without aliases and
    hints names alone decide: distinct names meet distinct titles, and copies are expanded at the end. With them distinct
    (names, hints) meet distinct (title, context), and the context joins in only where the name's score leaves it a say.
    """
    if not {"aliases", "hints"} & set(mentions.columns):
        return link_by_name(mentions, places)
    forms = lambda c: F.array_distinct(F.filter(F.transform(F.filter(c, lambda x: x.isNotNull()), match_text), lambda x: x != ""))
    none = F.array().cast("array<string>")
    has = lambda df, c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    asked = mentions.select("mention_id", forms(F.concat(F.array("name"), has(mentions, "aliases", none))).alias("names"), forms(has(mentions, "hints", none)).alias("hints"))
    blank = F.lit("").cast("string")
    known = places.select("identity", match_text(F.col("title")).alias("b"), match_text(F.concat_ws(" ", has(places, "address", blank), has(places, "category", blank), F.col("title"))).alias("place"))
    kinds = asked.select("names", "hints").where(F.size("names") > 0).distinct()
    # of the places with one title and context two decide: an equal score for another identity is ambiguous
    sights = known.where("b <> ''").groupBy("b", "place").agg(F.min("identity").alias("first"), F.max("identity").alias("last"))
    named = kinds.select("names", "hints", F.explode("names").alias("normal"))
    pairs = scored_names(named, sights.withColumnRenamed("b", "normal"), (LEAST_SCORE - CONTEXT) / (1 - CONTEXT))
    best = named.join(pairs, named["normal"] == pairs["a"]).groupBy("names", "hints", "b").agg(F.max("score").alias("by_name"))
    met = stored(best.join(sights, "b"), "met")
    alone = met.where((F.size("hints") == 0) & (F.col("by_name") >= LEAST_SCORE)).withColumn("score", F.col("by_name"))
    # a context is compared once, not for each name that brings it, and in tasks of their own: its rows are short, but dear
    # (in another order of keys than the distinct rows have, as an equal one would be left out)
    tasks = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contexts = met.where(F.size("hints") > 0).select("hints", "place").distinct().repartition(tasks, "place", "hints").withColumn("by_hint", best_similarity(F.col("hints"), F.col("place")))
    hinted = met.where(F.size("hints") > 0).join(contexts, ["hints", "place"])
    hinted = hinted.withColumn("score", F.least(F.lit(1.0), (1 - CONTEXT) * F.col("by_name") + CONTEXT * F.col("by_hint"))).where(F.col("score") >= LEAST_SCORE).select(*alone.columns)
    each = alone.unionByName(hinted).select("names", "hints", "score", F.explode(F.array_distinct(F.array("first", "last"))).alias("identity")).withColumn("pos", F.col("identity"))
    decided = resolve_matches(each.withColumn("mention_id", F.struct("names", "hints")))
    return asked.withColumn("asked", F.struct("names", "hints")).join(decided.withColumnRenamed("mention_id", "asked"), "asked").select("mention_id", "identity", "score")


def link_by_name(mentions: DataFrame, places: DataFrame) -> DataFrame:
    normal = lambda df, c: df.withColumn("normal", match_text(F.col(c))).where("normal <> ''")
    named, titled = normal(mentions, "name"), normal(places, "title")
    pairs = deciding_names(named, titled)
    # of a title's places two decide: an equal score for another identity is ambiguous
    owners = titled.groupBy("normal").agg(F.min("identity").alias("first"), F.max("identity").alias("last")).select(F.col("normal").alias("b"), F.array_distinct(F.array("first", "last")).alias("owners"))
    best = pairs.join(owners, "b").select("a", "score", F.explode("owners").alias("identity")).withColumn("pos", F.col("identity"))
    decided = resolve_matches(best.withColumnRenamed("a", "mention_id")).withColumnRenamed("mention_id", "normal")
    return named.join(decided, "normal").select("mention_id", "identity", "score")


def enrich_mentions(mentions: DataFrame, matches: DataFrame) -> DataFrame:
    """mentions (mention_id, map_query, search_failed) with identity, score, status and its reason."""
    rows = mentions.join(matches, "mention_id", "left")
    reason = (
        F.when(F.trim(F.coalesce("map_query", F.lit(""))) == "", "missing_map_query").when(F.col("search_failed"), "map_search_failed")
        .when(F.col("identity").isNull(), "weak_or_ambiguous_map_match")
    )
    return rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "RESOLVED").otherwise("UNRESOLVED"))


def reject_posts(posts: DataFrame, most_seconds: float) -> DataFrame:
    """posts (duration, on_topic) with verdict. An unknown topic proceeds, and so does a post without any text (caption, title,
    tags, transcript, where there are such columns), whatever was said of its topic: there was nothing to judge by."""
    texts = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("caption", "title", "transcript") if c in posts.columns] + [F.size(F.coalesce("tags", F.array())) > 0 for c in ("tags",) if c in posts.columns]
    judged = reduce(or_, texts) if texts else F.lit(True)
    return posts.withColumn(
        "verdict",
        F.when(F.col("duration").isNull() | (F.col("duration") <= 0), "DURATION_UNAVAILABLE").when(F.col("duration") > most_seconds, "REJECTED_DURATION")
        .when(~F.col("on_topic") & judged, "REJECTED_TOPIC").otherwise("PROCEED"),
    )


def drop_near_identical(frames: DataFrame, most: float, tile: int = 1) -> DataFrame:
    """video, pos of the frames (video, pos, vector) kept: each is compared with the last kept one, tile by tile of `tile`
    components (a rest that fills none doesn't count); `most` is the largest mean difference of a tile that still counts as
    the same. Frames of unequal sizes differ; one without a vector stays, and so does the next. Videos of two frames or
    fewer stay whole, as do frames without a video or a place, which go around the comparison. A video's frames come to a
    task in order and pass one by one, so that it holds two of them however long a video is.
    """
    own = frames.select("video", "pos", "vector")
    lone = own.where("video IS NULL OR pos IS NULL").select("video", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, seen, last, waiting = None, 0, None, None

        def same(here: np.ndarray | None) -> bool:
            if here is None or last is None or here.size != last.size:
                return False
            apart = np.abs(here - last)[: here.size // tile * tile].reshape(-1, tile).mean(axis=1)
            return bool(apart.max(initial=0.0) <= most)

        for batch in batches:
            kept: list[tuple] = []
            for k, (v, pos) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                cell = batch.column(2)[k]
                here = cell.values.to_numpy(zero_copy_only=False).astype(float) if cell.is_valid else None
                if v != video:
                    if waiting:
                        kept.append(waiting[0])
                    video, seen, last, waiting = v, 1, here, None
                    kept.append((v, pos))
                    continue
                seen += 1
                if seen == 2:  # stays if it is the last one
                    waiting = (v, pos), here
                    continue
                if waiting:
                    if not same(waiting[1]):
                        kept.append(waiting[0])
                        last = waiting[1]
                    waiting = None
                if not same(here):
                    kept.append((v, pos))
                    last = here
            yield out(kept)
        yield out([waiting[0]] if waiting else [])

    def out(kept: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], t) for k, t in enumerate(types)], ["video", "pos"])

    schema = lone.schema
    types = [to_arrow_type(f.dataType) for f in schema]
    ordered = own.where("video IS NOT NULL AND pos IS NOT NULL").repartition("video").sortWithinPartitions("video", "pos")
    return ordered.mapInArrow(run, schema).unionByName(lone)


def progress_view(mentions: DataFrame, done: int) -> DataFrame:
    """mentions (post_id, pos) with stage, where the first `done` of each post are DONE, and how many of the post are so and aren't."""
    own = Window.partitionBy("post_id")
    n, total = F.row_number().over(own.orderBy("pos")), F.count("*").over(own)
    first = F.least(F.lit(done).cast("long"), total)
    return mentions.withColumns({"stage": F.when(n <= done, "DONE").otherwise("PENDING"), "n_done": first, "n_pending": total - first})
