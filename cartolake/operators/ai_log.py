"""The log of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions.text import first_truthy


#: The least characters of a base64 value and of an inline data URL that are redacted, and their forms.
BASE64_CHARS, DATA_URL_CHARS = 512, 64
BASE64_VALUE = rf"^[A-Za-z0-9+/=]{{{BASE64_CHARS},}}$"
DATA_URL = rf"data:[\w.+/-]+;base64,[A-Za-z0-9+/=]{{{DATA_URL_CHARS},}}"


def redact_payload(df: DataFrame, column: str) -> DataFrame:
    """Values of 512 base64 characters or more, and inline data URLs, become notes of their length."""
    c = F.col(column)
    whole = F.when(F.rlike(c, F.lit(BASE64_VALUE)), F.concat(F.lit("<base64 "), F.length(c).cast("string"), F.lit(" chars>")))
    notes = F.transform(F.regexp_extract_all(c, F.lit(DATA_URL), F.lit(0)), lambda x: F.concat(F.lit("<data-url "), F.length(x).cast("string"), F.lit(" chars>")))
    pieces = F.zip_with(F.split(c, DATA_URL, -1), notes, lambda text, note: F.concat(text, F.coalesce(note, F.lit(""))))
    return df.withColumn(column, F.coalesce(whole, F.array_join(pieces, "")))


def usage_tokens(df: DataFrame) -> DataFrame:
    """Adds input_tokens, cached_tokens, output_tokens from the response JSON, in either style of its usage block."""
    at = lambda path: F.get_json_object("response", path).try_cast("bigint")
    cached = F.coalesce(at("$.usage.prompt_tokens_details.cached_tokens"), at("$.usage.prompt_cache_hit_tokens"), at("$.usage.cache_read_input_tokens"))
    fresh = at("$.usage.input_tokens") + F.coalesce(at("$.usage.cache_read_input_tokens"), F.lit(0))
    return df.withColumns({"input_tokens": F.coalesce(at("$.usage.prompt_tokens"), fresh), "cached_tokens": cached, "output_tokens": F.coalesce(at("$.usage.completion_tokens"), at("$.usage.output_tokens"))})


def ai_call_rows(df: DataFrame) -> DataFrame:
    """trace_id, operation, provider, model, status, latency_ms and tokens of every call; blank texts are null, as are columns that aren't there."""
    own = usage_tokens(df)
    text = lambda c: first_truthy(F.col(c)) if dict(own.dtypes).get(c) == "string" else F.col(c) if c in own.columns else F.lit(None).cast("string")
    return own.select(text("trace_id").alias("trace_id"), text("operation").alias("operation"), F.lower(text("provider")).alias("provider"), text("model").alias("model"), F.when(F.col("ok"), "SUCCEEDED").otherwise("FAILED").alias("status"), "latency_ms", "input_tokens", "cached_tokens", "output_tokens")


def extraction_eval(calls: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per url and model: calls, successes, and the mentions by status and, where they have a mention_type, by that, as a map
    (mentions: url, model, status, perhaps mention_type)."""
    runs = calls.groupBy("url", "model").agg(F.count("*").alias("n_calls"), F.count_if("ok").alias("n_ok"))
    status = lambda s, to: F.count_if(F.col("status") == s).alias(to)
    found = mentions.groupBy("url", "model").agg(F.count("*").alias("n_mentions"), status("EVIDENCE_VERIFIED", "n_verified"), status("UNRESOLVED", "n_unresolved"), status("DISCARDED", "n_discarded"))
    out = runs.join(found, ["url", "model"], "left").fillna(0, ["n_mentions", "n_verified", "n_unresolved", "n_discarded"])
    if "mention_type" not in mentions.columns:
        return out
    kinds = mentions.where("mention_type IS NOT NULL").groupBy("url", "model", "mention_type").agg(F.count("*").alias("n"))
    by_type = kinds.groupBy("url", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mention_type", "n")))).alias("by_type"))
    return out.join(by_type, ["url", "model"], "left").withColumn("by_type", F.coalesce("by_type", F.create_map().cast("map<string,bigint>")))
