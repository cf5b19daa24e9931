"""Secret scans with multipart credential linking, in Spark SQL expressions only.

Base kinds are found on their own. Beyond them, a credential is often split into parts: an access identifier, a secret
and an endpoint. Each part alone may be weak (a user name, a random-looking word, a host). An interval join of the parts
within a scope reports weak candidates only where complementary parts stand together.

Spans are code points [start, end). No pattern crosses a line break.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, numbered, unused

#: Base kinds in the order in which they are listed. For access and hex the least length is part of the pattern: a run
#: is matched whole or not at all. A short value of an assignment still consumes its text, so it is filtered afterwards.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
MIN_VALUE = 6
#: Weak candidates.
WEAK = {
    "weak_id": r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "weak_secret": r"[A-Za-z0-9+/_=-]{16,}",
    "endpoint": r"""(?:[a-z][a-z0-9+]{1,9}://[^\s"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})""",
}
KINDS = [*BASE, *WEAK]
#: The part of a credential that each kind plays.
PART = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: Parts whose spans lie within so many code points of each other share a scope.
SCOPE = 160
#: A text without any of these holds no match that can count; looking for them is far cheaper than the pattern.
HINTS = {"assign": ("=", ":"), "access": ("AKIA",), "weak_id": ("=", ":"), "weak_secret": ("=", ":", "AKIA"), "endpoint": ("=", ":")}


def pieces(text: Column, kind: str) -> Column:
    """Array of (kind, k, gap, length, ok): all leftmost non-overlapping matches in text, each with the gap before it.

    split() and regexp_extract_all() walk the same matches, so the k-th gap stands before the k-th match.
    """
    pattern = (BASE | WEAK)[kind]
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    ok = {
        "assign": lambda x: F.length(F.regexp_extract(x, pattern, 2)) >= MIN_VALUE,
        "weak_secret": lambda x: F.rlike(x, F.lit("[0-9]")) & F.rlike(x, F.lit("[A-Za-z]")),
    }.get(kind, lambda x: F.lit(True))
    paired = F.transform(
        F.arrays_zip(matches.alias("found"), F.slice(gaps, 1, F.size(matches)).alias("gap")),
        lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("length"), ok(x["found"]).alias("ok")),
    )
    return F.when(reduce(or_, [F.contains(text, F.lit(h)) for h in HINTS[kind]]), paired) if kind in HINTS else paired


def base_and_weak_spans(docs: DataFrame, number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: row_no, doc_id; spans: row_no, kind, start, end). One scan of the texts. number: a column that differs in every
    row, else rows are numbered here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        (F.col(number) if number else F.monotonically_increasing_id()).alias("row_no"), F.col("doc_id"),
        F.flatten(F.array_compact(F.array(*(pieces(text, k) for k in KINDS)))).alias("pieces"),
    )
    rows = materialize(found, "secrets")
    each = rows.select("row_no", F.explode("pieces").alias("p")).select("row_no", "p.*")
    upto = Window.partitionBy("row_no", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    spans = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).where("ok")
    return rows.drop("pieces"), spans.select("row_no", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The spans of base kinds, and those of weak kinds whose complementary parts stand within scope.

    A weak span counts if a base span that plays another part is near, or if both other parts are. Spans that overlap
    don't complete each other, and a weak secret that overlaps a base span is the same thing found twice. The interval
    join runs over bins of `scope` code points within a text: an equi-join, whose pairs a bin's length bounds.
    """
    part = F.create_map(*(F.lit(x) for pair in PART.items() for x in pair))[F.col("kind")]
    strong = F.col("kind").isin(*BASE)
    bins = lambda pad: F.explode(F.sequence(F.floor((F.col("start") - pad) / scope), F.floor((F.col("end") + pad - 1) / scope)))
    weak = spans.where(~strong).select("*", part.alias("part"), bins(scope).alias("bin")).alias("a")
    other = spans.select("row_no", *(F.col(c).alias(f"o_{c}") for c in ("start", "end")), part.alias("o_part"), strong.alias("o_strong"), bins(0).alias("bin")).alias("b")
    apart = (F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start"))
    near = (F.col("o_start") - F.col("end") <= scope) & (F.col("start") - F.col("o_end") <= scope)
    met = weak.join(other, ["row_no", "bin"]).where(near & (F.col("part") != F.col("o_part")) & apart | ~apart & F.col("o_strong"))
    judged = met.groupBy("row_no", "kind", "start", "end").agg(
        F.bool_or(~apart).alias("known"), F.bool_or(F.col("o_strong")).alias("strong"), F.array_size(F.collect_set("o_part")).alias("parts")
    )
    linked = judged.where(~F.col("known") & (F.col("strong") | (F.col("parts") >= 2))).select("row_no", "kind", "start", "end")
    return spans.where(strong).unionByName(linked)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, number: str | None = None) -> DataFrame:
    """row_no (of the column number, if given), doc_id and found, an array of (start, order, kind, end) by start and kind, for every row of docs.

    A null text counts as empty and has no spans; equal rows each get a row; an empty table gives none. Columns of docs
    other than doc_id and text are ignored, whatever their names. A text of any length is met whole.
    """
    rows, spans = base_and_weak_spans(docs, number)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    by_row = link_parts(spans).groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "kind", "end"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,order:bigint,kind:string,end:bigint>>")
    return rows.join(by_row, "row_no", "left").withColumn("found", F.coalesce("found", none))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by mark; rows, order of columns and a null text stay.

    Rows have names that stay (see numbered), so that spans and texts meet by the same ones whatever is run again.
    """
    number, found = unused(docs, "row_number"), unused(docs, "found")
    rows = numbered(docs, number)
    spans = scan(rows.select(number, "doc_id", "text"), number).where(F.size("found") > 0).select(F.col("row_no").alias(number), F.col("found").alias(found))
    text = F.col("text")
    # spans by start; overlapping ones keep only what reaches beyond the ones before
    between = lambda a, x: F.concat(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark))
    step = lambda a, x: F.when(x["end"] > a["at"], F.struct(
        F.concat(a["out"], F.when(x["start"] >= a["at"], between(a, x)).otherwise(F.lit(""))).alias("out"), x["end"].alias("at"))).otherwise(a)
    clean = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    return rows.join(spans, number, "left").withColumn("text", F.when(F.col(found).isNull(), text).otherwise(clean)).select(*docs.columns)
