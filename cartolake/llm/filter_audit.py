"""How filters interact: what each removes after which others, over every order of them.

Each filter has its failing-id relation, a table of the rows that fail it. Rows have a number of their own, so that null and
repeated doc_ids count as what they are. A prefix is a set of filters that ran before: its survivors don't depend on their
order, so 32 sets stand for all prefixes of the 120 orders of five filters. Level by level, with the survivors of the
prefixes of k filters facing each further filter, and with the failing ids of that filter, once for each such prefix:

* left-semi: survivors that fail are removed by the filter; label losses are sums over them;
* left-anti: survivors that don't fail outlive it; those of level k + 1 are taken from them;
* left-anti the other way round: failing ids that aren't among the survivors are redundant.

All three join on (row, prefix, filter), a key that no two rows of a side share, so nothing is hot. Rows that fail nothing
survive every prefix and are only counted. The ids have no size bound, so they are merged, never broadcast: a file of
numbers in order is far smaller than its rows. What outlives a level is written once, which keeps each plan small.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .quality import bind, text_of, words_of

KEY = ["row", "prefix", "filter"]
COUNTS = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]


def default_filters() -> dict[str, Column]:
    """Failure conditions over text, by letter; all but the exact copies."""
    text, words = text_of(), words_of(text_of())
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    few = bind(words, lambda w: F.array(F.size(w) < 200, 100 * F.size(F.array_distinct(w)) < 50 * F.size(w)))
    return {"A": few[0], "B": few[1], "C": 100 * upper > 3 * F.length(text), "D": F.rlike(text, F.lit("[#$%&*|]"))}


def audited_rows(docs: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """row, doc_id, part, digest and whether each filter fails, for every row: written once, so row names it from then on."""
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text_of().cast("binary"), 256))
    fails = [f.alias(f"fails_{name}") for name, f in filters.items()]
    measured = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), digest.alias("digest"), *fails)
    return materialize(measured, "audited")


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller doc_id has too; null doc_ids are compared with none.

    The first of each text are anti-joined by text and doc_id, so the copies of one text don't meet in one task.
    """
    known = rows.where(F.col("doc_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return merged(known, firsts, ["digest", "doc_id"], "left_anti")


def failing_ids(rows: DataFrame, names: list[str], copies: str | None) -> dict[str, DataFrame]:
    """One stored table (row, part) for each filter: the rows that fail it."""
    found = {n: rows.where(F.col(f"fails_{n}")) for n in names} | ({copies: later_copies(rows)} if copies else {})
    return {n: materialize(d.select("row", "part"), f"failing-{n}") for n, d in sorted(found.items())}


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """row, part, good, toxic; a doc_id that labels has twice counts as good or toxic if one of them says so."""
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    none = F.lit(0).cast("long")
    return rows.select("row", "part", "doc_id").join(flags, "doc_id", "left").select("row", "part", *(F.coalesce(c, none).alias(c) for c in ("good", "toxic")))


def each_of(column: Column, pairs: dict[str, list[str]]) -> Column:
    """The entries that pairs has for the value of column, as rows: a list of the filters' letters, bounded by their number."""
    return F.explode(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[column])


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    return left.hint("merge").join(right.hint("merge"), on, how)


def interactions(facts: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """part, prefix, filter, kept, removed, redundant, good_lost, toxic_lost of each prefix (letters in order) and filter.

    facts: row, part, good, toxic of rows that fail something. Triples without any such row are missing.
    """
    names, none = list(failing), F.lit(0).cast("long")
    ids = reduce(DataFrame.unionByName, (d.withColumn("filter", F.lit(n)) for n, d in failing.items()))
    survivors, found = facts.withColumn("prefix", F.lit("")), []
    for size in range(len(names)):
        prefixes = ["".join(c) for c in combinations(names, size)]
        facing = survivors.withColumn("filter", each_of(F.col("prefix"), {p: [n for n in names if n not in p] for p in prefixes}))
        wanted = ids.withColumn("prefix", each_of(F.col("filter"), {n: [p for p in prefixes if n not in p] for n in names}))
        removed, redundant = merged(facing, wanted, KEY, "left_semi"), merged(wanted, facing, KEY, "left_anti")
        kept = materialize(merged(facing, wanted, KEY, "left_anti"), f"kept-{size}")
        one = F.count("*")
        counts = [(kept, {"kept": one}), (removed, {"removed": one, "good_lost": F.sum("good"), "toxic_lost": F.sum("toxic")}), (redundant, {"redundant": one})]
        level = [rows.groupBy("part", "prefix", "filter").agg(*(own.get(c, none).alias(c) for c in COUNTS)) for rows, own in counts]
        found.append(materialize(reduce(DataFrame.unionByName, level), f"level-{size}"))
        # each set of letters once: from the prefix without its last letter
        survivors = kept.where(F.col("filter") > F.substring("prefix", -1, 1)).select(F.concat("prefix", "filter").alias("prefix"), "row", "part", "good", "toxic")
    return reduce(DataFrame.unionByName, found).groupBy("part", "prefix", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E") -> DataFrame:
    """part, filter_order, step, filter and the long counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
    for each lang of docs (doc_id, text, lang), each order of the filters and each step; zeros included.

    filters: conditions over docs under which a row fails, by letter. copies: the letter of a further filter, which fails
    texts that a smaller doc_id has. A null text is empty; a null lang is the part of the empty string; a null doc_id has no
    labels and is no copy; rows that share a doc_id count one by one; texts of any length are met whole; other columns
    play no part, whatever their names. An empty table gives no rows; without labels nothing is lost of them.
    """
    filters = default_filters() if filters is None else filters
    rows = audited_rows(docs, filters)
    failing = failing_ids(rows, list(filters), copies)
    facts = materialize(with_labels(rows, labels), "audit-facts")
    some = reduce(DataFrame.unionByName, (d.select("row") for d in failing.values()))
    touched = materialize(merged(facts, some, ["row"], "left_semi"), "touched")
    clean = merged(facts, some, ["row"], "left_anti").groupBy("part").agg(F.count("*").alias("clean"))
    counts = interactions(touched, failing)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(failing)))
    steps = facts.groupBy("part").agg(F.count("*").alias("rows")).join(clean, "part", "left").select("part", "clean", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(failing)))).alias("step"))
    placed = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("prefix", F.array_join(F.array_sort(F.split(F.expr("substring(filter_order, 1, step - 1)"), "")), ""))
    found = placed.join(counts, ["part", "prefix", "filter"], "left").select(*placed.columns, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS))
    all_orders = Window.partitionBy("part", "filter")
    alone = F.max(F.when(F.col("step") == len(failing), F.col("removed"))).over(all_orders)
    return found.select(
        "part", "filter_order", "step", "filter", (F.coalesce("clean", F.lit(0)) + F.col("kept")).alias("kept"), "removed", "redundant", alone.alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(all_orders).alias("shapley"),
    )


#: The same in DuckDB.
SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM split GROUP BY t),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, MAP {
           'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
           'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first_id < doc_id, false)} AS fails
  FROM split JOIN firsts USING (t) LEFT JOIN flags USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM d GROUP BY part, fails),
judged AS (
  SELECT part, filter_order, step, filter, n, good, bad, fails[filter] AS f, len(list_filter(before, lambda x: x <> '' AND fails[x])) = 0 AS alive,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 AS single
  FROM kinds, s),
counted AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN alive AND NOT f THEN n ELSE 0 END) AS kept, sum(CASE WHEN alive AND f THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f AND NOT alive THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f AND single THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN alive AND f THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN alive AND f THEN bad ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
