"""Quality rules as a short-circuit cascade, in Spark SQL expressions only.

Each rule is a predicate over measures of a text. On a sample the operator estimates what each rule costs and what it
rejects, orders the rules by rejection per cost, and evaluates them as one CASE: a row that an early rule rejects never
reaches the dearer measures behind later rules. The order changes the work, never the verdict.

The order is greedy: each next rule is the one that rejects most per cost among the rows that the rules before it kept. A
cost is the work on the sample's texts, their characters, words and lines times the unit costs of the measures that a rule
needs and no rule before it has paid for. So the same rows give the same order, whatever the machine is busy with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, hash_share

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
#: Rows of the sample for costs and selectivities; a bound of the estimate, not of the data that are judged.
SAMPLE_ROWS = 2000


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def repeated_words(words: Column, window: int = WINDOW_WORDS) -> Column:
    """How many words lie in a window of `window` words that occurs twice or more in the array.

    Windows are compared by 64-bit hash. Most texts repeat none, which array_distinct shows in one pass; for the rest
    the (hash, position) pairs are sorted, so that equal windows are neighbours, and the positions' union is measured.
    """
    each = F.transform(words, lambda x: F.xxhash64(x))
    hashes = bind(each, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window)))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        twin = lambda s, x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])
        at = bind(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: twin(s, x, i)), lambda x: x["at"])))
        reach = bind(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= window, none).otherwise(bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def stutters(words: Column) -> Column:
    """Words equal to the word before them."""
    twins = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, y: x == y)
    return F.size(F.filter(twins, lambda x: F.coalesce(x, F.lit(False)))).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return bind(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


LINES = "\n"
#: Each measure: whether it needs the words, its unit costs (nanoseconds a character and a word), its Column from text and words.
MEASURES: dict[str, tuple[bool, float, float, Callable[[Column, Column], Column]]] = {
    "n_words": (True, 0, 0, lambda t, w: F.size(w)),
    "word_chars": (True, 1, 10, lambda t, w: F.length(F.array_join(w, ""))),
    "n_symbols": (False, 12, 0, lambda t, w: F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
    "n_dup_lines": (False, 10, 0, lambda t, w: dup_lines(t)),
    "n_repeat_words": (True, 0, 1500, lambda t, w: repeated_words(w)),
    "n_lines": (False, 2, 0, lambda t, w: F.size(F.split(t, LINES))),
    "n_shouts": (False, 12, 0, lambda t, w: F.length(t) - F.length(F.translate(t, "!?", ""))),
    "n_upper": (False, 30, 0, lambda t, w: F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))),
    "n_stutters": (True, 0, 250, lambda t, w: stutters(w)),
}
#: Of the split into words, a character.
SPLIT_COST = 15
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_of() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def measure(name: str, words: Column | None) -> Column:
    return MEASURES[name][3](text_of(), words).cast("long")


@dataclass(frozen=True)
class Rule:
    """rejects, over Columns of the measures in needs (in this order), is true where the text fails."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]

    @property
    def on_words(self) -> bool:
        return any(MEASURES[m][0] for m in self.needs)


def default_rules() -> list[Rule]:
    return [
        Rule("few_words", ("n_words",), lambda n: n < 20),
        Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
        Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > 3 * n),
        Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
        Rule("stutters", ("n_stutters", "n_words"), lambda s, n: 2 * s > n),
        Rule("shouting", ("n_shouts", "n_words", "n_upper", "word_chars"), lambda s, n, u, c: (4 * s > n) & (2 * u > c)),
        Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c > 15 * n) | (c < 2 * n)),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by rejection per cost among the rows still there, estimated on a hashed sample of about sample_rows rows.

    Rules that reject nothing more come last, the cheaper ones first. One job, whose result has a row for each set of
    rules that reject together.
    """
    picked = docs.where(hash_share(F.xxhash64("text", "doc_id"), sample_rows, docs.count())).select("text")
    hits = bind(words_of(text_of()), lambda w: F.struct(F.array(*(r.rejects(*(measure(m, w) for m in r.needs)) for r in rules)).alias("hits"), F.size(w).alias("words")))
    found = picked.select(F.length(text_of()).alias("chars"), hits.alias("h")).groupBy("h.hits").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("h.words").alias("words")).collect()
    chars, words = sum(r["chars"] for r in found), sum(r["words"] for r in found)
    left, out, paid, alive = list(range(len(rules))), [], set(), [(r["hits"], r["n"]) for r in found]

    def cost(k: int) -> float:
        own = sum(MEASURES[m][1] * chars + MEASURES[m][2] * words for m in rules[k].needs if m not in paid)
        return own + (SPLIT_COST * chars if rules[k].on_words and "words" not in paid else 0) + 1

    while left:
        best = min(left, key=lambda k: (-sum(n for hits, n in alive if hits[k]) / cost(k), cost(k), rules[k].name))
        out.append(rules[best])
        left.remove(best)
        paid.update(["words"] if rules[best].on_words else [])
        alive = [(hits, n) for hits, n in alive if not hits[best]]
    return out


def cascade(ordered: list[Rule], known: dict[str, Column] | None = None) -> Column:
    """The name of the first rule that rejects, or null. known: measures that are there already.

    Rules before the first one that needs the words are met before the text is split.
    """
    known = known or {}
    needs_words = lambda r: any(MEASURES[m][0] and m not in known for m in r.needs)
    first = next((k for k, r in enumerate(ordered) if needs_words(r)), len(ordered))

    def chain(rules: list[Rule], words: Column | None, rest: Column) -> Column:
        for r in reversed(rules):
            rest = F.when(r.rejects(*(known[m] if m in known else measure(m, words) for m in r.needs)), F.lit(r.name)).otherwise(rest)
        return rest

    none = F.lit(None).cast("string")
    later = bind(words_of(text_of()), lambda w: chain(ordered[first:], w, none)) if first < len(ordered) else none
    return chain(ordered[:first], None, later)


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (doc_id, text, any others) with rejected_by (first rule of the cascade that rejects, or null) and kept.

    rejected_by depends on the order that the sample gave, kept does not. A null text has no words and fails `few_words`;
    a text of any length is met whole; equal rows get equal verdicts; an empty table gives no rows. The columns rejected_by
    and kept replace columns of these names in docs; every other column stays.
    """
    ordered = order_rules(docs, rules or default_rules(), sample_rows)
    return docs.withColumn("rejected_by", cascade(ordered)).withColumn("kept", F.col("rejected_by").isNull())


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's measures, base_failed and kept for every row; the cascade takes from the contract's measures
    what it needs and computes the others only where it comes to them."""
    ordered = order_rules(docs, default_rules())
    m = bind(words_of(text_of()), lambda w: F.struct(*(measure(c, w).alias(c) for c in CONTRACT)))
    found = docs.select("doc_id", "text", m.alias("m"))
    known = {c: F.col("m")[c] for c in CONTRACT}
    failed = (known["n_words"] < 20) | (100 * known["n_repeat_words"] > 30 * known["n_words"])
    return found.select("doc_id", *(known[c].alias(c) for c in CONTRACT), failed.alias("base_failed"), cascade(ordered, known).isNull().alias("kept"))


#: The same in DuckDB.
SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
measured AS (
  SELECT doc_id, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(string_split(t, chr(10))) AS n_lines,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shouts,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM words),
windows AS (
  SELECT doc_id, i, hash(w[i:i+7]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM measured WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
m AS (SELECT measured.* EXCLUDE (w), coalesce(covered.n, 0) AS n_repeat_words FROM measured LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_stutters > n_words
            OR (2 * n_upper > word_chars AND 4 * n_shouts > n_words) OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""
