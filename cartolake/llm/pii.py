"""Personal data by a semi-Markov conditional random field.

Candidate segments are scored by features of the whole span: shape, digits, checksum, separators, what stands before and
after; two entities close to each other also score their kinds as a pair. A dynamic program over candidates chooses
boundaries and types jointly; everything else is a run of outside characters. Numbers are candidates from every start of a
digit group to every end of one, up to MAX_DIGITS digits (no card has more) in MAX_GROUPS groups; addresses of
any length, with the whole host and with what stands before its dots first change their kind. Weights maximise the conditional likelihood of segmentations that the base
patterns give on a sample, with variants of them that the patterns miss (a number without its plus sign or next to other
numbers, an address that spells out its at and dot), so that the field finds those too. Base spans stay: they take part in the
program as entities that are chosen already, whose kinds pair with those next to them; the field adds what it finds apart
from them. Spans are code points [start, end). All work is linear in the text, or nearly so.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, texts_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a failing start is not tried again inside the same run of characters.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
NEEDS = {"ip": ".", "phone": "+"}
#: Windows that the field is fitted on at most, by hash, and the longest of them: a bound of the fit alone.
TRAIN_WINDOWS, WINDOW_CHARS = 2000, 400
#: Code points around a window of the fit, and up to which two entities are a pair.
WINDOW, NEAR = 48, 16
#: The bounds of an entity: its digits, and the groups that they stand in.
MAX_DIGITS, MAX_GROUPS = 19, 10


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(span: str) -> str:
    return "".join(c for c in span if c in "0123456789")


def counts(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in span.split("."))
    digits = digits_of(span)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def local_start(text: str, at: int, least: int) -> int:
    """Where the run of characters of a local part that ends at `at` begins, not before least."""
    first = at
    while first > least:  # in steps, so that a long run costs its own length
        step = max(least, first - 64)
        run = LOCAL.fullmatch(text, step, first)
        if run:
            first = step
            continue
        while LOCAL.fullmatch(text, first - 1, first) and first > step:
            first -= 1
        break
    return first


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from one @ to the next."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = local_start(text, at, done)
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of the kind, start, end), by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)]
    for k, kind in enumerate(KINDS):
        if k and (kind not in NEEDS or NEEDS[kind] in text):
            found += [(k, m.start(), m.end()) for m in BASE[kind].finditer(text) if counts(kind, m.group())]
    return found


AT = re.compile(r"@|\x20?(?:\[at\]|\(at\))\x20?|\x20at\x20", re.I)
DOT = re.compile(r"\.|\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]++")
GROUP = re.compile(r"[0-9]++")
BETWEEN = re.compile(r"[\x20().\-/]{1,3}")
CUES = {0: ("mail", "contact", "write"), 1: ("ip", "address", "host"), 2: ("card", "visa", "payment"), 3: ("phone", "tel", "call", "fax", "mobile")}


def addresses(text: str) -> Iterator[tuple[int, int, int]]:
    if "@" not in text and not re.search(r"[\[(]at[\])]|dot", text, re.I):
        return
    done = 0
    for at in AT.finditer(text):
        if at.start() < done:  # a sign within the last host
            continue
        start, spot, labels, end, kinds = local_start(text, at.start(), done), at.end(), 0, 0, []
        if start == at.start():
            continue
        done = at.end()
        while label := LABEL.match(text, spot):
            labels, end = labels + 1, label.end()
            dot = DOT.match(text, end)
            if not dot:
                break
            spelled = dot.group() != "."
            if spelled not in kinds:
                if kinds:
                    yield start, end, 0  # the host may have ended where a sentence does
                kinds.append(spelled)
            spot = dot.end()
        if labels > 1:
            yield start, end, 0


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    groups = [m.span() for m in GROUP.finditer(text)]
    for i, (first, _) in enumerate(groups):
        digits = 0
        while first and text[first - 1] in "+(" and groups[i][0] - first < 2:
            first -= 1
        for j in range(i, min(i + MAX_GROUPS, len(groups))):
            a, b = groups[j]
            digits += b - a
            if digits > MAX_DIGITS or j > i and not BETWEEN.fullmatch(text, groups[j - 1][1], a):
                break
            if digits >= 13:
                yield groups[i][0], b, 2
            if 7 <= digits <= 15:
                yield first, b, 3
            if j == i + 3 and b - groups[i][0] == digits + 3 and text[groups[i][0] : b].count(".") == 3:
                yield groups[i][0], b, 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind): spans that could be entities, in the order of their ends."""
    return sorted({*addresses(text), *numbers(text)}, key=lambda x: (x[1], x[0], x[2]))


def features(text: str, start: int, end: int, kind: int) -> list[tuple]:
    """Names of the features that hold for the whole span."""
    span = text[start:end]
    digits = digits_of(span) if kind else ""
    before, after = text[start - 1 : start], text[end : end + 1]
    cue = text[max(0, start - 24) : start].lower()
    names: list[tuple] = [(kind,), (kind, "digits", len(digits) if kind >= 2 else 0), (kind, "left", before.isalnum() or before in "._-+@" and before != ""), (kind, "right", after.isalnum() or after == "@")]
    if any(c in cue for c in CUES[kind]):
        names.append((kind, "cue"))
    if kind == 0:
        low = span.lower()
        names += [(0, "sign", "@" in span), (0, "dot", "." in span.partition("@")[2]), (0, "spelled", "(at)" in low or "[at]" in low, " at " in low and " dot " in low), (0, "end", span[-1:].isalpha()), (0, "more", bool(DOT.match(text, end)) and bool(LABEL.match(text, DOT.match(text, end).end())))]
    elif kind == 1:
        names += [(1, "octets", counts("ip", span)), (1, "zero", any(len(x) > 1 and x[0] == "0" for x in span.split("."))), (1, "dots", before == "." or after == "." and text[end + 1 : end + 2].isdigit())]
    elif kind == 2:
        names += [(2, "luhn", luhn(digits)), (2, "even", len({len(x) for x in re.split(r"[\x20.-]", span)[:-1]}) <= 1), (2, "groups", min(len(re.split(r"[\x20.-]", span)), 6))]
    else:
        groups = re.split(r"[\x20().\-/]+", span)
        names += [(3, "plus", span[0] == "+"), (3, "paren", bool(re.search(r"\([0-9]{2,5}\)", span))), (3, "groups", min(len([g for g in groups if g]), 6)), (3, "last", len(groups[-1])), (3, "dots", span.count(".") == 3), (3, "luhn", len(digits) >= 16)]
    return names


class Field:
    """A semi-Markov field: entities score their features, close ones their pair of kinds too, outside costs nothing."""

    def __init__(self, weights: dict[tuple, float]) -> None:
        self.weights = weights
        self.pairs = [[weights.get(("pair", a, b), 0.0) for b in range(len(KINDS))] for a in range(len(KINDS))]

    def score(self, text: str, start: int, end: int, kind: int) -> float:
        return sum(self.weights.get(n, 0.0) for n in features(text, start, end, kind))

    def best(self, scored: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
        """Highest-scoring set of non-overlapping segments; scored is sorted by end.

        The best that ends with a candidate follows the best of all that ended further back, or one close before it.
        """
        ends, value, back = [c[1] for c in scored], [], []
        upto = [(0.0, -1)]  # the best of the first n candidates as the last one, with its number
        for n, (start, _, kind, s) in enumerate(scored):
            far = bisect.bisect_left(ends, start - NEAR, 0, n)
            most = upto[far]
            for p in range(far, bisect.bisect_right(ends, start, far, n)):
                most = max(most, (value[p] + self.pairs[scored[p][2]][kind], p))
            value.append(most[0] + s)
            back.append(most[1])
            upto.append(max(upto[-1], (value[n], n)))
        out, at = [], upto[-1][1]
        while at >= 0:
            out.append(scored[at][:3])
            at = back[at]
        return out[::-1]


def log_sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def log_sums(scored: list[tuple[int, int, int, float]], pairs: list[list[float]]) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """Posterior probability of each candidate and of each pair of kinds: forward and backward sums over all segmentations.
    scored is sorted by end."""
    n, ends = len(scored), [c[1] for c in scored]
    forward, upto, close = [], [0.0], []
    for i, (start, _, kind, s) in enumerate(scored):
        far = bisect.bisect_left(ends, start - NEAR, 0, i)
        near = range(far, bisect.bisect_right(ends, start, far, i))
        close += [(p, i) for p in near]
        forward.append(s + log_sum([upto[far], *(forward[p] + pairs[scored[p][2]][kind] for p in near)]))
        upto.append(log_sum([upto[-1], forward[i]]))
    by_start = sorted(range(n), key=lambda i: scored[i][0])
    starts = [scored[i][0] for i in by_start]
    backward, behind = [0.0] * n, [0.0] * (n + 1)  # behind[k]: everything that begins with by_start[k] or later, or nothing
    after: dict[int, list[int]] = {}
    for p, q in close:
        after.setdefault(p, []).append(q)
    for k in range(n - 1, -1, -1):
        i = by_start[k]
        far = bisect.bisect_right(starts, scored[i][1] + NEAR)
        backward[i] = log_sum([behind[far], *(pairs[scored[i][2]][scored[q][2]] + scored[q][3] + backward[q] for q in after.get(i, ()))])
        behind[k] = log_sum([behind[k + 1], scored[i][3] + backward[i]])
    whole, both = upto[-1], {}
    for p, q in close:
        key = scored[p][2], scored[q][2]
        both[key] = both.get(key, 0.0) + math.exp(min(0.0, forward[p] + pairs[key[0]][key[1]] + scored[q][3] + backward[q] - whole))
    return np.exp(np.minimum(np.array(forward) + np.array(backward) - whole, 0)), both


def variants(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The text itself, and with spans as the base patterns don't know them; (start, end, kind) each."""
    out = [(text, [(a, b, k) for k, a, b in spans])]
    for k, a, b in spans:
        span, left, right = text[a:b], text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
        changed = []
        if k == 3:
            changed = [("", span[1:], ""), ("", span, " 12"), ("24 ", span, ""), ("", span[1:], " 3")]
        if k == 2:
            digits = digits_of(span)
            changed = [("2024 ", digits, ""), ("", digits, " 12"), ("12 ", ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), ""), ("7 ", span, " 34")]
        if k == 0:
            user, _, host = span.partition("@")
            changed = [("", f"{user} [at] {host}", ""), ("", f"{user} (at) {host.replace('.', ' (dot) ')}", ""), ("", f"{user} at {host.replace('.', ' dot ')}", "")]
        out += [(left + x + c + y + right, [(len(left + x), len(left + x + c), k)]) for x, c, y in changed]
    return out


def fit(texts: list[str], rounds: int = 40, rate: float = 1.0, ridge: float = 0.01) -> Field:
    """Gradient steps on the conditional likelihood of the labelled texts."""
    data, known = [], {}  # known: number of each feature
    for a in range(len(KINDS)):
        for b in range(len(KINDS)):
            known["pair", a, b] = len(known)
    for text in texts:
        for t, spans in variants(text, base_spans(text)):
            truth, found = set(spans), candidates(t)
            if found:
                chosen = sorted(x for x in found if x in truth)
                close = [(p[2], q[2]) for p, q in zip(chosen, chosen[1:]) if q[0] - p[1] <= NEAR]
                data.append(([(s, e, k, np.array([known.setdefault(n, len(known)) for n in features(t, s, e, k)]), (s, e, k) in truth) for s, e, k in found], close))
    w, met = np.zeros(len(known)), np.full(len(known), 1e-6)  # met: squares of the gradients so far, which shorten the steps
    for _ in range(rounds):
        gradient, n = -ridge * w, max(len(data), 1)
        pairs = w[: len(KINDS) ** 2].reshape(len(KINDS), -1).tolist()
        for rows, close in data:
            likely, both = log_sums([(s, e, k, float(w[f].sum())) for s, e, k, f, _ in rows], pairs)
            for p, (_, _, _, f, true) in zip(likely, rows, strict=True):
                gradient[f] += (true - p) / math.sqrt(n)
            for a, b in close:
                gradient[known["pair", a, b]] += 1 / math.sqrt(n)
            for (a, b), p in both.items():
                gradient[known["pair", a, b]] -= p / math.sqrt(n)
        met += gradient**2
        w += rate * gradient / np.sqrt(met)
    return Field({n: float(w[i]) for n, i in known.items()})


#: What an entity must score beyond the outside to be added, and what a base span scores: it is chosen already.
MARGIN, CHOSEN = 1.0, 1e6


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the field's entities that don't touch a base span, chosen together with those.

    A candidate that can't gain even with the best pairs on both sides is left out of the program.
    """
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    pairs = [x for row in field.pairs for x in row]
    help_ = 2 * max(0.0, *pairs) - min(0.0, *pairs)
    scored = [(s, e, k, CHOSEN) for k, s, e in base]
    for s, e, k in candidates(text):
        n = bisect.bisect_left(starts, e)  # base spans that begin before its end
        if not n or reach[n - 1] <= s:
            value = field.score(text, s, e, k) - MARGIN
            if value + help_ > 0:
                scored.append((s, e, k, value))
    known = {(s, e, k) for k, s, e in base}
    return [(k, s, e) for s, e, k in field.best(sorted(scored, key=lambda x: (x[1], x[0], x[2]))) if (s, e, k) not in known]


def windows(text: str) -> list[str]:
    """The text around its candidates, for the fit."""
    found: list[list[int]] = []
    for s, e, _ in sorted(candidates(text)):
        a, b = max(0, s - WINDOW), min(len(text), e + WINDOW)
        if found and a <= found[-1][1]:
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b])
    return [text[a:b] for a, b in found if b - a <= WINDOW_CHARS]


def train(docs: DataFrame, train_windows: int = TRAIN_WINDOWS) -> Field:
    """The field from a hashed sample of the windows of a hashed sample of rows, train_windows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for (text,) in texts_of([batch], "text") for w in windows(text or "")]
            hashes = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.string())], ["h", "w"])

    hit = docs.where(F.rlike("text", F.lit(r"@|[0-9]"))).select(F.xxhash64("text").alias("row_hash"), "text")
    rows = hit.where(hash_share(F.col("row_hash"), 16 * train_windows, docs.count())).select("text").mapInArrow(run, "h long, w string")
    return fit([r["w"] for r in rows.distinct().orderBy("h", "w").limit(train_windows).collect()])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs (doc_id, text).

    The counts and the digest are of base spans; spans lists all. A null text counts as empty and has none. Equal texts
    get equal spans; an empty table gives no rows; other columns are dropped, whatever their names. A text may be of any
    length and is met whole, in time that grows as its length does. Of overlapping candidates with equal scores the later
    one in the order of (end, start, kind) is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs).weights)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in texts_of([batch], "doc_id", "text"):
                text = text or ""
                base = base_spans(text)
                spans = sorted([*base, *added_spans(text, base, field)])
                rows.append((doc_id, *(sum(k == x for k, _, _ in base) for x in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
