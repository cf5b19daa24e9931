"""Language-model scores by online logistic context mixing.

Binary decisions. A token is coded on a Huffman tree over the most frequent training words, an escape and the end of the
text; after an escape the word is spelled, byte by byte, 8 bits each. Every decision is one bit.

Predictors. Hashed contexts across words (the node alone, the word before, the two words before, the last very
frequent word) give the log-odds of the next bit from counts over all training text; a fifth
predictor follows the word that came next when the last two words stood in the same text before.

Mixing. A mixer with weights gated by the state of that match adds the log-odds up, and an adaptive map refines the
result by the depth in the tree. Both start from fixed, even values and learn on from token to token, over stretches of
STRETCH tokens of a text; contexts and matches go on over the whole text.

A word outside the tree is spelled by bit predictors with contexts inside the word. That costs the same wherever the word
stands, so it runs once per distinct word through the distinct-word shuffle (see worddict), which also brings each word's
own training count: seen words get count / total and escape to the spelling by Witten and Bell.

Nothing is fitted on a sample. Counts, and how often a match foretells a word off the tree, cover all training text; the
weights of the spelling and its map are fitted on all distinct training words off the tree, each taken out of the tables
first. Tables have a size that follows the training text up to a bound; beyond, contexts share slots. Nothing depends on
how rows are dealt out to tasks: what tasks add up are whole numbers.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, materialize, steady, texts_of
from .worddict import batched, by_bucket, by_text, expand, from_planes, partitions, release, rows_of, squeeze, texts_from_blocks, to_blocks, to_planes

#: Words on the tree at most, and how often training has one at least.
TREE_WORDS, TREE_COUNT = 1 << 12, 3
#: Slots of each context's table at most, as powers of two: node, word, two words, last frequent word.
TREE_SLOTS = (13, 20, 21, 19)
#: The words that count as very frequent: the first so many of the tree.
FREQUENT = 64
#: Slots of the spelling's tables: orders 0 to 3 and the whole beginning.
SPELL_SLOTS = (14, 18, 20, 20, 21)
STRETCH = 1024
RATE = 0.06
MAP_RATE = 0.03
INPUTS = len(TREE_SLOTS) + 2
GATES = 5
DEPTHS, MAP_STEPS = 6, 25
#: The spelling's: gates by place in the word, words side by side, stems at once, steps of its map, weight of every input before the fit.
SPELL_GATES, LANES, STEMS, SPELL_STEPS, SPELL_WEIGHT = 12, 20_000, 20_000, 33, 0.3
#: Parts of one that inputs and probabilities are rounded to, where tasks add them up.
INPUT_PARTS, P_PARTS = 16, 1 << 16
#: Slots of one row of partial counts, tokens that one task counts at least where there are enough tasks.
PART, TASK_TOKENS = 1 << 18, 40_000_000
#: Tokens of texts that are met at once, and of those that are expanded to bits at once.
CHUNK, SOME = 100_000, 8_000
ODD = np.uint64(0x9E3779B97F4A7C15)
END, ESCAPE = 0, 1
#: What is known of a distinct word: training count, ln of its spelling, symbol on the tree, hash, bytes.
WORD = np.dtype([("count", "<i8"), ("spelled", "<f4"), ("symbol", "<i4"), ("hash", "<u4"), ("size", "<u4")])


def words_of(text: str | None) -> list[bytes]:
    return encoded(text).lower().split()


# Counts as one byte each: exact below 128, then four steps an octave.


def to_byte(n: np.ndarray) -> np.ndarray:
    return np.where(n < 128, n, np.minimum(128 + np.rint(4 * np.log2(np.maximum(n, 1) / 128)), 255)).astype(np.uint8)


FROM_BYTE = np.where(np.arange(256) < 128, np.arange(256), 128 * 2.0 ** ((np.arange(256) - 128) / 4))


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


#: Log-odds of a pair of bytes (zeros low, ones high), in 1/15 as one signed byte: |log-odds| of 8 and more are the same.
STRETCHED = np.rint(np.clip(stretch(FROM_BYTE[None, :], FROM_BYTE[:, None]), -8, 8) * 15).astype(np.int8).ravel()
#: Log-odds of a pair of bytes; the same without one occurrence of a zero, or of a one.
ODDS = stretch(FROM_BYTE[None, :], FROM_BYTE[:, None]).ravel()
ODDS_WITHOUT = np.concatenate([stretch(np.maximum(FROM_BYTE[None, :] - 1, 0), FROM_BYTE[:, None]).ravel(), stretch(FROM_BYTE[None, :], np.maximum(FROM_BYTE[:, None] - 1, 0)).ravel()])


def pack_array(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


# The tree


@dataclass(frozen=True)
class Tree:
    """symbols: number of each word; path of symbol s: nodes and bits from first[s] to first[s + 1]."""

    symbols: dict[bytes, int]
    first: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    #: Training tokens and distinct words that are not on the tree.
    rest_tokens: int
    rest_words: int


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, nodes, bits) of a prefix code; nodes are numbered from the root on by falling weight."""
    floor = max(1, sum(weights) >> 22)  # bounds the depth
    heap = [(max(w, floor), s) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    number = len(weights)
    while len(heap) > 1:
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[number] = (a, b)
        heapq.heappush(heap, (wa + wb, number))
        number += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in weights]
    stack: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][1], [])]
    while stack:
        at, path = stack.pop()
        if at < len(weights):
            paths[at] = path
        else:
            for bit, child in enumerate(children[at]):
                stack.append((child, [*path, (number - 1 - at, bit)]))
    first = np.cumsum([0, *map(len, paths)])
    flat = [x for p in paths for x in p]
    return first, np.array([n for n, _ in flat], np.int64), np.array([b for _, b in flat], np.uint8)


def make_tree(top: list[tuple[bytes, int]], ends: int, tokens: int, words: int) -> Tree:
    """top: words with their training counts, most frequent first; tokens and words: of training, without the ends."""
    kept = sum(c for _, c in top)
    first, nodes, bits = huffman([ends + 1, tokens - kept + 1, *(c + 1 for _, c in top)])
    return Tree({w: k + 2 for k, (w, _) in enumerate(top)}, first, nodes, bits, tokens - kept, words - len(top))


def known_words(words: list[bytes], tree: Tree) -> np.ndarray:
    """symbol and hash of each word."""
    out = np.empty((len(words), 2), np.int64)
    out[:, 0] = np.fromiter(map(tree.symbols.get, words, repeat(ESCAPE)), np.int64, len(words))
    out[:, 1] = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return out


class Texts:
    """Tokens of some texts, each with its end, as arrays in the texts' order: symbols, contexts, matches."""

    def __init__(self, lengths: np.ndarray, symbols: np.ndarray, hashes: np.ndarray) -> None:
        """lengths: words of each text, without the end."""
        n = int(lengths.sum()) + len(lengths)
        self.lengths = lengths + 1
        self.text = np.repeat(np.arange(len(lengths)), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(n) - self.starts[self.text]
        inner = np.ones(n, bool)
        inner[self.starts + lengths] = False
        self.symbols, h = np.full(n, END, np.int64), np.zeros(n, np.uint64)
        self.symbols[inner], h[inner] = symbols, hashes.astype(np.uint64) + np.uint64(1)

        one, two = self.before(h, 1), self.before(h, 2)
        pair = (two * ODD) ^ (one + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
        often = np.where((self.symbols > ESCAPE) & (self.symbols < FREQUENT + 2), np.arange(n), -1)
        last = np.maximum.accumulate(np.where(often >= 0, often, -1))
        last = self.before(last + 1, 1) - 1
        frequent = np.where(last >= self.starts[self.text], self.symbols[last], 0).astype(np.uint64)
        self.contexts = [np.zeros(n, np.uint64), one, pair, frequent]
        self.hash, self.pair = h, pair

    def before(self, x: np.ndarray, k: int) -> np.ndarray:
        """x of the token k places before in the same text, or 0."""
        out = np.zeros_like(x)
        out[k:] = x[:-k]
        out[self.at < k] = 0
        return out

    def match(self) -> None:
        """twin: where the last two words stood before in this text; right: it foretells the word; gate: for how many
        tokens it has been right so far, from 1 on, or 0 without one."""
        n, h = len(self.hash), self.hash
        key = self.pair * ODD + self.text.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
        self.twin = np.full(n, -1)
        self.twin[order[same + 1]] = order[same]
        self.twin[self.at < 2] = -1
        self.right = (self.twin >= 0) & (h[self.twin] == h)
        wrong = np.maximum.accumulate(np.where(self.right, -1, np.arange(n)))  # the last token that was not foretold
        held = self.before(np.arange(n) - wrong, 1)
        self.gate = np.where(self.twin < 0, 0, 1 + np.minimum(held, GATES - 2))


def bits_of(texts: Texts, tree: Tree, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner: place in tokens, depth, node, bit) of every decision of these tokens, in order."""
    return path_of(tree, texts.symbols[tokens])


def path_of(tree: Tree, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner: place in s, depth, node, bit) of every decision of these symbols, in order."""
    size = tree.first[s + 1] - tree.first[s]
    owner = np.repeat(np.arange(len(s)), size)
    ends = np.cumsum(size)
    depth = np.arange(len(owner)) - (ends - size)[owner]
    at = tree.first[s][owner] + depth
    return owner, depth, tree.nodes[at], tree.bits[at]


def slots_of(k: int, size: int, context: np.ndarray, owner: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slots of context k for each decision; the first context is the node itself."""
    if k == 0:
        return node
    mixed = (context * ODD)[owner]
    mixed += node.view(np.uint64)
    mixed *= np.uint64(0xD6E8FEB86659FD93 + 2 * k)
    mixed >>= np.uint64(64 - size)
    return mixed.view(np.int64)


def foretold(texts: Texts, tree: Tree, tokens: np.ndarray, owner: np.ndarray, depth: np.ndarray, node: np.ndarray) -> np.ndarray:
    """1 or -1: the bit that the matched word would take here; 0 without one, or off its path."""
    twin = texts.twin[tokens]
    guess = np.where(twin >= 0, texts.symbols[twin], -1)[owner]
    at = np.where(guess >= 0, tree.first[guess] + depth, 0)
    fits = (guess >= 0) & (at < tree.first[guess + 1])
    at = np.where(fits, at, 0)
    fits &= tree.nodes[at] == node
    return np.where(fits, 2 * tree.bits[at].astype(np.int8) - 1, 0).astype(np.int8)


@dataclass
class Start:
    """Where every stretch begins: weights by gate, refining log-odds by depth and step, P(same word) by gate."""

    weights: np.ndarray
    refined: np.ndarray
    same: np.ndarray


def first_start() -> Start:
    weights = np.full((GATES, INPUTS), 0.25, np.float32)
    weights[:, -1] = 0
    centers = logistic((np.arange(MAP_STEPS) - MAP_STEPS // 2) * np.float32(16 / (MAP_STEPS - 1)))
    return Start(weights, np.tile(centers, (DEPTHS, 1)).astype(np.float32), np.full(GATES, 0.5))


def mix(texts: Texts, tree: Tree, votes, start: Start) -> np.ndarray:
    """ln of the probability of each token's decisions. votes(tokens, owner, depth, node) gives the tables' log-odds in
    1/15, a column for each.

    A lane is a stretch of a text. Lanes go side by side, token by token; after each, weights and map take a step."""
    n = len(texts.symbols)
    out = np.zeros(n)
    lane_of = texts.at // STRETCH
    step_of_token = texts.at - lane_of * STRETCH
    lane = np.cumsum(step_of_token == 0) - 1
    lanes = int(lane[-1]) + 1 if n else 0
    weights = np.tile(start.weights, (lanes, 1))  # lane x gate, inputs
    refined = np.tile(start.refined.ravel(), lanes)  # lane x depth x step
    order = np.argsort(step_of_token.astype(np.int16), kind="stable")
    steps = np.searchsorted(step_of_token[order], np.arange(STRETCH + 1))
    at, half, scale = 0, np.float32(MAP_STEPS // 2 + 0.5), np.float32((MAP_STEPS - 1) / 16)
    while at < STRETCH and steps[at] < n:
        upto = max(at + 1, int(np.searchsorted(steps, steps[at] + SOME, side="right")) - 1)
        tokens = order[steps[at] : steps[upto]]
        owner, depth, node, bit = bits_of(texts, tree, tokens)
        x = np.empty((INPUTS, len(owner)), np.float32)
        x[:-2] = votes(tokens, owner, depth, node).T
        x[-2] = foretold(texts, tree, tokens, owner, depth, node) * np.int8(60)
        x[-1] = 5
        x *= np.float32(1 / 15)
        first = np.searchsorted(owner, np.arange(len(tokens) + 1))
        band = (lane[tokens] * DEPTHS * MAP_STEPS)[owner] + np.minimum(depth, DEPTHS - 1) * MAP_STEPS
        gates, ones = lane[tokens] * GATES + texts.gate[tokens], bit.astype(np.float32)
        p_one = np.empty(len(owner), np.float32)
        for k in range(at, upto):
            a, b = steps[k] - steps[at], steps[k + 1] - steps[at]
            if a == b:
                break
            lo, hi = first[a], first[b]
            rows, one, y = gates[a:b], x[:, lo:hi], ones[lo:hi]
            w = weights[rows]
            own = np.ascontiguousarray(w.T).take(owner[lo:hi] - a, axis=1)
            own *= one
            odds = own[0] + own[1]
            for votes_of_one in own[2:]:  # in their order, so that a lane's odds are the same beside any others
                odds += votes_of_one
            np.maximum(odds, np.float32(-8), out=odds)
            np.minimum(odds, np.float32(8), out=odds)
            p = logistic(odds)
            odds *= scale
            odds += half
            cell = odds.astype(np.int64)
            cell += band[lo:hi]
            fine = refined.take(cell)
            np.add(p, fine, out=p_one[lo:hi])
            np.subtract(y, p, out=p)
            one *= p
            weights[rows] = w + np.float32(RATE) * np.add.reduceat(one, first[a:b] - lo, axis=1).T
            refined[cell] = fine + np.float32(MAP_RATE) * (y - fine)
        p_one *= np.float32(0.5)
        p_bit = np.where(bit > 0, p_one, 1 - p_one).astype(np.float64)
        out[tokens] = np.add.reduceat(np.log(p_bit), first[:-1])
        at = upto
    return out


def matched(texts: Texts) -> np.ndarray:
    """By gate: words off the tree that a match foretold rightly, and those that it foretold."""
    texts.match()
    escaped = (texts.symbols == ESCAPE) & (texts.twin >= 0)
    escaped &= texts.symbols[texts.twin] == ESCAPE
    return np.stack([np.bincount(texts.gate[m], minlength=GATES) for m in (escaped & texts.right, escaped)])


# The spelling of a word


def stems(words: list[bytes], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bits of words side by side, some of one byte at a time: (alive words, edges, words of each stem, slots of each predictor,
    bit, gate). The stems of one bit lie between two edges.

    A stem is a run of alive words that are the same up to and with this bit. Slots and bit are the same for all of them, so
    they are given once a stem; in sorted words a run is all words with that beginning. Longer words live longer."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer(b"".join(w + b"\x20" for w in words), np.uint8)
    starts = np.cumsum(size) - size
    odd = [np.uint64(0xD6E8FEB86659FD93 + 2 * k) for k in range(len(sizes))]
    alive, group, at = np.arange(len(words)), np.zeros(len(words), np.int64), 0  # group: the run by the bytes before
    o1, o2, o3, whole = (np.zeros(1, np.uint64) for _ in range(4))
    while len(alive):
        byte = flat[starts[alive] + at]
        mixed = [c * ODD * m for c, m in zip((np.full(len(o1), min(at, 3), np.uint64), o1, o2, o3, whole), odd, strict=True)]
        differs = np.append(np.uint8(255), byte[1:] ^ byte[:-1])
        differs[1:][group[1:] != group[:-1]] = 255
        runs: list[np.ndarray] = []
        for bit_at in range(8):
            runs.append(np.flatnonzero(differs >= 1 << (7 - bit_at)))
            if bit_at < 7 and sum(map(len, runs)) < STEMS:
                continue
            first, lengths = np.concatenate(runs), [len(x) for x in runs]
            shift = np.repeat(np.arange(7 - bit_at + len(runs) - 1, 6 - bit_at, -1).astype(np.uint64), lengths)
            lead, own = byte[first].astype(np.uint64) | np.uint64(256), group[first]
            lead >>= shift
            bit = lead & np.uint64(1)
            lead >>= np.uint64(1)  # the node: the bits before, after a one
            slots = np.empty((len(sizes), len(first)), np.uint64)
            for k, m in enumerate(odd):
                np.multiply(lead, m, out=slots[k])
                slots[k] += mixed[k].take(own)
                slots[k] >>= np.uint64(64 - sizes[k])
            times = np.concatenate([np.diff(x, append=len(alive)) for x in runs])
            yield alive, np.cumsum([0, *lengths]), times, slots.view(np.int64), bit.view(np.int64), min(at, SPELL_GATES - 1)
            runs = []
        stay = np.flatnonzero(size[alive] > at + 1)
        now = np.cumsum(differs > 0)[stay]
        begins = np.append(True, now[1:] != now[:-1])[: len(now)]
        before, last = group[stay[begins]], byte[stay[begins]].astype(np.uint64)
        o1, o2, o3, whole = o1[before], o2[before], o3[before], whole[before]
        o3, o2, o1 = (o2 << np.uint64(8)) | last | np.uint64(1 << 32), (o1 << np.uint64(8)) | last | np.uint64(1 << 24), last + np.uint64(1)
        whole = (whole + last + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
        alive, group, at = alive[stay], np.cumsum(begins) - 1, at + 1


def lanes(words: list[bytes], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """stems, bit by bit and word by word: (alive words, slots of each predictor, bit, gate)."""
    for alive, edges, times, slots, bit, gate in stems(words, sizes):
        for a, b in pairwise(edges):
            yield alive, np.repeat(slots[:, a:b], times[a:b], axis=1), np.repeat(bit[a:b], times[a:b]), np.full(len(alive), gate)


def spell_inputs(tables: list[np.ndarray], slots: np.ndarray, bit: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of each predictor. With bit, one occurrence of that bit is taken out first."""
    out = np.empty((len(tables) + 1, slots.shape[1]))
    for k, table in enumerate(tables):
        pair = table.take(slots[k])
        out[k] = ODDS.take(pair) if bit is None else ODDS_WITHOUT.take(pair + (bit << 16))
    out[-1] = 0.3
    return out


def spell_step(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((odds + 8) * (SPELL_STEPS - 1) / 16), 0, SPELL_STEPS - 1).astype(np.int64)


def first_weights() -> np.ndarray:
    return np.full((SPELL_GATES, len(SPELL_SLOTS) + 1), SPELL_WEIGHT)


def spell_odds(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weighted sum of the inputs, added up in their order."""
    odds = weights[0] * x[0]
    for w, own in zip(weights[1:], x[1:], strict=True):
        odds += w * own
    return np.clip(odds, -12, 12)


def slopes(tables: list[np.ndarray], words: list[bytes], sizes: tuple[int, ...]) -> np.ndarray:
    """By gate, in whole numbers: slope and curvature of the words' likelihood at first_weights, each word taken out of the tables."""
    start, n = first_weights(), len(tables) + 1
    out = np.zeros((SPELL_GATES, n, n + 1), np.int64)
    for _, _, times, slots, bit, g in stems(words, sizes):
        x = spell_inputs(tables, slots, bit)
        p = logistic(spell_odds(start[g], x))
        x = np.rint(x * INPUT_PARTS)
        sides = np.concatenate([x * (np.rint(p * (1 - p) * P_PARTS) * times), (np.rint((bit - p) * P_PARTS) * times)[None]])
        out[g] += np.rint(x @ sides.T).astype(np.int64)  # below 2^53, so exact in any order
    return out


def moved_weights(sums: np.ndarray) -> np.ndarray:
    """first_weights, one step of Newton on; sums as slopes gives them."""
    weights, n = first_weights(), sums.shape[1]
    for g, own in enumerate(sums):
        curve = own[:, :n].astype(float) / (INPUT_PARTS**2 * P_PARTS) + np.eye(n)
        weights[g] += np.linalg.solve(curve, own[:, n].astype(float) / (INPUT_PARTS * P_PARTS))
    return weights


def steps_seen(tables: list[np.ndarray], words: list[bytes], sizes: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
    """How often each bit came at each gate and step of the mixed log-odds, each word taken out of the tables."""
    out = np.zeros((2, SPELL_GATES, SPELL_STEPS), np.int64)
    for _, _, times, slots, bit, g in stems(words, sizes):
        cell = bit * SPELL_STEPS + spell_step(spell_odds(weights[g], spell_inputs(tables, slots, bit)))
        out[:, g] += np.bincount(cell, times, 2 * SPELL_STEPS).astype(np.int64).reshape(2, SPELL_STEPS)
    return out


def refining_of(seen: np.ndarray) -> np.ndarray:
    """Refining log-odds by gate and step; seen as steps_seen gives it."""
    pseudo = 20 * logistic(np.linspace(-8, 8, SPELL_STEPS))
    return np.log((seen[1] + pseudo) / (seen[0] + 20 - pseudo))


@dataclass(frozen=True)
class Model:
    """shared: a broadcast of the tables (pairs of bytes), compressed, of bounded size: the tree's, then the spelling's."""

    shared: object
    tree: Tree
    start: Start
    tree_sizes: tuple[int, ...]
    spell_sizes: tuple[int, ...]
    spell_weights: np.ndarray
    spell_refined: np.ndarray

    def spelled(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """ln of each word's probability after an escape."""
        tables, bits = opened(self.shared.value)[1], np.zeros(len(words))
        refined = logistic(self.spell_refined)
        for first in range(0, len(words), LANES):
            some = words[first : first + LANES]
            total = np.zeros(len(some))
            for at, edges, times, slots, bit, gate in stems(some, self.spell_sizes):
                mixed = spell_odds(self.spell_weights[gate], spell_inputs(tables, slots))
                p = 0.5 * logistic(mixed) + 0.5 * refined[gate][spell_step(mixed)]
                ln, so_far = np.log(np.where(bit == 1, p, 1 - p)), total[at]
                for a, b in pairwise(edges):  # bit by bit, so that a word's sum is the same beside any others
                    so_far += np.repeat(ln[a:b], times[a:b])
                total[at] = so_far
            bits[first : first + len(some)] = total
        tree = self.tree
        whole = max(tree.rest_tokens + tree.rest_words, 1)
        unseen = tree.rest_words / whole if tree.rest_tokens else 1.0
        with np.errstate(divide="ignore"):  # a sum of logarithms: the spelling of a very long word has no float of its own
            return np.logaddexp(np.log(counts / whole), math.log(unseen) + bits)

    def score(self, texts: Texts, spelled: np.ndarray) -> np.ndarray:
        """log10 of each text's probability. spelled: ln of the spelling of each token (0 for the ends)."""
        tables, tree, start = opened(self.shared.value)[0], self.tree, self.start
        texts.match()

        def votes(tokens, owner, depth, node):
            out = np.empty((len(tables), len(owner)), np.int8)
            for k, table in enumerate(tables):
                table.take(slots_of(k, self.tree_sizes[k], texts.contexts[k][tokens], owner, node), out=out[k], mode="clip")
            return out.T

        each = mix(texts, tree, votes, start)
        escaped = texts.symbols == ESCAPE
        twin = escaped & (texts.twin >= 0) & (texts.symbols[texts.twin] == ESCAPE)
        same = start.same[texts.gate]
        each += np.where(escaped, np.where(twin, np.where(texts.right, np.log(same), np.log1p(-same) + spelled), spelled), 0)
        return np.add.reduceat(each, texts.starts) / math.log(10) if len(texts.starts) else np.zeros(0)


@lru_cache(1)
def opened(packed: tuple[tuple[bytes, ...], tuple[bytes, ...]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(log-odds of the tree's tables in 1/15, the spelling's pairs), from their compressed form, once for a worker."""
    return [STRETCHED[expand(t)] for t in packed[0]], [expand(t) for t in packed[1]]


# Over tables


def word_totals(blocks: DataFrame) -> DataFrame:
    """n (bucket), payload (words, training counts): each distinct word once, by bucket, in rows of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Counter] = {}
        for _, n, payload in rows_of(batches):
            _, words, counts = expand(payload)
            own = totals.setdefault(n, Counter())
            for w, c in zip(words, from_planes(counts).tolist(), strict=True):
                own[w] += c

        def rows() -> Iterator[tuple[int, int, bytes]]:
            for n, own in sorted(totals.items()):
                words = sorted(own)
                for k in range(0, len(words), LANES):
                    some = words[k : k + LANES]
                    yield 0, n, squeeze((some, np.array([own[w] for w in some], np.int64)))

        yield from batched(rows())
        totals.clear()
        release()

    return by_bucket(blocks.where("n >= 0")).mapInArrow(run, blocks.schema)


def words_in(totals: DataFrame, pick, schema: str, names: list[str], kinds: list) -> DataFrame:
    """Rows (lists by column) that pick(words, counts) gives for each row of totals; only words of training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, payload in rows_of(batches):
            words, counts = expand(payload)
            kept = np.flatnonzero(counts)
            columns = pick([words[i] for i in kept], counts[kept])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return totals.mapInArrow(run, schema)


def top_words(totals: DataFrame) -> list[tuple[bytes, int]]:
    """The tree's words, by count and then by their bytes: TREE_WORDS at most come to the driver."""

    def pick(words: list[bytes], counts: np.ndarray) -> tuple[list, list]:
        often = [i for i in np.argsort(-counts, kind="stable")[:TREE_WORDS].tolist() if counts[i] >= TREE_COUNT]
        return [words[i] for i in often], [int(counts[i]) for i in often]

    rows = words_in(totals, pick, "word binary, n long", ["word", "n"], [pa.binary(), pa.int64()])
    return [(bytes(r["word"]), r["n"]) for r in rows.orderBy(F.desc("n"), "word").limit(TREE_WORDS).collect()]


def sum_over_words(totals: DataFrame, tree, words: int, about) -> np.ndarray | int:
    """Sum of the whole-numbered arrays that about(words) gives, over all distinct training words outside the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, _, payload in rows_of(batches):
            some, counts = expand(payload)
            total = total + about([w for w, c in zip(some, counts.tolist(), strict=True) if c and w not in tree.value.symbols])
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([squeeze(total)], pa.binary())], ["payload"])
        release()

    rows = few_tasks(totals.select("block", "n", "payload"), words).mapInArrow(run, "payload binary").collect()  # small, one a task
    return sum(expand(bytes(r["payload"])).astype(object) for r in rows)


def fit_spelling(totals: DataFrame, tree, words: int, shared, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(weights by gate, refining log-odds by gate and step) from all distinct training words outside the tree."""
    sums = sum_over_words(totals, tree, words, lambda some: slopes(opened(shared.value)[1], some, sizes))
    weights = moved_weights(sums) if isinstance(sums, np.ndarray) else first_weights()
    seen = sum_over_words(totals, tree, words, lambda some: steps_seen(opened(shared.value)[1], some, sizes, weights))
    return weights, refining_of(np.zeros((2, SPELL_GATES, SPELL_STEPS)) + np.array(seen, float))


PARTIAL = "k int, part int, payload binary"
PARTIAL_ARROW = pa.schema([("k", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])


def partial_rows(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each part of PART slots of each table (slots x 2 counts) that holds any count."""
    for k, table in enumerate(tables):
        for part in range(0, max(1, len(table) // PART)):
            own = table[part * PART : (part + 1) * PART]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([pack_array(to_planes(own.ravel()))], pa.binary())], schema=PARTIAL_ARROW)


def summed(partial: DataFrame, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray | int]:
    """(tables of pairs of bytes (zeros low, ones high): of the bounded sizes, whatever the input; sum of the rows of table -1)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts = from_planes(expand(payload.as_py())).astype(np.int64)
                sums[k, part] = sums[k, part] + counts if (k, part) in sums else counts
        for (k, part), counts in sums.items():
            if k < 0:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([pack_array(counts)], pa.binary())], schema=PARTIAL_ARROW)
                continue
            zeros, ones = to_byte(counts[0::2]), to_byte(counts[1::2])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([pack_array(zeros.astype(np.uint16) | ones.astype(np.uint16) << 8)], pa.binary())], schema=PARTIAL_ARROW)

    out, more = [np.zeros(1 << s, np.uint16) for s in sizes], 0
    for r in partial.repartition("k", "part").mapInArrow(add, PARTIAL).collect():
        pairs = expand(bytes(r["payload"]))
        if r["k"] < 0:
            more = more + pairs
            continue
        out[r["k"]][r["part"] * PART : r["part"] * PART + len(pairs)] = pairs
    return out, more


def table_sizes(most: tuple[int, ...], events: int) -> tuple[int, ...]:
    """As powers of two: they follow the number of events up to most. The first is always whole."""
    return (most[0], *(min(m, max(12, math.ceil(math.log2(max(events, 1))) + 1)) for m in most[1:]))


def few_tasks(df: DataFrame, tokens: int) -> DataFrame:
    """df in so few tasks that their tables are small against what they count, but with work for every core."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(tokens / TASK_TOKENS)))


def spelling_counts(totals: DataFrame, tree, sizes: tuple[int, ...], words: int) -> list[np.ndarray]:
    """Each distinct training word outside the tree counts once: unseen words are like rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((1 << s, 2), np.uint32) for s in sizes]
        for _, _, payload in rows_of(batches):
            some, counts = expand(payload)
            some = [w for w, c in zip(some, counts.tolist(), strict=True) if c and w not in tree.value.symbols]
            for _, _, times, slots, bit, _ in stems(some, sizes):
                for k, table in enumerate(tables):
                    np.add.at(table.ravel(), 2 * slots[k] + bit, times.astype(np.uint32))
        yield from partial_rows(tables)
        del tables
        release()

    return summed(few_tasks(totals, words).mapInArrow(run, PARTIAL), sizes)[0]


def grouped_texts(batches: Iterator[pa.RecordBatch], tree: Tree, *columns: str) -> Iterator[tuple[Texts, list]]:
    """(Texts, values of the columns) for some texts at a time, about CHUNK tokens or one text."""
    lengths, found, rest, size = [], [], [], 0

    def ready() -> tuple[Texts, list]:
        own = np.concatenate(found)
        return Texts(np.array(lengths, np.int64), own[:, 0], own[:, 1]), rest

    for text, *more in texts_of(batches, "text", *columns):
        words = words_of(text)
        found.append(known_words(words, tree))
        lengths.append(len(words))
        rest.append(more)
        size += len(words) + 1
        if size >= CHUNK:
            yield ready()
            lengths, found, rest, size = [], [], [], 0
    if lengths:
        yield ready()


def tree_counts(learned: DataFrame, tree, sizes: tuple[int, ...], tokens: int) -> tuple[list[np.ndarray], np.ndarray | int]:
    """(counts of every decision in every context, matched) of all rows of learned (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, count = [np.zeros((1 << s, 2), np.uint32) for s in sizes], 0
        foretold_words = np.zeros((2, GATES), np.int64)
        symbols = len(tree.value.first) - 1
        after = np.zeros((FREQUENT + 2) * symbols, np.int64)  # tokens by last frequent word and symbol

        def rows() -> Iterator[pa.RecordBatch]:
            pairs = np.flatnonzero(after)
            for first in range(0, len(pairs), SOME):
                some = pairs[first : first + SOME]
                owner, _, node, bit = path_of(tree.value, some % symbols)
                times, frequent = after[some][owner].astype(np.uint32), (some // symbols).astype(np.uint64)
                for k in (0, 3):
                    np.add.at(tables[k].ravel(), 2 * slots_of(k, sizes[k], frequent, owner, node) + bit, times)
            yield from partial_rows(tables)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([pack_array(to_planes(foretold_words.ravel()))], pa.binary())], schema=PARTIAL_ARROW)

        for texts, _ in grouped_texts(batches, tree.value):
            foretold_words += matched(texts)
            after += np.bincount(texts.contexts[3].astype(np.int64) * symbols + texts.symbols, minlength=len(after))
            for first in range(0, len(texts.symbols), SOME):
                some = np.arange(first, min(first + SOME, len(texts.symbols)))
                owner, _, node, bit = bits_of(texts, tree.value, some)
                for k in (1, 2):
                    np.add.at(tables[k].ravel(), 2 * slots_of(k, sizes[k], texts.contexts[k][some], owner, node) + bit, np.uint32(1))
                count += len(owner)
            if count >= 1 << 31:  # before a count could leave 32 bits
                yield from rows()
                tables, count = [np.zeros((1 << s, 2), np.uint32) for s in sizes], 0
                foretold_words[:], after[:] = 0, 0
        yield from rows()
        tables = []
        release()

    return summed(few_tasks(learned.select("text"), tokens).mapInArrow(run, PARTIAL), sizes)


def train(totals: DataFrame, learned: DataFrame, tokens: int, words: int, ends: int) -> Model:
    """The model from all training words (totals) and texts (learned); tokens and words are without the ends."""
    context = totals.sparkSession.sparkContext
    tree = make_tree(top_words(totals), ends, tokens, words)
    shared_tree = context.broadcast(tree)  # TREE_WORDS words at most
    tree_sizes, spell_sizes = table_sizes(TREE_SLOTS, 8 * tokens), table_sizes(SPELL_SLOTS, 64 * words)
    counted, foretold_words = tree_counts(learned, shared_tree, tree_sizes, tokens)
    start = first_start()
    hits, tries = (np.zeros(2 * GATES) + foretold_words).reshape(2, GATES)
    start.same = (hits + 0.5) / (tries + 1)
    spelling = spelling_counts(totals, shared_tree, spell_sizes, words)
    shared = context.broadcast((tuple(map(pack_array, counted)), tuple(map(pack_array, spelling))))  # of bounded size
    weights, refined = fit_spelling(totals, shared_tree, words, shared, spell_sizes)
    return Model(shared, tree, start, tree_sizes, spell_sizes, weights, refined)


def sums_of(lengths: np.ndarray, per_word: np.ndarray) -> np.ndarray:
    """Sum of per_word over the words of each text, from that text's words alone."""
    out, some = np.zeros(len(lengths)), lengths > 0
    if some.any():
        out[some] = np.add.reduceat(per_word, (np.cumsum(lengths) - lengths)[some])
    return out


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    bits_per_byte is of the text's words, a space after each. A null or empty text is its end alone (one byte). Equal
    texts score alike, and repeated rows are each learned from; a null doc_id counts as the empty text in the choice of
    held-out rows. Without training rows the base knows no words and the bits are close to even. A text may be of any
    length: only its words are held at once. An empty table gives no rows; other columns are dropped, whatever their names.
    """
    named = steady(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))

    def tally(names: list, lengths: list[int], numbers: np.ndarray, distinct: int) -> np.ndarray:
        learned = np.repeat(np.array([not held for _, held in names], bool), lengths)
        return np.bincount(numbers[learned], minlength=distinct)

    blocks = materialize(to_blocks(named, lambda: words_of, tally, ("held_out",)), "lm-blocks")
    totals = materialize(word_totals(blocks), "lm-words")
    learned = named.where(~F.col("held_out"))
    ends = learned.count()
    sums = words_in(totals, lambda words, counts: ([int(counts.sum())], [len(words)]), "n long, v long", ["n", "v"], [pa.int64()] * 2)
    tokens, words = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = tokens + ends, words + (ends > 0)
    model = train(totals, learned, tokens, words, ends)  # goes to the tasks with their code: the tree and some weights

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            own, known, now = model, {}, None
            for block, k, payload in rows_of(batches):
                if block == -1:
                    if k != now:
                        now, known = k, {}
                    words, counts = expand(payload)
                    found = np.empty(len(words), WORD)
                    found["count"], found["spelled"], found["size"] = counts, 0, list(map(len, words))
                    found["symbol"], found["hash"] = known_words(words, own.tree).T
                    rest = np.flatnonzero(found["symbol"] == ESCAPE)
                    found["spelled"][rest] = own.spelled([words[i] for i in rest], counts[rest])
                    flat, size = found.tobytes(), WORD.itemsize
                    known.update((w, flat[i * size : (i + 1) * size]) for i, w in enumerate(words))
                    continue
                if k >= 0:
                    at, words, _ = expand(payload)
                    payload = squeeze((at, to_planes(np.full(len(words), WORD.itemsize, np.uint32)), b"".join([known[w] for w in words])))
                yield block, k, payload

        yield from batched(rows())
        release()

    both = blocks.unionByName(totals.withColumn("block", F.lit(-1).cast("long")))
    answered = by_bucket(both).sortWithinPartitions("n", "block").mapInArrow(answer, blocks.schema)

    def make():
        own = model

        def prepare(found):
            gather = found.gatherer(WORD)

            def texts(names: list, lengths: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
                words = gather(numbers)[0]
                some = Texts(lengths, words["symbol"].astype(np.int64), words["hash"])
                spelled = np.zeros(len(some.symbols))
                inner = np.ones(len(spelled), bool)
                inner[some.starts + lengths] = False
                spelled[inner] = words["spelled"]
                c = words["count"]
                base = sums_of(lengths, np.log10(c + 1.0)) + math.log10(ends + 1) - (lengths + 1) * math.log10(n + v + 1)
                score = own.score(some, spelled)
                known = by_text(lengths, (c > 0).astype(np.int64)) + (ends > 0)
                columns = [pa.array([x for x, _ in names], pa.int64()), pa.array([bool(x) for _, x in names]), pa.array(lengths + 1), pa.array(known, pa.int64()), pa.array(np.full(len(names), n))]
                size = by_text(lengths, words["size"].astype(np.int64)) + lengths + 1
                yield pa.RecordBatch.from_arrays([*columns, pa.array(base), pa.array(score), pa.array(-score / math.log10(2) / size)], [x.split()[0] for x in OUT.split(", ")])

            return texts

        return prepare

    return texts_from_blocks(answered, make, OUT)
