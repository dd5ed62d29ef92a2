"""Language-model scoring by online logistic context mixing.

A text is its words, A-Z in lower case, each closed by an end byte, and one final end mark (an
empty word). Its class, the nearest of a few centres by byte frequencies, is named first, and bytes
are coded bit by bit down an alphabetic code of the training bytes.

*A word's first byte* is coded across the word's start: its predictors hash the last two bytes of
the word before, the last one, and none, each within the class.

*The other bytes* have four predictors for each bit. Three hash the last four, three and two bytes of
the word within the class into a slot that holds how often either bit followed there in training.
The fourth holds the same for the whole word so far; these counts grow with the vocabulary, so they
are never in one table: words are dealt out by how they begin, and each task counts its own.

A gate, made of the place in the word and of how much the predictors have seen, selects weights; the
weighted sum of the predictors' logits is squashed to a probability. The weights are fitted online: words
are dealt out to parts by a hash, each part is gone through once in order, carrying its weights from step to
step (a word itself being left out of what its slots have seen), and the results of the parts are averaged. This is done for three
sets of weights: each word as often as it occurs, each word once, and each word as if it were new.

A document mixes the three sets. Their shares start alike and are refined after each run of ``RUN``
tokens by how well each set has coded it, before the next run is coded. So every token's probability
depends only on what stands before it, and code lengths add up to the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, id_and_text, shuffle_partitions, written

END = 32
PLACES = 4
SEEN = (1, 3, 10, 40)
SEEN_FOUR = (1, 10)
GATES = PLACES * (len(SEEN) + 1) * (len(SEEN_FOUR) + 1)
#: Bytes back of the hashed contexts and slots of their tables, as powers of two: how many contexts
#: of so few bytes languages have does not follow the size of the input.
ORDERS = (4, 3, 2)
TABLE_BITS = (21, 20, 20)
TABLE_AT = tuple(int(x) for x in np.cumsum([0, *(1 << b for b in TABLE_BITS)]))
SLOTS = TABLE_AT[-1]
INPUTS = len(ORDERS) + 2
SETS = 3
RUN, SWITCH = 16, 0.05
CLASSES = 8
LIMIT, PRIOR, BIAS = 12.0, 0.1, 0.4
TAILS = 1024
#: Words are dealt out by so many first bytes, and by twice as many where that leaves too much together.
DEPTH = 3
#: Least number of buckets of words: it follows from the texts alone, never from the cluster.
LEAST_BUCKETS = 64
#: By how much the whole-word predictor has seen; the last weight is the bias.
INITIAL = ((0.0, 0.6, 0.3, 0.1, 0.0), (0.3, 0.4, 0.2, 0.1, 0.0), (0.6, 0.3, 0.1, 0.0, 0.0), (0.8, 0.2, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0, 0.0))


# Coding of bytes
@dataclass(frozen=True)
class Tree:
    """Alphabetic code of the 256 bytes: nodes passed and bits taken by each, one after the other
    from start[byte] to start[byte + 1]. Words in byte order are in the order of their bits."""

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def alphabetic(counts: np.ndarray) -> Tree:
    """Each range of bytes is cut where its weight halves; bytes that never occurred weigh one."""
    weight = np.cumsum(np.r_[0, counts.astype(np.float64) + 1])
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    stack = [(0, 256)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo == 1:
            continue
        cut = lo + 1 + int(np.abs(weight[lo + 1 : hi] * 2 - weight[lo] - weight[hi]).argmin())
        for b in range(lo, hi):
            paths[b].append((cut, int(b >= cut)))
        stack += [(lo, cut), (cut, hi)]
    flat = [x for p in paths for x in p]
    return Tree(np.cumsum([0, *map(len, paths)]), np.array([x[0] for x in flat], np.uint64), np.array([x[1] for x in flat], np.uint8))


@dataclass(frozen=True)
class Words:
    """Words as their bytes one after the other and their sizes, and the class of each."""

    data: np.ndarray
    size: np.ndarray
    kind: np.ndarray

    def pieces(self, most: int = 1 << 17) -> Iterator[tuple[slice, Words]]:
        """Runs of words of about ``most`` bytes; a longer word is alone."""
        ends = np.cumsum(self.size + 1)
        lo = 0
        while lo < len(self.size):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            a, b = int(ends[lo - 1] - lo) if lo else 0, int(ends[hi - 1] - hi)
            yield slice(lo, hi), Words(self.data[a:b], self.size[lo:hi], self.kind[lo:hi])
            lo = hi


def word_table(words: list[bytes], kinds: list[int]) -> Words:
    return Words(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)), np.array(kinds, np.int64))


def body_bits(words: Words, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bits of all bytes but the first of each word and its end byte: bits, slots of the hashed
    contexts (a row per order), places, and where each word's bits start."""
    sizes = words.size + 1
    ends = np.cumsum(sizes)
    text = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    own = np.ones(len(text), bool)
    own[ends - 1] = False
    text[own] = words.data
    first = ends - sizes
    place = np.arange(len(text)) - np.repeat(first, sizes)
    inner = np.flatnonzero(place > 0)
    place = place[inner]
    kind = np.repeat((words.kind.astype(np.uint64) + np.uint64(1)) << np.uint64(40), sizes - 1)
    contexts, code = [], kind
    for k in range(1, ORDERS[0] + 1):
        code = code + np.where(place >= k, (text[np.maximum(inner - k, 0)] + np.uint64(1)) << np.uint64(9 * (k - 1)), np.uint64(0))
        if k in ORDERS:
            contexts.insert(0, code)
    byte = text[inner].astype(np.int64)
    lengths = np.diff(tree.start)[byte]
    begin = np.cumsum(lengths) - lengths
    step = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    at = np.repeat(tree.start[byte], lengths) + step
    node = tree.node[at] * np.uint64(0xD6E8FEB86659FD93)
    slots = np.empty((len(ORDERS), len(at)), np.int32)
    for j, c in enumerate(contexts):
        slots[j] = _slot(np.repeat(c * np.uint64(0x9E3779B97F4A7C15), lengths) ^ node, TABLE_BITS[j]) + TABLE_AT[j]
    bounds = np.r_[begin, len(at)]
    starts = bounds[np.r_[0, np.cumsum(sizes - 1)]]
    return tree.bit[at], slots, np.repeat(np.minimum(place, 255).astype(np.uint8), lengths), starts


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h >>= np.uint64(64 - bits)
    return h.astype(np.int32)


def prefix_counts(words: Words, bit: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every bit of words in order of class and bytes: the weight of all words that share the
    word so far and the class, and of those that go on with a one. Level by level; words that share
    what is before a level lie side by side."""
    seen, ones = np.zeros(len(bit), np.float32), np.zeros(len(bit), np.float32)
    head = np.zeros(len(words.size), np.int64)
    full = words.size > 0
    head[full] = words.data[(np.cumsum(words.size) - words.size)[full]]
    live = np.flatnonzero(np.diff(starts) > 0)
    fresh = np.r_[True, (head[live][1:] != head[live][:-1]) | (words.kind[live][1:] != words.kind[live][:-1])] if len(live) else np.zeros(0, bool)
    left, at, w = np.diff(starts)[live], starts[live], weight[live].astype(np.float64)
    while len(at):
        b = bit[at]
        edges = np.flatnonzero(fresh)
        times = np.diff(np.r_[edges, len(at)])
        seen[at] = np.repeat(np.add.reduceat(w, edges), times)
        ones[at] = np.repeat(np.add.reduceat(w * b, edges), times)
        fresh[1:] |= b[1:] != b[:-1]
        left = left - 1
        on = left > 0  # no word is another's beginning, so one that ends was alone in its place
        fresh, left, at, w = fresh[on], left[on], at[on] + 1, w[on]
    return seen, ones


# Mixing
def _logit(seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    seen, ones = seen.astype(np.float32), ones.astype(np.float32)
    return np.clip(np.log((ones + np.float32(PRIOR)) / (seen - ones + np.float32(PRIOR))), -LIMIT, LIMIT)


def mixer_inputs(seen: np.ndarray, ones: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (whole word, the orders, bias) and gates of bits, from what each predictor has seen."""
    x = np.empty((INPUTS, len(place)), np.float32)
    for j in range(INPUTS - 1):
        x[j] = _logit(seen[j], ones[j])
    x[-1] = BIAS
    gate = np.searchsorted(np.array(SEEN, np.float32), seen[0], "right") * (len(SEEN_FOUR) + 1) + np.searchsorted(np.array(SEEN_FOUR, np.float32), seen[1], "right")
    return x, gate * PLACES + np.minimum(place, PLACES) - 1


def initial_weights() -> np.ndarray:
    return np.repeat(np.array(INITIAL, np.float64), (len(SEEN_FOUR) + 1) * PLACES, 0)


def code_lengths(x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Nats of each bit."""
    z = np.zeros(len(gate), np.float32)
    w = weights.astype(np.float32).T
    for j in range(len(x)):
        z += w[j].take(gate) * x[j]
    z[bit > 0] *= -1
    return np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)


class Learner:
    """Weights learned online: each step goes down the gradient of some words' code length, by less
    the more curvature has been met."""

    def __init__(self, start: np.ndarray, rate: float = 0.4):
        self.w, self.met, self.rate = start.copy(), np.full(start.shape, 4.0), rate

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weigh: np.ndarray) -> None:
        z = np.einsum("ji,ij->i", x, self.w[gate])
        p = 1 / (1 + np.exp(-z))
        err, bend = (bit - p) * weigh, p * (1 - p) * weigh
        for j in range(len(x)):
            self.met[:, j] += np.bincount(gate, bend * x[j] ** 2, len(self.w))
            self.w[:, j] += self.rate * np.bincount(gate, err * x[j], len(self.w)) / self.met[:, j]


@dataclass(frozen=True)
class Model:
    """All that is not specific to a word: counts of the hashed contexts (seen, ones), the sets of
    weights, nats of a first byte by class, end of the word before and byte."""

    classes: int
    tokens: int
    distinct: int
    tree: Tree
    seen: np.ndarray
    ones: np.ndarray
    weights: np.ndarray
    first: np.ndarray


def _predictions(words: Words, count: np.ndarray, depth: int, tree: Tree, seen: np.ndarray, ones: np.ndarray):
    """By pieces of words: slice, bits, starts, places, seen and ones of the predictors (a row each)."""
    bounds, every = [0], []
    for part, own in words.pieces():
        bit, slots, place, starts = body_bits(own, tree)
        every.append((part, bit, slots, place, starts))
        bounds.append(bounds[-1] + len(bit))
    bits = np.concatenate([e[1] for e in every]) if every else np.zeros(0, np.uint8)
    at = np.concatenate([[0], *[e[4][1:] + b for e, b in zip(every, bounds, strict=False)]]).astype(np.int64)
    whole, whole_ones = prefix_counts(words, bits, at, count)
    for (part, bit, slots, place, starts), lo in zip(every, bounds, strict=False):
        s, o = (np.empty((INPUTS - 1, len(bit)), np.float32) for _ in range(2))
        s[1:], o[1:] = seen.take(slots), ones.take(slots)
        s[0], o[0] = whole[lo : lo + len(bit)], whole_ones[lo : lo + len(bit)]
        early = np.flatnonzero(place < depth)  # words of other tasks share these beginnings; three bytes back hold them whole
        row = np.where(place[early] < DEPTH, 2, 1)
        s[0][early], o[0][early] = s[row, early], o[row, early]
        yield part, bit, starts, place, s, o


def word_costs(words: Words, count: np.ndarray, depth: int, model: Model) -> np.ndarray:
    """Nats of each word after its first byte, a column per set of weights."""
    out = np.zeros((len(words.size), SETS), np.float32)
    for part, bit, starts, place, s, o in _predictions(words, count, depth, model.tree, model.seen, model.ones):
        x, gate = mixer_inputs(s, o, place)
        for k in range(SETS):
            total = np.concatenate([[0.0], np.cumsum(code_lengths(x, gate, bit, model.weights[k]), dtype=np.float64)])
            out[part, k] = np.diff(total[starts])
    return out


def learn_words(words: Words, count: np.ndarray, depth: int, tree: Tree, seen: np.ndarray, ones: np.ndarray, learners: list[Learner], step: int = 250) -> None:
    """One online pass over the words that occur in training, shuffled within pieces."""
    used = np.flatnonzero(count)
    words, count = taken(words, used), count[used]
    for part, bit, starts, place, s, o in _predictions(words, count, depth, tree, seen, ones):
        c = count[part]
        times = np.diff(starts)
        order = np.argsort(np.random.default_rng(len(c)).random(len(c)), kind="stable")
        order = order[times[order] > 0]
        each = np.repeat(c, times).astype(np.float32)
        apart = [mixer_inputs(s - less, o - less * bit, place) for less in (np.float32(1), each)]
        for lo in range(0, len(order), step):
            own = order[lo : lo + step]
            at = np.repeat(starts[own] - (np.cumsum(times[own]) - times[own]), times[own]) + np.arange(int(times[own].sum()))
            for learner, (x, gate), weigh in zip(learners, (apart[0], apart[0], apart[1]), (each[at], 1.0, 1.0), strict=True):
                learner.learn(x[:, at], gate[at], bit[at], weigh)


def tail_of(words: Words) -> np.ndarray:
    """A number under TAILS of the last two bytes of each word; its last byte's is that times 4 over TAILS."""
    ends = np.cumsum(words.size)
    padded = np.r_[np.zeros(2, np.int64), words.data.astype(np.int64)]
    last, second = np.where(words.size > 0, padded[ends + 1], 0), np.where(words.size > 1, padded[ends], 0)
    return last * (TAILS // 256) + (second * 37 >> 3) % (TAILS // 256)


def first_byte_costs(counts: np.ndarray, tree: Tree, rounds: int = 3) -> np.ndarray:
    """Nats of a first byte (class, tail, byte) from how often it followed in training. Predictors:
    within the class, after the last byte, after the last two; online, each weighing its count."""
    classes = len(counts)
    seen, ones, paths = [], [], [range(tree.start[b], tree.start[b + 1]) for b in range(256)]
    for level in (1, 256, TAILS):
        table = counts.reshape(classes, level, -1, 256).sum(2).astype(np.float64)
        s, o = (np.zeros((classes, level, 256)) for _ in range(2))
        for b, path in enumerate(paths):
            for k in path:
                s[:, :, int(tree.node[k])] += table[:, :, b]
                o[:, :, int(tree.node[k])] += table[:, :, b] * tree.bit[k]
        seen.append(s)
        ones.append(o)
    gates = len(SEEN) + 1
    used = [np.argwhere(seen[2][:, :, int(n)] > 0) for n in range(256)]
    learner = Learner(np.repeat(np.array([[0.1, 0.3, 0.6, 0.0]]), gates, 0))

    def inputs(c, t, node, less=0.0, bit=0.0):
        cells = ((c, t * 0, node), (c, t * 256 // TAILS, node), (c, t, node))
        s, o = ([a[i] - d for a, i in zip(table, cells, strict=True)] for table, d in ((seen, less), (ones, less * bit)))
        x = np.stack([*(_logit(a, b) for a, b in zip(s, o, strict=True)), np.full(len(c), BIAS)])
        return x, np.searchsorted(np.array(SEEN, np.float64), s[2], "right")

    for _ in range(rounds):
        for n in range(256):
            if len(used[n]):
                c, t = used[n].T
                for bit in (1.0, 0.0):
                    many = ones[2][c, t, n] if bit else seen[2][c, t, n] - ones[2][c, t, n]
                    on = many > 0
                    x, gate = inputs(c[on], t[on], n, 1.0, bit)
                    learner.learn(x, gate, np.full(int(on.sum()), bit), many[on])
    c, t = (a.ravel() for a in np.indices((classes, TAILS)))
    out = np.zeros((classes, TAILS, 256))
    for n in sorted({int(n) for n in tree.node}):
        x, gate = inputs(c, t, n)
        one, zero = (code_lengths(x, gate, np.full(len(c), b), learner.w).reshape(classes, TAILS) for b in (1, 0))
        for b, path in enumerate(paths):
            for k in path:
                if int(tree.node[k]) == n:
                    out[:, :, b] += one if tree.bit[k] else zero
    return out.astype(np.float32)


def mixed_sets(costs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Nats of documents from the costs of their tokens under each set, one document after the other."""
    runs = (sizes + RUN - 1) // RUN
    first = np.cumsum(runs) - runs
    number = np.arange(int(runs.sum())) - np.repeat(first, runs)
    per_run = np.add.reduceat(costs.astype(np.float64), np.repeat(np.cumsum(sizes) - sizes, runs) + number * RUN, axis=0)
    share, total = np.full((len(sizes), costs.shape[1]), 1 / costs.shape[1]), np.zeros(len(sizes))
    order = np.argsort(-runs, kind="stable")
    ranked = -runs[order]
    for k in range(int(runs.max(initial=0))):
        now = order[: np.searchsorted(ranked, -k, "left")]
        cost = per_run[first[now] + k]
        least = cost.min(1, keepdims=True)
        p = share[now] * np.exp(least - cost)
        whole = p.sum(1, keepdims=True)
        total[now] += (least - np.log(whole))[:, 0]
        share[now] = (1 - SWITCH) * p / whole + SWITCH / costs.shape[1]
    return total


# Classes of texts
def _folding() -> np.ndarray:
    """Places of the 256 bytes in a profile: letters without case, bytes above 127 by their last
    five bits; other ASCII has none."""
    out = np.zeros((256, 64))
    for b in range(256):
        if b >= 128 or chr(b).isalpha():
            out[b, 32 + (b & 31) if b >= 128 else b & 31] = 1
    return out


_FOLD = _folding()


def byte_counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)


def profile_of(counts: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of a text's bytes, folded to 64 places."""
    folded = counts @ _FOLD
    return np.sqrt(folded / max(1, folded.sum())).astype(np.float32)


def nearest(profiles: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((profiles**2).sum(1)[:, None] - 2 * profiles @ centres.T + (centres**2).sum(1)).argmin(1)


def _profiles(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([profile_of(byte_counts(t)).astype("<f4").tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["profile"])


#: Profiles are summed as whole numbers of this part, so that the sums don't depend on how rows lie in tasks.
PART = 1 << 20


def _sums(centres: np.ndarray):
    """A task's number, sum and sum of squares of profiles for each centre, in whole parts."""

    def run(batches):
        total = np.zeros((len(centres), 129), np.int64)
        for batch in batches:
            p = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f4").reshape(-1, 64).astype(np.float64)
            near, q = nearest(p, centres), np.rint(p * PART).astype(np.int64)
            for k in range(len(centres)):
                own = q[near == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own**2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], names=["k", "sums"])

    return run


def class_centres(texts: DataFrame, rounds: int = 2) -> np.ndarray:
    """At most CLASSES centres of the profiles of all texts: each centre is parted along the place
    in which its texts differ most, then all move to the means of theirs, by aggregations of a row
    per centre. No texts: one centre."""
    profiles = written(texts.mapInArrow(_profiles, "profile binary"), "lm-profiles")

    def gathered(centres: np.ndarray) -> np.ndarray:
        rows = profiles.mapInArrow(_sums(centres), "k int, sums array<long>").select("k", F.posexplode("sums").alias("at", "x")).groupBy("k", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        out = np.zeros((len(centres), 129))
        for r in rows:
            out[r.k, r.at] = int(r.x) / (1 if r.at == 0 else PART if r.at < 65 else PART**2)
        return out

    centres = np.zeros((1, 64))
    while True:
        sums = gathered(centres)
        n = np.maximum(sums[:, :1], 1)
        means = np.where(sums[:, :1] > 0, sums[:, 1:65] / n, centres)
        spread = np.maximum(sums[:, 65:] / n - means**2, 0) * (sums[:, :1] > 0)
        widest = spread.argmax(1)
        apart = np.zeros_like(means)
        apart[np.arange(len(means)), widest] = np.sqrt(spread[np.arange(len(means)), widest])
        some = apart.any(1)
        if 2 * len(means) > CLASSES or not some.any():
            return means
        centres = np.concatenate([means - apart, (means + apart)[some]])
        for _ in range(rounds):
            sums = gathered(centres)
            centres = np.where(sums[:, :1] > 0, sums[:, 1:65] / np.maximum(sums[:, :1], 1), centres)


# Tables of words
_TALLY = "block long, bucket long, words binary, sizes binary, kinds binary, numbers binary, train binary, key array<long>, n array<long>, doc_ids array<long>, held array<boolean>, doc_kinds binary, n_bytes array<long>, lengths array<long>, tokens binary, heads binary, tails binary"
_TALLY_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *[(n, pa.binary()) for n in ("words", "sizes", "kinds", "numbers", "train")], ("key", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("doc_kinds", pa.binary()), ("n_bytes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("heads", pa.binary()), ("tails", pa.binary())])


def _row(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([columns.get(f.name)], f.type) for f in schema], schema=schema)


def beginnings(words: Words, depth: int) -> np.ndarray:
    """A hash of the first ``depth`` bytes of each word."""
    starts = np.cumsum(words.size) - words.size
    padded = np.r_[words.data.astype(np.uint64), np.zeros(depth, np.uint64)]
    out = np.zeros(len(words.size), np.uint64)
    for k in range(depth):
        out = (out + np.where(words.size > k, padded[starts + k] + np.uint64(1), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def taken(words: Words, order: np.ndarray) -> Words:
    """The words at ``order``."""
    starts, size = np.cumsum(words.size) - words.size, words.size[order]
    at = np.repeat(starts[order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return Words(words.data[at], size, words.kind[order])


def _dealt(words: Words, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray, Words]]:
    """Words by bucket: its number, the places and the words of it."""
    order = np.argsort(bucket, kind="stable")
    sorted_words, at = taken(words, order), bucket[order]
    cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
    byte = np.r_[0, np.cumsum(sorted_words.size)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            yield int(at[a]), order[a:b], Words(sorted_words.data[byte[a] : byte[b]], sorted_words.size[a:b], sorted_words.kind[a:b])


class _Block:
    """Some documents of a task. Words are numbered within the block, by class."""

    def __init__(self, number: int):
        self.number, self.known, self.docs, self.kinds = number, {}, [], []

    def add(self, doc_id, held: bool, text: str, centres: np.ndarray) -> None:
        counts = byte_counts(text)
        kind = int(nearest(profile_of(counts)[None], centres)[0])
        words = ascii_words(text)
        words.append(b"")
        known, kinds = self.known.setdefault(kind, {}), self.kinds
        for w in words if len(words) < 50 else dict.fromkeys(words):
            if w not in known:
                known[w] = len(kinds)
                kinds.append(kind)
        ids = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        n_bytes = int(counts.sum() - counts[[9, 10, 11, 12, 13, 32]].sum()) + len(words)
        self.docs.append((doc_id, held, kind, n_bytes, ids))

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row per bucket of words with their training counts; one with the first bytes that
        followed the ends of words in training; one with the documents."""
        spelled = [b""] * len(self.kinds)
        for known in self.known.values():
            for w, k in known.items():
                spelled[k] = w
        words = word_table(spelled, self.kinds)
        mine = [d[4] for d in self.docs if not d[1]]
        train = np.bincount(np.concatenate(mine), minlength=len(spelled)) if mine else np.zeros(len(spelled), np.int64)
        heads = np.full(len(spelled), END, np.int64)
        heads[words.size > 0] = words.data[(np.cumsum(words.size) - words.size)[words.size > 0]]
        tails = tail_of(words)
        for bucket, at, own in _dealt(words, (beginnings(words, DEPTH) % np.uint64(buckets)).astype(np.int64)):
            yield _row(_TALLY_ARROW, block=self.number, bucket=bucket, words=own.data.tobytes(), sizes=own.size.astype("<u4").tobytes(), kinds=own.kind.astype(np.uint8).tobytes(), numbers=at.astype("<u4").tobytes(), train=train[at].astype("<i8").tobytes())
        if mine:
            keys = [(self.kinds[i[0]] * TAILS + np.r_[0, tails[i[:-1]]]) * 256 + heads[i] for i in mine]
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield _row(_TALLY_ARROW, block=self.number, key=key, n=n)
        ids, held, kinds, n_bytes, tokens = zip(*self.docs, strict=True)
        yield _row(_TALLY_ARROW, block=self.number, doc_ids=ids, held=held, doc_kinds=np.array(kinds, np.uint8).tobytes(), n_bytes=n_bytes, lengths=list(map(len, tokens)), tokens=np.concatenate(tokens).astype("<u4").tobytes(), heads=heads.astype(np.uint8).tobytes(), tails=tails.astype("<u2").tobytes())


def _tally(centres: np.ndarray, buckets: int, block_docs: int, block_chars: int):
    """Cuts a task's rows into blocks and counts their words."""

    def run(batches):
        block, chars = _Block(TaskContext.get().partitionId() << 32), 0
        for batch in batches:
            for doc_id, text, held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if len(block.docs) >= block_docs or chars >= block_chars:
                    yield from block.rows(buckets)
                    block, chars = _Block(block.number + 1), 0
                block.add(doc_id, held, text, centres)
                chars += len(text)
        if block.docs:
            yield from block.rows(buckets)

    return run


def _read(table, k: int) -> Words:
    return Words(*(np.frombuffer(table[c][k].as_buffer(), t).astype(np.int64 if t != np.uint8 or c == "kinds" else np.uint8, copy=False) for c, t in (("words", np.uint8), ("sizes", "<u4"), ("kinds", np.uint8))))


def _joined(parts: list[Words]) -> Words:
    return Words(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("data", "size", "kind")))


def _arrow(words: Words) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.size), [None, pa.py_buffer(np.r_[0, np.cumsum(words.size)].astype("<i8").tobytes()), pa.py_buffer(words.data.tobytes())])


_SPLIT = "bucket long, block long, words binary, sizes binary, kinds binary, numbers binary, train binary"
_SPLIT_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *[(n, pa.binary()) for n in ("words", "sizes", "kinds", "numbers", "train")]])


def _split(depth: int, fan_out: int):
    """Rows of words dealt out again by more of their first bytes."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                words = _read(batch, k)
                numbers, train = (np.frombuffer(batch[c][k].as_buffer(), t) for c, t in (("numbers", "<u4"), ("train", "<i8")))
                for part, at, own in _dealt(words, (beginnings(words, depth) % np.uint64(fan_out)).astype(np.int64)):
                    yield _row(_SPLIT_ARROW, bucket=batch["bucket"][k].as_py() * fan_out + part, block=batch["block"][k].as_py(), words=own.data.tobytes(), sizes=own.size.astype("<u4").tobytes(), kinds=own.kind.astype(np.uint8).tobytes(), numbers=numbers[at].tobytes(), train=train[at].tobytes())

    return run


_LEXICON = "bucket long, depth int, words binary, sizes binary, kinds binary, count binary, total binary, place binary, blocks array<long>, ends array<long>, numbers binary, letters array<long>, n_tokens long, n_distinct long"


def _pack(depth: int):
    """All rows of a bucket as one: its distinct words by class and bytes, how often each occurs in
    training (in its class, in all), and where in which block each stands."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_read(table, k) for k in range(len(table))]
        words = _joined(parts)
        train = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table["train"]])
        coded = _arrow(words).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        spelling = rank[coded.indices.to_numpy()]
        entry, place = np.unique(words.kind * len(order) + spelling, return_inverse=True)
        first = np.full(len(entry), len(spelling))
        np.minimum.at(first, place, np.arange(len(spelling)))
        own = taken(words, first)
        count, total = np.bincount(place, train, len(entry)), np.bincount(spelling, train, len(order))
        closed = np.repeat(count, own.size)
        letters = np.bincount(own.data, closed, 256)
        letters[END] += count.sum()
        return pa.table(
            {
                "bucket": table["bucket"][:1],
                "depth": pa.array([depth], pa.int32()),
                "words": pa.array([own.data.tobytes()], pa.binary()),
                "sizes": pa.array([own.size.astype("<u4").tobytes()], pa.binary()),
                "kinds": pa.array([own.kind.astype(np.uint8).tobytes()], pa.binary()),
                "count": pa.array([count.astype("<i8").tobytes()], pa.binary()),
                "total": pa.array([total[entry % len(order)].astype("<i8").tobytes()], pa.binary()),
                "place": pa.array([place.astype("<u4").tobytes()], pa.binary()),
                "blocks": pa.array([table["block"].to_pylist()], pa.list_(pa.int64())),
                "ends": pa.array([np.cumsum([len(p.size) for p in parts]).tolist()], pa.list_(pa.int64())),
                "numbers": pa.array([b"".join(table["numbers"].to_pylist())], pa.binary()),
                "letters": pa.array([letters.astype(np.int64).tolist()], pa.list_(pa.int64())),
                "n_tokens": pa.array([int(total.sum())], pa.int64()),
                "n_distinct": pa.array([int((total > 0).sum())], pa.int64()),
            }
        )

    return run


def lexicon_of(rows: DataFrame, bucket_bytes: int, fan_out: int = 64, deepest: int = 96) -> DataFrame:
    """The lexicon's rows. Buckets of more than ``bucket_bytes`` are dealt out again by more of the
    words' first bytes, level by level."""
    depth, out = DEPTH, None
    while True:
        size = F.sum(F.length("words") + F.length("sizes") * 5)
        over = written(rows.groupBy("bucket").agg(size.alias("size")).filter(F.col("size") > bucket_bytes).select("bucket"), "lm-over")
        last = depth >= deepest or over.isEmpty()
        done = rows if last else rows.join(over, "bucket", "left_anti")
        packed = done.groupBy("bucket").applyInArrow(_pack(depth), _LEXICON)
        out = packed if out is None else out.unionByName(packed)
        if last:
            return written(out, "lm-lexicon", compression="zstd")
        depth *= 2
        rows = written(rows.join(over, "bucket", "left_semi").select(*[c.split()[0] for c in _SPLIT.split(", ")]).mapInArrow(_split(depth, fan_out), _SPLIT), "lm-split", compression="zstd")


CHUNK = 4096
_TABLE = "chunk int, seen binary, ones binary"


def _entries(batch, k: int) -> tuple[Words, np.ndarray, int]:
    return _read(batch, k), np.frombuffer(batch["count"][k].as_buffer(), "<i8"), batch["depth"][k].as_py()


def _slot_counts(tree: Tree):
    """Each task's tables of the hashed contexts, a row per CHUNK slots that it has met."""

    def run(batches):
        seen, ones = (np.zeros(SLOTS) for _ in range(2))
        for batch in batches:
            for k in range(len(batch)):
                words, count, _ = _entries(batch, k)
                used = np.flatnonzero(count)
                words, count = taken(words, used), count[used]
                for part, own in words.pieces(1 << 20):
                    bit, slots, _, starts = body_bits(own, tree)
                    c = np.repeat(count[part], np.diff(starts)).astype(np.float64)
                    for row in slots:
                        np.add.at(seen, row, c)
                        np.add.at(ones, row, c * bit)
        while (met := np.flatnonzero(seen.reshape(-1, CHUNK).any(1))).size:  # more than once only where four bytes don't hold a count
            for at in np.array_split(met, max(1, len(met) // 64)):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array([np.minimum(t[a * CHUNK : (a + 1) * CHUNK], 0xFFFFFFFF).astype("<u4").tobytes() for a in at], pa.binary()) for t in (seen, ones))], names=["chunk", "seen", "ones"])
            for t in (seen, ones):
                np.maximum(t - 0xFFFFFFFF, 0, out=t)

    return run


def _sum_chunk(table: pa.Table) -> pa.Table:
    def total(name: str) -> bytes:
        return sum(np.frombuffer(x, "<u4").astype(np.float64) for x in table[name].to_pylist()).astype("<f4").tobytes()

    return pa.table({"chunk": table["chunk"][:1], "seen": pa.array([total("seen")], pa.binary()), "ones": pa.array([total("ones")], pa.binary())})


#: Distinct words for which there is a part that weights are fitted in, and the least number of parts.
PART_WORDS, LEAST_PARTS = 1 << 18, 8


def _fitted(shared):
    """Rows (part, ...) sorted by part and bucket: each part's weights after its words, times their number,
    and the number."""

    def run(batches):
        tree, seen, ones = shared.value
        at, learners, n = None, [], 0

        def emit():
            w = np.stack([x.w for x in learners]).ravel() * n
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)), pa.int32()), pa.array(w), pa.array([n] * len(w), pa.int64())], names=["cell", "w", "n"])

        for batch in batches:
            for k in range(len(batch)):
                if batch["part"][k].as_py() != at:
                    if n:
                        yield emit()
                    at, learners, n = batch["part"][k].as_py(), [Learner(initial_weights()) for _ in range(SETS)], 0
                words, count, depth = _entries(batch, k)
                learn_words(words, count, depth, tree, seen, ones, learners)
                n += int((count > 0).sum())
        if n:
            yield emit()

    return run


_COSTS = "block long, numbers binary, total binary, cost binary"
_COSTS_ARROW = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("numbers", "total", "cost")]])


def _costs(shared):
    """For each block in which words of a bucket stand: their numbers, training counts and costs."""

    def run(batches):
        model = shared.value
        for batch in batches:
            for k in range(len(batch)):
                words, count, depth = _entries(batch, k)
                cost = word_costs(words, count, depth, model)
                total, place, numbers = (np.frombuffer(batch[c][k].as_buffer(), t) for c, t in (("total", "<i8"), ("place", "<u4"), ("numbers", "<u4")))
                lo = 0
                for block, hi in zip(batch["blocks"][k].as_py(), batch["ends"][k].as_py(), strict=True):
                    own = place[lo:hi]
                    yield _row(_COSTS_ARROW, block=block, numbers=numbers[lo:hi].tobytes(), total=total[own].tobytes(), cost=cost[own].tobytes())
                    lo = hi

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _score(shared):
    def run(docs: pa.Table, costs: pa.Table) -> pa.Table:
        model = shared.value
        heads, tails = (np.frombuffer(docs[c][0].as_buffer(), t).astype(np.int64) for c, t in (("heads", np.uint8), ("tails", "<u2")))
        total, cost = np.zeros(len(heads), np.int64), np.zeros((len(heads), SETS), np.float32)
        for k in range(len(costs)):
            at = np.frombuffer(costs["numbers"][k].as_buffer(), "<u4")
            total[at] = np.frombuffer(costs["total"][k].as_buffer(), "<i8")
            cost[at] = np.frombuffer(costs["cost"][k].as_buffer(), np.float32).reshape(-1, SETS)
        sizes = np.array(docs["lengths"][0].as_py())
        tokens = np.frombuffer(docs["tokens"][0].as_buffer(), "<u4")
        kinds = np.frombuffer(docs["doc_kinds"][0].as_buffer(), np.uint8).astype(np.int64)
        plain = np.log10((total + 1) / (model.tokens + model.distinct + 1))
        n, ends = len(sizes), np.cumsum(sizes)
        base, nats, known = np.empty(n), np.empty(n), np.empty(n, np.int64)
        for lo, hi in _stretches(sizes, 1 << 19):
            a, own = int(ends[lo] - sizes[lo]), sizes[lo:hi]
            ids, begin = tokens[a : int(ends[hi - 1])], np.cumsum(own) - own
            before = np.r_[0, tails[ids[:-1]]]
            before[begin] = 0
            start = np.add.reduceat(model.first[np.repeat(kinds[lo:hi], own), before, heads[ids]].astype(np.float64), begin)
            nats[lo:hi] = start + mixed_sets(cost[ids], own) + math.log(model.classes)
            base[lo:hi] = np.add.reduceat(plain[ids], begin)
            known[lo:hi] = np.add.reduceat((total[ids] > 0).astype(np.int64), begin)
        return pa.table(
            {
                "doc_id": pa.array(docs["doc_ids"][0].as_py(), pa.int64()),
                "held_out": pa.array(docs["held"][0].as_py(), pa.bool_()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([model.tokens] * n, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(-nats / math.log(10), pa.float64()),
                "bits_per_byte": pa.array(nats / math.log(2) / np.array(docs["n_bytes"][0].as_py()), pa.float64()),
            }
        )

    return run


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Documents (from, to) of about ``most`` tokens together."""
    lo, held = 0, 0
    for k, s in enumerate(sizes.tolist()):
        held += s
        if held >= most or k == len(sizes) - 1:
            yield lo, k + 1
            lo, held = k + 1, 0


def fit_model(texts: DataFrame, centres: np.ndarray, tally: DataFrame, lexicon: DataFrame) -> Model:
    """The model from the tables of a corpus; what comes to the driver is of fixed size."""
    spark = texts.sparkSession
    tokens, distinct = lexicon.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    letters = np.zeros(256)
    for r in lexicon.select(F.posexplode("letters").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect():
        letters[r.byte] = r.n
    tree = alphabetic(letters)
    entries = lexicon.select("depth", "words", "sizes", "kinds", "count")
    seen, ones = (np.zeros(SLOTS, np.float32) for _ in range(2))
    for r in entries.mapInArrow(_slot_counts(tree), _TABLE).groupBy("chunk").applyInArrow(_sum_chunk, _TABLE).toLocalIterator():
        seen[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.seen, "<f4")
        ones[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.ones, "<f4")
    # parts follow from the words alone, and sums of decimals don't depend on their order: so don't the weights on the cluster
    parts = max(LEAST_PARTS, int(distinct) // PART_WORDS)
    dealt = lexicon.select(F.pmod(F.xxhash64("depth", "bucket"), F.lit(parts)).alias("part"), "bucket", "depth", "words", "sizes", "kinds", "count").repartition(min(parts, shuffle_partitions(spark)), "part").sortWithinPartitions("part", "depth", "bucket")
    fitted = dealt.mapInArrow(_fitted(spark.sparkContext.broadcast((tree, seen, ones))), "cell int, w double, n long")
    cells = fitted.groupBy("cell").agg(F.sum(F.col("w").cast("decimal(38,12)")).alias("w"), F.sum("n").alias("n")).collect()
    weights = np.stack([initial_weights()] * SETS)
    for r in cells:
        weights.ravel()[r.cell] = float(r.w) / r.n
    followed = np.zeros(len(centres) * TAILS * 256, np.int64)
    pairs = tally.filter("key is not null").select(F.explode(F.arrays_zip("key", "n")).alias("x")).groupBy("x.key").agg(F.sum("x.n").alias("n"))
    for batch in pairs.toPandas().itertuples(index=False):
        followed[batch.key] = batch.n
    first = first_byte_costs(followed.reshape(len(centres), TAILS, 256), tree)
    return Model(len(centres), int(tokens), int(distinct), tree, seen, ones, weights, first)


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, block_docs: int = 6000, block_chars: int = 24_000_000, bucket_chars: int = 6_000_000, bucket_bytes: int = 64_000_000) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte.

    Learns from rows whose crc32(doc_id as text) mod ``folds`` is not ``held_fold``; a null doc_id
    is never held out and is learned from. base_score: add-one unigram log10 probability of the
    tokens; score: the mixing model's log10 probability. Null texts count as empty (one end
    token). Repeated rows count as often as they occur and are scored alike. Empty table: no rows;
    where nothing is left to learn from all words are unknown. Texts are scored whole. All counts,
    weights and class centres come from all training rows. Other columns are ignored.
    """
    scored, _ = scores_and_model(docs, id_col=id_col, text_col=text_col, folds=folds, held_fold=held_fold, block_docs=block_docs, block_chars=block_chars, bucket_chars=bucket_chars, bucket_bytes=bucket_bytes)
    return scored


def scores_and_model(docs: DataFrame, *, id_col: str, text_col: str, folds: int, held_fold: int, block_docs: int, block_chars: int, bucket_chars: int, bucket_bytes: int) -> tuple[DataFrame, tuple[np.ndarray, Model]]:
    """lm_scores and what it scores with: the class centres and the model."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False)))
    centres = class_centres(rows.filter(~F.col("held_out")).select("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, 1 + chars // bucket_chars)
    tally = written(rows.select("doc_id", "text", "held_out").mapInArrow(_tally(centres, buckets, block_docs, block_chars), _TALLY), "lm-tally", compression="zstd")
    lexicon = lexicon_of(tally.filter("bucket is not null"), bucket_bytes)
    model = fit_model(rows, centres, tally, lexicon)
    shared = spark.sparkContext.broadcast(model)
    costs = lexicon.mapInArrow(_costs(shared), _COSTS)
    texts = tally.filter("doc_ids is not null").select("block", "doc_ids", "held", "doc_kinds", "n_bytes", "lengths", "tokens", "heads", "tails")
    return texts.groupBy("block").cogroup(costs.groupBy("block")).applyInArrow(_score(shared), _SCORED), (centres, model)
