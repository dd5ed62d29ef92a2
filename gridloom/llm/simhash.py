"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of m = 4 segments. If two fingerprints differ in at most t bits,
some segment starts a chain in which every prefix of l segments differs in at most l * t / m bits
(rounded down): for t = 3 a segment without a difference, then at most 1 within two, 2 within
three and 3 in all. The first two budgets give the lookup keys: an equal segment, and of the next
one at least one equal half (at most one bit differs, so one half is free of it). The rest of
the chain, and last the full Hamming distance, is checked inside a key's bucket.

A bucket of more than ``block`` fingerprints is dealt out as pairs of blocks, one piece of work
each, so no task holds an unbounded group. A piece of work returns a spanning forest of its links,
not all its pairs: components stay the same and rows stay in proportion. Copies of one
fingerprint are one node throughout.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, id_and_text, shuffle_partitions, written
from .graph import components

SEGMENTS, WIDTH = 4, 16
SEED = 42


def fingerprint(text: str, shingle: int) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; no words: zero."""
    words = ascii_words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        line, length = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        start = end - length
        h = xxhash.xxh64_intdigest
        n = len(words) - shingle + 1
        hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(start[:n].tolist(), end[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp long) of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def budgets(bits: int) -> list[int]:
    """Most differences within the first 1..m segments of a viable chain."""
    return [(k + 1) * bits // SEGMENTS for k in range(SEGMENTS)]


def _keyed(nodes: DataFrame) -> DataFrame:
    """Lookup keys of a chain's first two segments: rotation, half, equal segment, equal half."""

    def segment(i: int):
        return F.shiftrightunsigned("fp", WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))

    keys = []
    for i in range(SEGMENTS):
        for half in range(2):
            part = F.shiftrightunsigned(segment(i + 1), 8 * half).bitwiseAND(F.lit(255))
            keys.append((F.lit(2 * i + half).cast("long") * (1 << 24)) + segment(i) * 256 + part)
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _chained(diff: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Whether the chain that starts at segment ``first`` keeps every budget, the last of which
    is the full Hamming check."""
    ok = np.ones(diff.shape, bool)
    total = np.zeros(diff.shape, np.uint8)
    for k, most in enumerate(budgets(bits)):
        total += np.bitwise_count((diff >> np.uint64(WIDTH * ((first + k) % SEGMENTS))) & np.uint64((1 << WIDTH) - 1))
        ok &= total <= most
    return ok


def _forest(linked: np.ndarray) -> np.ndarray:
    """Least index reachable in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _links(bits: int):
    """Rows sorted by (key, pair): a spanning forest of each piece of work's links."""

    def run(batches):
        rest = (np.zeros(0, np.int64),) * 3
        for batch in _with_end(batches):
            if batch is not None:
                cols = tuple(np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest))
            else:
                cols = rest
            key, pair, fp = cols
            if not len(key):
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            bounds = [0, *cuts.tolist()] + ([len(key)] if batch is None else [])
            if batch is not None:
                rest = tuple(c[bounds[-1] :] for c in cols)
            a, b = [], []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo < 2:
                    continue
                own = fp[lo:hi]
                u = own.view(np.uint64)
                label = _forest(_chained(u[:, None] ^ u[None, :], int(key[lo]) >> 25, bits))
                far = label != np.arange(len(own))
                a.append(own[far])
                b.append(own[label[far]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def _dealt(keyed: DataFrame, node: str, block: int) -> DataFrame:
    """Rows of keys that several nodes share, large buckets as pairs of blocks of about ``block``."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / block).alias("g"))
    shared = keyed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64(node), F.col("g")))
    both = shared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    pair = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
    return both.withColumn("pair", pair).select("key", "pair", *[c for c in keyed.columns if c != "key"])


def pigeonring_links(nodes: DataFrame, bits: int = 3, block: int = 1024) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``nodes`` (fp long) whose components are
    those of all pairs at most ``bits`` apart."""
    if not 0 <= bits < SEGMENTS:
        raise ValueError("the lookup keys need an equal segment: 0 to 3 bits")
    pairs = _dealt(_keyed(nodes), "fp", block)
    n = shuffle_partitions(nodes.sparkSession)
    return pairs.repartition(n, "key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_links(bits), "a long, b long").distinct()


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, block: int = 1024) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at most ``bits`` apart are linked; component_id is the least doc_id reachable.
    Null and wordless texts have fingerprint zero and are linked like any other; texts shorter
    than a shingle are one shingle. Repeated rows share their component; rows with a null doc_id
    keep their component but never name it (null if all its ids are null). Empty table: no rows.
    """
    fps = written(fingerprints(id_and_text(docs, id_col, text_col), shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(pigeonring_links(nodes.select("fp"), bits, block))
    grouped = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    names = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "part").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints for similarities well below 1: words of 64 bits and segments of the ring. Sets of
#: fewer than SMALL shingles have too coarse a fingerprint and are proposed without it.
WORDS, RING, SMALL = 4, 16, 16
#: One document in SAMPLE is searched for frequent shingles, of which at most FREQUENT are taken.
SAMPLE, FREQUENT = 64, 1 << 16


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle are one, no words none."""
    words = ascii_words(text)
    grams = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WORDS * 64 bits of a set of shingles: their hashes, mixed once more for each word."""
    total = np.zeros(WORDS * 64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        h = hashes[lo : lo + (1 << 14)]
        mixed = np.empty((len(h), WORDS), np.uint64)
        for k in range(WORDS):
            x = h * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            mixed[:, k] = x ^ (x >> np.uint64(32))
        total += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which hashes are among sorted ones, in time that hardly grows with the number of these
    (np.isin sorts them anew with each call)."""
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


def _lists(parts: list) -> pa.Array:
    """Arrays of hashes as an Arrow column of lists."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hashes) of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t, shingle) for t in batch.column(1).to_pylist()])], names=["doc_id", "hashes"])

    return texts.mapInArrow(run, "doc_id long, hashes array<long>")


def _frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that several sampled documents hold. They only come last in the
    order that prefixes are taken by: which they are changes the work, not the result."""
    sample = shingle_sets(texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), shingle)
    counts = sample.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 3")
    return np.sort(np.array([r.h for r in counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64))


def _marks(texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """(doc_id, same, n, fp, prefix): a digest of the set of shingles, its size, its fingerprint and
    the first of its hashes. Two sets as similar as asked share at least ceil(similarity * n) of n
    shingles, so the first n - that + 1 in one order for all sets have one in common."""
    frequent = _frequent(texts, shingle)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            prefixes = []
            for s in sets:
                late = _among(s, frequent)
                prefixes.append(np.concatenate([s[~late], s[late]])[: len(s) + int(-similarity * len(s) // 1) + 1 if len(s) else 0])
            same, fps = (pa.array([f(s) for s in sets], pa.binary()) for f in (lambda s: xxhash.xxh3_128_digest(s.tobytes()), wide_fingerprint))
            yield pa.RecordBatch.from_arrays([batch.column(0), same, pa.array(list(map(len, sets)), pa.int32()), fps, _lists(prefixes)], names=["doc_id", "same", "n", "fp", "prefix"])

    return texts.mapInArrow(run, "doc_id long, same binary, n int, fp binary, prefix array<long>")


def _spanning(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links between a and b, made of the nearest of them (Boruvka)."""
    order = np.argsort(far, kind="stable")
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, left, kept = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            break
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, label[x[left]], left)
        np.minimum.at(best, label[y[left]], left)
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        while ((u := label[x[chosen]]) != (v := label[y[chosen]])).any():
            least = np.arange(len(nodes))
            np.minimum.at(least, u, v)
            np.minimum.at(least, v, u)
            while (least[least] != least).any():
                least = least[least]
            label = least[label]
    own = order[np.concatenate([np.zeros(0, np.int64), *kept])]
    return a[own], b[own], far[own]


def _near(diff: np.ndarray, bits: int) -> np.ndarray:
    """Rows of WORDS differing words: pigeonring chains from some segment, then all bits. Differing
    bits, or -1 where they are more than ``bits``."""
    parts = np.bitwise_count(diff.view(np.uint16).reshape(len(diff), RING))
    twice = np.concatenate([parts, parts[:, : RING - 1]], 1).astype(np.int16)
    viable = np.ones((len(diff), RING), bool)
    total = np.zeros((len(diff), RING), np.int16)
    for k in range(4):
        total += twice[:, k : k + RING]
        viable &= total <= (k + 1) * bits // RING
    out = np.full(len(diff), -1, np.int16)
    rows = np.flatnonzero(viable.any(1))
    full = parts[rows].sum(1, dtype=np.int16)
    out[rows[full <= bits]] = full[full <= bits]
    return out


def _proposed(bits: int, similarity: Fraction, most: int = 1 << 20):
    """Rows (key, pair, node, part, n, fp) sorted by (key, pair): of the pairs of nodes that share
    both, of different parts, like size and near fingerprints, a forest of the nearest."""
    p, q = similarity.numerator, similarity.denominator

    def links(key, pair, node, part, n, fp):
        run = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
        at, off, found, held = np.arange(len(key)), 1, [], 0
        while True:
            at = at[at + off < len(key)]
            at = at[run[at] == run[at + off]]
            if not len(at):
                break
            for lo in range(0, len(at), 1 << 18):
                i = at[lo : lo + (1 << 18)]
                j = i + off
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                i = i[(node[i] != node[j]) & (part[i] != part[j]) & (q * small >= p * large)]
                diff = fp[i] ^ fp[i + off]
                far = _near(diff, bits)
                coarse = (far < 0) & (np.minimum(n[i], n[i + off]) < SMALL)
                far[coarse] = np.bitwise_count(diff[coarse]).sum(1, dtype=np.int16)
                i, far = i[far >= 0], far[far >= 0]
                found.append((np.maximum(node[i], node[i + off]), np.minimum(node[i], node[i + off]), far))
                held += len(i)
            if held > most:
                found = [_spanning(*map(np.concatenate, zip(*found, strict=True)))]
                held = len(found[0][0])
            off += 1
        if found:
            yield _spanning(*map(np.concatenate, zip(*found, strict=True)))

    def run(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(k).to_numpy() for k in range(5)] + [np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, WORDS)]
                now[4] = now[4].astype(np.int64)
                now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
                cuts = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
                end = int(cuts[-1]) if len(cuts) else 0
                rest = [x[end:] for x in now]
                now = [x[:end] for x in now]
            else:
                now = rest
            if now is not None and len(now[0]) > 1:
                for a, b, _ in links(*now):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are as similar as asked, counted exactly."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = written(shingle_sets(texts.join(ids, "doc_id", "left_semi"), shingle).distinct(), "near-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("own")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("other")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("own", "other")).alias("i"), (F.size("own") + F.size("other")).alias("n"))
    return counted.filter((F.col("i") * similarity.denominator) >= (F.col("n") - F.col("i")) * similarity.numerator).select("a", "b")


def _settled(bits: int, similarity: Fraction):
    """Rows (group, pair, block, node, part, hashes, fp) sorted by (group, pair): links of one piece of work
    between nodes of different parts, each counted exactly. Pairs that a link has joined by then
    are left out, so a piece gives a forest and never its pairs."""
    p, q = similarity.numerator, similarity.denominator

    def links(block, node, part, hashes, fp):
        n = np.fromiter(map(len, hashes), np.int64, len(hashes))
        ends = np.cumsum(n)
        every = np.concatenate(hashes).view(np.uint64) if len(hashes) else np.zeros(0, np.uint64)
        label = np.unique(part, return_inverse=True)[1]
        within = len(np.unique(block)) == 1
        for i in range(len(node) - 1):
            j = np.arange(i + 1, len(node))
            j = j[(label[j] != label[i]) & (within | (block[j] != block[i])) & (q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j]))]
            if not len(j) or not n[i]:
                continue
            j = j[(_near(fp[j] ^ fp[i], bits) >= 0) | (np.minimum(n[i], n[j]) < SMALL)]
            if not len(j):
                continue
            own = every[ends[i] - n[i] : ends[i]]
            at = np.repeat(ends[j] - n[j] - (np.cumsum(n[j]) - n[j]), n[j]) + np.arange(int(n[j].sum()))
            other = every[at]
            shared = np.add.reduceat(_among(other, own).astype(np.int64), np.cumsum(n[j]) - n[j])
            for k in j[shared * q >= (n[i] + n[j] - shared) * p].tolist():
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    yield int(max(node[i], node[k])), int(min(node[i], node[k]))

    def run(batches):
        at, rows = None, []

        def emit():
            block, node, part = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            fp = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(-1, WORDS)
            found = list(links(block, node, part, [r[3] for r in rows], fp))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            block, node, part, fp = (batch.column(k).to_pylist() for k in (2, 3, 4, 6))
            sets = batch.column(5)
            for k, key in enumerate(keys):
                if key != at:
                    if len(rows) > 1:
                        yield emit()
                    at, rows = key, []
                rows.append((block[k], node[k], part[k], sets[k].values.to_numpy(), fp[k]))
        if len(rows) > 1:
            yield emit()

    return run


def _links_across(cross: DataFrame, nodes: DataFrame, parts: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction, bits: int, block: int, block_shingles: int) -> DataFrame:
    """Links (a, b) between nodes of different parts among those that the proposals ``cross`` bring
    together. Each group of proposals is dealt out as pairs of blocks of bounded size, to which a
    node's set goes once: no row is made of a pair."""
    groups = components(cross).withColumnRenamed("component", "group")
    members = groups.join(nodes.select("node", "same", "n", "fp"), "node").join(parts, "node", "left").select("group", "node", "same", "n", "fp", F.coalesce("component", "node").alias("part"))
    members = written(members, "near-members")
    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).alias("g"))
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = _marked_sets(texts.join(wanted, "doc_id", "left_semi"), shingle).dropDuplicates(["doc_id", "same"])
    placed = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g"))).join(sets.withColumnRenamed("doc_id", "node"), ["node", "same"])
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    pair = F.least("block", "other") * (1 << 31) + F.greatest("block", "other")
    rows = dealt.select("group", pair.alias("pair"), "block", "node", "part", "hashes", "fp")
    count = shuffle_partitions(texts.sparkSession)
    return rows.repartition(count, "group", "pair").sortWithinPartitions("group", "pair").mapInArrow(_settled(bits, similarity), "a long, b long").distinct()


def _marked_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, same, hashes) of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), same, _lists(sets)], names=["doc_id", "same", "hashes"])

    return texts.mapInArrow(run, "doc_id long, same binary, hashes array<long>")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bits: int = 80, block: int = 4096, settle_block: int = 512, settle_shingles: int = 1 << 20) -> DataFrame:
    """(doc_id, component_id) of the documents that are not the least of their group.

    Documents are linked whose sets of word shingles have a Jaccard similarity of at least
    ``similarity``. Candidates share a shingle among the first of their sets, which no such pair
    fails to, and have fingerprints of WORDS * 64 bits at most ``bits`` apart (at 0.8 they differ in
    39 bits, give or take 6); each link is settled by counting shingles. A first round settles a
    spanning forest of the nearest candidates, so that groups of copies take links in proportion
    to their size. A second one brings together what still has candidates in another group and
    settles them in pieces of two blocks of at most about ``settle_block`` documents and
    ``settle_shingles`` shingles, without a row for each pair. Wordless texts are alike. Rows of one
    id are linked like one document, and stay or go together. Null ids are left alone; empty
    table: no rows.
    """
    ratio = Fraction(str(similarity))
    texts = id_and_text(docs, id_col, text_col).filter("doc_id is not null")
    marks = written(_marks(texts, shingle, ratio), "near-marks")
    nodes = written(marks.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")), "near-nodes")
    dealt = _dealt(nodes.select("node", F.explode("prefix").alias("key")), "node", block)
    shared = written(dealt.join(nodes.select("node", "n", "fp"), "node").select("key", "pair", "node", F.col("node").alias("part"), "n", "fp"), "near-shared")
    count = shuffle_partitions(docs.sparkSession)

    def proposed(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(count, "key", "pair").sortWithinPartitions("key", "pair")
        return written(dealt.mapInArrow(_proposed(bits, ratio), "a long, b long").distinct(), "near-proposed")

    first = written(_similar(proposed(shared), texts, shingle, ratio), "near-links")
    parts = components(first)
    again = shared.drop("part").join(parts, "node", "left").select("key", "pair", "node", F.coalesce("component", "node").alias("part"), "n", "fp")
    second = _links_across(proposed(again), nodes, parts, texts, shingle, ratio, bits, settle_block, settle_shingles)
    parts = components(first.unionByName(second))
    least = nodes.select("same", "node").join(parts, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    return marks.select("doc_id", "same").join(least, "same").filter("doc_id <> component_id").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns kept, without those of near_duplicates: of each group the rows with
    the least id stay, also where several rows have it; ties of similarity count as similar. Rows with a
    null id stay. Empty table: no rows."""
    id_col = options.get("id_col", "doc_id")
    gone = near_duplicates(docs, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
