"""Jaccard join of word shingles by T-occurrence search.

Documents with the same set of shingles are one record. Two records link when they share at least
T = ceil(s * (n1 + n2) / (1 + s)) shingles, and so at least ceil(s * n) of either one's n.

1. List lengths. How many documents hold a shingle is counted over all of them, by hash in a table of
   fixed size (bincount in each task, summed by ranges); it orders each record's lists.
2. First groups. Records with the same least hash of their set, by either of two orders of the hashes,
   are searched in pieces of bounded size (as in 5); what these links join is a group.
3. Records that may link. A record's n - ceil(s * n) + 1 + c shortest lists are looked at: a link needs
   entries in more than c of them. So each record's lists that hold another group than its own are
   counted first, which takes one number for an entry at most; records with too few are done. Most
   share a line or passage with many others, whose blocks they'd all meet.
4. Blocks. The groups of those left go to index blocks of bounded size, large ones above small ones. A
   record is sent as a query to every block above its own that has enough of its lists from other
   groups; links within a group are known, so a group of m near copies isn't sent to its own blocks.
5. Search. A block's records are turned into inverted lists. For each query the longest lists are set
   aside (DivideSkip), the short ones are merged, and what they hold often enough is looked for in the long
   ones by binary search. The merge of the sorted lists is numpy's stable sort, which merges runs,
   in place of a heap of Python objects. Records that already belong together aren't
   counted again, so a block gives a spanning forest of its links and not all pairs.
6. Components of the links of both rounds, least document first.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shuffle_partitions, written
from .graph import components
from .simhash import _lists, shingle_set
from .slots import mixed as rehashed

#: The table of list lengths has 2^LENGTH_BITS slots, 4 MB, and is summed in pieces of 2^RANGE_BITS.
LENGTH_BITS, RANGE_BITS = 20, 12
#: A map of 2^WANTED_BITS bits, 8 MB, tells most sets that no block asks for.
WANTED_BITS = 26
#: An index block has about so many records and shingles at most; queries of a block go in parts of so many.
RECORDS, SHINGLES, QUERIES = 1024, 1 << 20, 4096
#: Entries of short lists for which there is a shard, and that a task packs at a time.
SHARD, PACK = 1 << 21, 1 << 20
#: Second order of hashes: by their product with an odd number.
ORDER = np.uint64(0x9E3779B97F4A7C15)
#: The share of lists set aside falls with the longest one's length at this rate.
MU = 0.0085


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - LENGTH_BITS)).astype(np.int64)


def _lengths(shingle: int):
    """Of each task how many of its documents hold the shingles of a slot, by ranges of slots."""

    def run(batches):
        total = np.zeros(1 << LENGTH_BITS, np.int64)
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            total += np.bincount(_slot(np.concatenate([np.zeros(0, np.uint64), *sets])), minlength=len(total))
        ranges = total.reshape(-1, 1 << RANGE_BITS)
        used = np.flatnonzero(ranges.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([ranges[k].tobytes() for k in used], pa.binary())], names=["range", "counts"])

    return run


def _added(batches):
    """Rows (range, counts) sorted by range: one for each."""
    at, total = None, None

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["range", "counts"])

    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != at:
                if at is not None:
                    yield emit()
                at, total = k, np.zeros(1 << RANGE_BITS, np.int64)
            total += np.frombuffer(raw, np.int64)
    if at is not None:
        yield emit()


def list_lengths(texts: DataFrame, shingle: int) -> np.ndarray:
    """Documents by slot of their shingles; a slot is never less than any list of its own."""
    n = shuffle_partitions(texts.sparkSession)
    summed = texts.select("text").mapInArrow(_lengths(shingle), "range long, counts binary").repartition(n, "range").sortWithinPartitions("range").mapInArrow(_added, "range long, counts binary")
    out = np.zeros((1 << (LENGTH_BITS - RANGE_BITS), 1 << RANGE_BITS), np.uint32)
    for r in summed.toLocalIterator():  # 4 MB in all
        out[r.range] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()


def _least_shared(n, s: Fraction):
    return -(-s.numerator * n // s.denominator)


def _extra(n, s: Fraction):
    """Lists looked at beyond those without which no link can be."""
    return _least_shared(n, s) // 8


def _keys(x: np.ndarray) -> bytes:
    """48 bits of each hash, packed: entries that agree in them are taken for one list's."""
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (x >> np.uint64(48)).astype(np.uint16).tobytes()


def _keys_of(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) | (np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _whole(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def _marks(shared, shingle: int, s: Fraction):
    """(doc_id, same, n, low, other, whole, short) of (doc_id, text): a digest of the set, its size, its
    least hash in either order, a hash of the text and the shortest lists, packed."""

    def run(batches):
        lengths = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(t, shingle) for t in texts]
            short = [x[np.lexsort((x, lengths[_slot(x)]))][: len(x) - _least_shared(len(x), s) + 1 + _extra(len(x), s)] for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64())]
                + [pa.array([int(x[0]) >> 1 if len(x) else None for x in sets], pa.int64()), pa.array([int((x * ORDER).min()) >> 1 if len(x) else None for x in sets], pa.int64())]
                + [pa.array([_whole(t) for t in texts], pa.int64()), pa.array([_keys(x) for x in short], pa.binary())],
                names=["doc_id", "same", "n", "low", "other", "whole", "short"],
            )

    return run


def _spread(key: np.ndarray) -> np.ndarray:
    """Keys of 48 bits in the places that _keys takes them from."""
    return (key & np.uint64(0xFFFFFFFF)) | (key >> np.uint64(32) << np.uint64(48))


def _entries(shards: int):
    """Rows (node, block, component, short): entries of the lists, packed by shard of the shingle's hash."""

    def run(batches):
        parts, held = [], 0

        def emit():
            nonlocal parts, held
            parts.sort(key=lambda p: p[0])
            key = np.concatenate([p[3] for p in parts])
            node, block, group = (np.repeat([p[k] for p in parts], [len(p[3]) for p in parts]).astype(np.int64) for k in range(3))
            shard = (key % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            own, lo = np.unique(shard[order], return_index=True)
            cuts = [*lo.tolist(), len(order)]
            parts, held = [], 0
            for k in range(0, len(own), 256):
                rows = [order[a:b] for a, b in zip(cuts[k : k + 256], cuts[k + 1 : k + 257], strict=False)]
                columns = [[_keys(_spread(key[r])) for r in rows], [np.diff(node[r], prepend=0).tobytes() for r in rows], [block[r].tobytes() for r in rows], [(group[r] - node[r]).tobytes() for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 256], pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], names=["shard", "key", "node", "block", "apart"])

        for batch in batches:
            for node, block, group, short in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                parts.append((node, block, group, _keys_of(short)))
                held += len(parts[-1][3])
                if held >= PACK:
                    yield from emit()
        if parts:
            yield from emit()

    return run


def _wanted(key: np.ndarray, node: np.ndarray, block: np.ndarray, group: np.ndarray, most: int = 1 << 22):
    """(block, node, indexed) of all lists: entries of a list that meet another group in their block or
    from one below are indexed there; entries from below are its queries, unless all that the block
    has of the list is of their own group."""
    order = np.lexsort((block, key))
    key, node, block, group = key[order], node[order], block[order], group[order]
    new_list = np.r_[True, key[1:] != key[:-1]]
    lo = np.flatnonzero(new_list | np.r_[True, block[1:] != block[:-1]])
    hi = np.r_[lo[1:], len(key)]
    start = np.flatnonzero(new_list)[np.cumsum(new_list)[lo] - 1]
    change = ~new_list & np.r_[False, group[1:] != group[:-1]]
    changes = np.cumsum(change)
    run = np.maximum.accumulate(np.where(new_list | change, np.arange(len(key)), 0))  # where the entries of one group that end here begin
    kept = changes[hi - 1] > changes[start]
    lo, hi, start = lo[kept], hi[kept], start[kept]
    mixed = changes[hi - 1] > changes[lo]
    for role, first, last in ((1, lo, hi), (0, start, np.where(mixed, lo, run[lo]))):
        size = last - first
        ends = np.cumsum(size)
        k = 0
        while k < len(size):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most)))
            n = size[k:stop]
            at = np.repeat(first[k:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            home = np.repeat(np.arange(k, stop), n)
            if role == 0:
                other = mixed[home] | (group[at] != group[lo[home]])
                at, home = at[other], home[other]
            yield block[lo[home]], node[at], role
            k = stop


def _counted(block: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (block, node) with the sums of n."""
    order = np.lexsort((node, block))
    block, node, n = block[order], node[order], n[order]
    first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (node[1:] != node[:-1])]) if len(block) else np.zeros(0, np.int64)
    return block[first], node[first], np.add.reduceat(n, first) if len(first) else n


def _needs(ranges: int):
    """Rows (shard, key, node, block, apart) sorted by shard: in how many of its lists each record meets
    other groups in a block, and whether it is indexed there; added up over a task's shards, packed
    by ranges of the records' hashes."""

    def run(batches):
        found: dict[int, list] = {0: [], 1: []}
        most = 1 << 22

        def counted(role):
            found[role] = [_counted(*(np.concatenate(x) for x in zip(*found[role], strict=True)))]
            return found[role][0]

        def emit(role):
            block, node, n = counted(role)
            found[role] = []
            own = (rehashed(node.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            used, lo = np.unique(own[order], return_index=True)
            cuts = [*lo.tolist(), len(order)]
            for k in range(0, len(used), 256):
                rows = [order[a:b] for a, b in zip(cuts[k : k + 256], cuts[k + 1 : k + 257], strict=False)]
                columns = [[block[r].tobytes() for r in rows], [np.diff(node[r], prepend=0).tobytes() for r in rows], [n[r].astype(np.int32).tobytes() for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(used[k : k + 256], pa.int64()), pa.array(np.full(len(rows), role, np.int32)), *(pa.array(x, pa.binary()) for x in columns)], names=["range", "role", "block", "node", "lists"])

        def of(parts):
            for block, node, role in _wanted(*(np.concatenate([p[k] for p in parts]) for k in range(4))):
                found[role].append(_counted(block, node, np.ones(len(block), np.int64)))
                if sum(len(b) for b, *_ in found[role]) > most and len(counted(role)[0]) > most // 2:
                    yield from emit(role)

        at, parts = None, []
        for batch in batches:
            for shard, key, node, block, apart in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if parts:
                        yield from of(parts)
                    at, parts = shard, []
                node = np.cumsum(np.frombuffer(node, np.int64))
                parts.append((_keys_of(key), node, np.frombuffer(block, np.int64), np.frombuffer(apart, np.int64) + node))
        if parts:
            yield from of(parts)
        for role in found:
            if found[role]:
                yield from emit(role)

    return run


def _needs_added(batches):
    """Rows (range, role, block, node, lists) of _needs sorted by range: (block, node, role, lists), one
    for each block and record."""
    at, parts = None, []

    def emit():
        block, node, lists, role = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, record, total = _counted(block, node, lists)
        indexed = _counted(block, node, role)[2] > 0
        for k in range(0, len(own), 1 << 16):
            cut = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(own[cut], pa.int64()), pa.array(record[cut], pa.int64()), pa.array(indexed[cut].astype(np.int32)), pa.array(total[cut], pa.int64())], names=["block", "node", "role", "lists"])

    for batch in batches:
        for key, role, block, node, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                if parts:
                    yield from emit()
                at, parts = key, []
            block = np.frombuffer(block, np.int64)
            parts.append((block, np.cumsum(np.frombuffer(node, np.int64)), np.frombuffer(lists, np.int32).astype(np.int64), np.full(len(block), role)))
    if parts:
        yield from emit()


def _bits(batches):
    """Rows (range, slot) sorted by range: the range's part of the map of wanted sets."""
    at, own = None, None
    for batch in batches:
        ranges, slots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k in np.unique(ranges).tolist():
            if k != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["range", "bits"])
                at, own = k, np.zeros(1 << (WANTED_BITS - 6), bool)
            own[slots[ranges == k] & (len(own) - 1)] = True
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["range", "bits"])


def _wanted_map(texts: DataFrame) -> bytes:
    """A bit for the hash (whole) of the text of each record that some block needs."""
    slots = texts.select(F.shiftright("whole", 63 - WANTED_BITS).alias("slot")).distinct().select(F.shiftright("slot", WANTED_BITS - 6).alias("range"), "slot")
    out = bytearray(1 << (WANTED_BITS - 3))
    size = len(out) >> 6
    for r in slots.repartition(64, "range").sortWithinPartitions("range").mapInArrow(_bits, "range long, bits binary").toLocalIterator():  # 8 MB in all
        out[r.range * size : (r.range + 1) * size] = r.bits
    return bytes(out)


def _marked(shared):
    """Rows (same, whole, short) whose bit in the map of wanted sets is set: (same, short)."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column(1).to_numpy() >> (63 - WANTED_BITS)])).select(["same", "short"])

    return run


def _sets(shared, shingle: int):
    """(same, hashes) of the texts that may be wanted; of copies in a run of texts one."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            out = {}
            for text in batch.column(0).to_pylist():
                if bits[_whole(text) >> (63 - WANTED_BITS)]:
                    x = shingle_set(text, shingle)
                    out[xxhash.xxh3_128_digest(x.tobytes())] = x
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), _lists(list(out.values()))], names=["same", "hashes"])

    return run


class Lists:
    """Inverted lists of a block's records, and the groups that links have made of them."""

    def __init__(self, sets: list[np.ndarray], s: Fraction, group: list[int] | None = None):
        self.s, self.n = s, np.fromiter(map(len, sets), np.int64, len(sets))
        every, record = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(every, kind="stable")  # within a list by record
        self.record = record[order]
        self.keys, self.lo = np.unique(every[order], return_index=True)
        self.hi = np.r_[self.lo[1:], len(every)]
        self.group = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]

    def search(self, x: np.ndarray, own: int | None = None) -> np.ndarray:
        """Records as similar to the set x as asked, but for those in the group of ``own``."""
        s, none = self.s, np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        at = at[self.keys[at] == x]
        least = _least_shared(len(x), s)
        if len(at) < least:
            return none
        size = self.hi[at] - self.lo[at]
        at = at[np.argsort(size, kind="stable")]
        aside = min(least - 1, int(least / (MU * math.log2(max(2, int(size.max()))) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        merged = np.concatenate([self.record[a:b] for a, b in zip(self.lo[short].tolist(), self.hi[short].tolist(), strict=True)])
        merged.sort(kind="stable")
        new = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        found, shared = merged[new], np.diff(np.r_[new, len(merged)])
        good = (shared >= least - aside) & (self.n[found] * s.denominator >= len(x) * s.numerator) & (len(x) * s.denominator >= self.n[found] * s.numerator)
        if own is not None:
            good &= self.group[found] != self.group[own]
        found, shared = found[good], shared[good]
        if not len(found):
            return none
        for a, b in zip(self.lo[long].tolist(), self.hi[long].tolist(), strict=True):
            entries = self.record[a:b]
            shared += entries[np.minimum(np.searchsorted(entries, found), b - a - 1)] == found
        return found[shared * s.denominator >= (len(x) + self.n[found] - shared) * s.numerator]

    def drawn(self, found: np.ndarray, own: int | None = None) -> list[int]:
        """One of the found records of each group; all their groups become one."""
        groups, first = np.unique(self.group[found], return_index=True)
        if len(groups) > 1 or own is not None and len(groups):
            joined = np.r_[groups, self.group[own]] if own is not None else groups
            self.group[np.isin(self.group, joined)] = joined.min()
        return found[first].tolist()


def _searched(s: Fraction):
    """Rows (block, part, role, node, component, hashes) sorted by (block, part, role falling): links of
    each part's queries, and in part 0 of the indexed records, with the indexed. Records of one
    component are linked already."""

    def run(batches):
        at, nodes, groups, sets, lists, member = None, [], [], [], None, {}
        a, b = [], []

        def indexed():
            nonlocal lists, member
            lists, member = Lists(sets, s, groups), {g: k for k, g in enumerate(groups)}
            for k in range(1, len(nodes)) if at[1] == 0 else ():
                if not lists.group.min() < lists.group.max():
                    break
                for j in lists.drawn(lists.search(sets[k], k), k):
                    a.append(nodes[k])
                    b.append(nodes[j])

        for batch in batches:
            hashes = batch.column(5)
            values, ends = hashes.values.to_numpy().view(np.uint64), hashes.offsets.to_numpy()
            for k, (block, part, role, node, group) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                x = values[ends[k] : ends[k + 1]]
                if (block, part) != at:
                    if lists is None and nodes:
                        indexed()
                    at, nodes, groups, sets, lists = (block, part), [], [], [], None
                if role:
                    nodes.append(node)
                    groups.append(group)
                    sets.append(x)
                    continue
                if not nodes:  # none of the block's own shares enough
                    continue
                if lists is None:
                    indexed()
                own = member.get(group)
                for j in lists.drawn(lists.search(x, own), own):
                    a.append(node)
                    b.append(nodes[j])
                    member.setdefault(group, j)
            if len(a) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a.clear(), b.clear()
        if lists is None and nodes:
            indexed()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A document's set is that of its distinct shingles of words, A-Z lower-cased; fewer words than a
    shingle are one, wordless and null texts have none and are linked with nothing, their
    component_id being their own id. Documents link when their sets' Jaccard similarity is at least
    ``similarity``, ties included; component_id is the least doc_id reachable. Shingles are known by
    64-bit hashes, whole texts count however long. Repeated rows are like any other copies; rows
    with a null doc_id link but never name a component (null if all its ids are). Empty table: no
    rows; other columns are ignored whatever their names.
    """
    s = Fraction(str(similarity))
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    lengths = spark.sparkContext.broadcast(list_lengths(texts, shingle).tobytes())  # of fixed size
    marks = written(texts.mapInArrow(_marks(lengths, shingle, s), "doc_id long, same binary, n long, low long, other long, whole long, short binary"), "jaccard-marks")
    records = marks.filter("n > 0").groupBy("same").agg(F.min("doc_id").alias("least"), F.min("whole").alias("whole"), *[F.first(c).alias(c) for c in ("n", "low", "other")])
    nodes = written(records.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    cut = F.greatest(F.ceil(F.count("*") / RECORDS), F.ceil(F.sum("n") / SHINGLES)).alias("cut")

    def shared_of(n):
        return F.ceil(F.lit(s.numerator) * n / F.lit(s.denominator))

    entries = nodes.agg(F.sum(F.col("n") - shared_of(F.col("n")) + 1 + F.floor(shared_of(F.col("n")) / 8))).first()[0]
    shards = int(max(n, (entries or 0) // SHARD))

    def links(pieces):
        """Links found in pieces (block, part), rows (node, block, part, role, component). A set is sent once
        to be found among its copies, and once to each piece."""
        wanted = written(nodes.select("node", "same", "whole").join(pieces.select("node", "block", "part", "role", "component"), "node"), "jaccard-wanted")
        shared = spark.sparkContext.broadcast(_wanted_map(wanted))  # of fixed size
        sets = texts.select("text").mapInArrow(_sets(shared, shingle), "same binary, hashes array<long>").groupBy("same").agg(F.first("hashes").alias("hashes"))
        rows = wanted.join(sets, "same").select("block", "part", "role", "node", "component", "hashes").repartition(n, "block", "part").sortWithinPartitions("block", "part", F.desc("role"), "node")
        return written(rows.mapInArrow(_searched(s), "a long, b long"), "jaccard-links")

    def met(lists, placed):
        """(block, node, role, lists) with enough lists, of rows (same, short) and (same, node, n, block, component)."""
        short = lists.groupBy("same").agg(F.first("short").alias("short")).join(placed, "same").select("node", "block", "component", "short")
        dealt = short.mapInArrow(_entries(shards), "shard long, key binary, node binary, block binary, apart binary").repartition(n, "shard").sortWithinPartitions("shard")
        found = dealt.mapInArrow(_needs(n), "range long, role int, block binary, node binary, lists binary").repartition(n, "range").sortWithinPartitions("range")
        found = found.mapInArrow(_needs_added, "block long, node long, role int, lists long")
        # one more than the lesser of both records' extra lists, and the other has at least s * n shingles
        enough = F.floor(shared_of(shared_of(F.col("n"))) / 8) + 1
        return found.join(placed.select("node", "n", "component"), "node").filter(F.col("lists") >= enough).select("block", "node", "component", "role")

    # records that share a least hash; of pieces with the same records one
    keyed = nodes.select("node", "n", F.posexplode(F.array("low", "other")).alias("kind", "key"))
    keys = keyed.groupBy("kind", "key").agg(cut, F.count("*").alias("records"), F.min("node").alias("label"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("records > 1")
    keys = keys.groupBy("who", "records").agg(F.min(F.struct("kind", "key", "cut", "label")).alias("one")).select("one.*")
    close = keyed.join(keys, ["kind", "key"]).select("node", F.xxhash64("kind", "key").alias("bucket"), F.xxhash64("kind", "key", F.pmod(F.xxhash64("node", "kind"), "cut")).alias("block"), "label")
    close = written(close, "jaccard-close")
    first = components(links(close.select("node", "block", F.lit(0).cast("long").alias("part"), F.lit(1).alias("role"), F.col("node").alias("component"))))

    # all others that may be linked, between the groups of these: first the records that have enough lists
    # in common with other groups at all
    members = first.groupBy("component").agg(F.count("*").alias("members"))
    nearest = close.groupBy("node").agg(F.min("label").alias("label"))
    nearest = close.select("node", "bucket").join(nearest, "node").groupBy("bucket").agg(F.min("label").alias("label"))
    nearest = close.select("node", "bucket").join(nearest, "bucket").groupBy("node").agg(F.min("label").alias("label"))
    groups = nodes.select("node", "same", "whole", "n", "low").join(first.join(members, "component"), "node", "left").join(nearest, "node", "left")
    groups = groups.select("node", "same", "whole", "n", F.coalesce("component", "node").alias("component"), F.when(F.col("members") > RECORDS // 4, F.col("component")).alias("large"), F.coalesce("label", "low").alias("label"))
    groups = written(groups, "jaccard-groups")
    lists = marks.filter("n > 0").select("same", "whole", "short")
    asked = met(lists.drop("whole"), groups.select("same", "node", "n", F.lit(0).cast("long").alias("block"), "component"))
    asked = written(groups.join(asked.select("node"), "node"), "jaccard-asked")

    # then their blocks. Large groups have homes of their own; small ones and single records are placed with
    # what shares a least hash with them, in two steps
    homes = F.lit(1 + 16 * asked.count() // RECORDS)
    home = F.when(F.col("large").isNull(), F.pmod(F.xxhash64("label"), homes)).otherwise(homes + F.pmod(F.xxhash64("large"), homes))
    placed = asked.select("same", "node", "n", "component", home.cast("long").alias("home"))
    placed = placed.join(placed.groupBy("home").agg(cut), "home").select("same", "node", "n", (F.col("home") * (1 << 32) + F.pmod(F.xxhash64("node"), "cut")).alias("block"), "component")
    shared = spark.sparkContext.broadcast(_wanted_map(asked))  # of fixed size
    needs = written(met(lists.mapInArrow(_marked(shared), "same binary, short binary"), placed), "jaccard-needs")
    parts = needs.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("role") == 0, 1)) / QUERIES)).alias("parts"))
    own = F.when(F.col("role") == 1, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), "parts")))
    found = links(needs.join(parts, "block").select("node", "block", F.explode(own).alias("part"), "role", "component"))
    named = components(found.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    grouped = nodes.select("same", "node", "least").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "component").select("same", "component_id")
    return marks.select("doc_id", "same", F.col("n").alias("n_shingles")).join(classes, "same", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
