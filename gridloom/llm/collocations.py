"""Phrase collocations: counts of word n-grams by minimal perfect hashing.

1. Bounds. Every task counts the words and pairs of its texts by hash, in packed arrays; the sum of a hash
   is a bound that none of its phrases can exceed. Hashes with enough set a bit of a map of fixed
   size. A second pass does so for the triples whose pairs have their bits.
2. Candidates. A third pass keeps the phrases that have their bits and whose parts do (Apriori: a phrase is
   no more frequent than its parts, and the map never lacks a frequent one), with their counts in each
   chunk of text, dealt out by a hash to blocks of bounded text.
3. Index and counts. Phrases whose own hash isn't seen often enough in their block go too (a bound once
   more). The others get slots by a minimal perfect hash; the whole phrases are stored in the order of
   their slots, and every lookup compares them. Each chunk's phrases are bincounted by slot, and the
   arrays summed up in a tree.
4. Cuts. Blocks ask each other for the counts of the parts of their phrases, once for each block that
   asks; the answers are read by slot. What is asked for also tells a phrase of the longer ones
   that hold it.

Rows are packed arrays throughout, of a chunk or a block; a word that is in every text is one entry
of each chunk.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .slots import StoredKeys, counted, mixed, packed, uncounted, unpacked

#: Bits of the Apriori map, 8 MB, and how many of them the low hash of a shard keeps.
MAP_BITS = 26
#: A chunk is at most about so many bytes of text, and a long text goes in slices of as many.
CHUNK, SLICE = 5 << 20, 1 << 20
#: Bytes of text for which there is a block.
BLOCK_TEXT = 64 << 20
_BREAK, _ID = 1, 21
_FIXED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def _slices(raw: bytes):
    """The text in slices that end at a separator."""
    lo = 0
    while lo < len(raw):
        hi = lo + SLICE
        if hi < len(raw):
            hi = max(raw.rfind(b" ", lo, hi), raw.rfind(b"\n", lo, hi)) + 1
            if hi <= lo:  # one word longer than a slice
                ends = [p for p in (raw.find(b" ", lo + SLICE), raw.find(b"\n", lo + SLICE)) if p >= 0]
                hi = min(ends) + 1 if ends else len(raw)
        yield raw[lo:hi]
        lo = hi


def _tail(words: list[bytes]) -> list[bytes]:
    """The last two words after the last break."""
    out: list[bytes] = []
    for w in reversed(words):
        if w == b"\n" or len(out) == 2:
            break
        if w:
            out.append(w)
    return out[::-1]


class _Chunk:
    """Word numbers of texts by language. 0 is no word, 1 a break between pieces."""

    def __init__(self):
        numbers = count()
        self.ids: dict[bytes, int] = defaultdict(numbers.__next__)
        self.ids[b""], self.ids[b"\n"]
        self.rows: dict[str, list] = defaultdict(list)
        self.held = 0

    def add(self, lang: str, part: bytes, carried: list[bytes]) -> list[bytes]:
        """carried: words of the slice before whose phrases may go on here; gives those for the next."""
        words = part.replace(b"\n", b" \n ").split(b" ")
        at = np.fromiter(map(self.ids.__getitem__, carried + words), np.int32, len(carried) + len(words))
        fresh = np.arange(len(at)) >= len(carried)
        fresh = fresh[at > 0]
        at = at[at > 0]
        self.rows[lang].append((at, fresh))
        self.held += len(part)
        return _tail(carried + words)

    def grams(self, lang: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(codes, counts) of the words, pairs and triples."""
        stop = (np.array([_BREAK], np.int32), np.zeros(1, bool))
        at, fresh = (np.concatenate(x) for x in zip(*(y for r in self.rows[lang] for y in (r, stop)), strict=True))
        at, word, out = at.astype(np.int64), at > _BREAK, []
        code, good = at, word
        for n in range(1, 4):
            if n > 1:
                code = (code[:-1] << _ID) | at[n - 1 :]
                good = good[:-1] & word[n - 1 :]
            out.append(np.unique(code[good & fresh[n - 1 :]], return_counts=True))
        return out

    def full(self) -> bool:
        return self.held >= CHUNK or len(self.ids) > 1 << (_ID - 2)


def _chunks(batches):
    """Chunks of the rows (lang, text)."""
    chunk = _Chunk()
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            carried: list[bytes] = []
            for part in _slices(raw.translate(_FIXED)):
                carried = chunk.add(lang, part, carried)
                if chunk.full():
                    yield chunk
                    chunk = _Chunk()
    if chunk.rows:
        yield chunk


def _parts(codes: np.ndarray, n: int) -> list[np.ndarray]:
    mask = (1 << _ID) - 1
    return [(codes >> (_ID * (n - 1 - k))) & mask for k in range(n)]


def _hashed(ids: list[np.ndarray], words: np.ndarray, lang: str) -> np.ndarray:
    """64-bit hashes of phrases from those of their words."""
    h = np.full(len(ids[0]), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for x in ids:
        h = h * np.uint64(0xD1342543DE82EF95) + words[x]
    return mixed(h)


def _word_hashes(chunk: _Chunk) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chunk.ids), np.uint64, len(chunk.ids))


class _Map:
    """The Apriori map: a bit for each hash that may be frequent."""

    def __init__(self, raw: bytes):
        self.bits = np.frombuffer(raw, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _hashed_grams(chunk: _Chunk, sizes, seen: _Map | None, own: bool):
    """(language, words of the phrases, counts, hashes) of each size: of phrases whose shorter parts may all
    be frequent, and they themselves if ``own``."""
    words = _word_hashes(chunk)
    for lang in chunk.rows:
        for n, (codes, c) in enumerate(chunk.grams(lang), 1):
            if n not in sizes:
                continue
            ids = _parts(codes, n)
            if seen is not None:
                for k in range(n - 1) if n > 2 else ():
                    good = seen(_hashed(ids[k : k + 2], words, lang))
                    ids, c = [x[good] for x in ids], c[good]
            h = _hashed(ids, words, lang)
            if own:
                good = seen(h)
                ids, c, h = [x[good] for x in ids], c[good], h[good]
            yield lang, ids, c, h


def _bound_rows(shard_bits: int, sizes, shared):
    """Of each chunk the counts of its phrases of some sizes, by shard of their hashes."""

    def run(batches):
        seen = _Map(shared.value) if shared is not None else None
        for chunk in _chunks(batches):
            hashes, counts = [], []
            for _, _, c, h in _hashed_grams(chunk, sizes, seen, False):
                hashes.append(h)
                counts.append(c)
            h, c = np.concatenate(hashes), np.concatenate(counts)
            order = np.argsort(h)
            h, c = h[order], np.minimum(c[order], 0xFFFFFFFF).astype(np.uint32)
            cuts = np.searchsorted(h, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)).tolist() + [len(h)]
            low = (h << np.uint64(shard_bits) >> np.uint64(32)).astype(np.uint32)
            own = [s for s in range(1 << shard_bits) if cuts[s + 1] > cuts[s]]
            for k in range(0, len(own), 64):
                some = own[k : k + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([low[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary()), pa.array([c[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary())],
                    names=["shard", "h", "c"],
                )

    return run


def _by_block(batches, keys: int = 1):
    """Rows sorted by their first column(s): (key, iterator over the other columns) one after another."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _map_of(least: int, shard_bits: int):
    """Sums the counts of a shard's hashes; its part of the map."""
    bits = MAP_BITS - shard_bits

    def run(batches):
        for (shard,), rows in _by_block(batches):
            h = np.concatenate([np.frombuffer(r[0], np.uint32) for r in rows])
            c = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows]).astype(np.int64)
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            often = h[first][np.add.reduceat(c, first) >= least]
            own = np.zeros(1 << bits, bool)
            own[often >> np.uint32(32 - bits)] = True
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["shard", "bits"])

    return run


def apriori_map(texts: DataFrame, least: int, sizes=(1, 2), shared=None) -> bytes:
    """A map of 2^MAP_BITS bits in which the hash of every phrase of these sizes that occurs ``least`` times
    has its bit; with another map, shared, those of shorter phrases stay in it, and phrases whose parts
    it lacks aren't counted."""
    n = shuffle_partitions(texts.sparkSession)
    shard_bits = min(MAP_BITS - 6, max(4, (4 * n - 1).bit_length()))
    dealt = texts.mapInArrow(_bound_rows(shard_bits, sizes, shared), "shard long, h binary, c binary").repartition(n, "shard").sortWithinPartitions("shard")
    size = 1 << (MAP_BITS - shard_bits - 3)
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8) if shared is None else np.frombuffer(shared.value, np.uint8).copy()
    for r in dealt.mapInArrow(_map_of(least, shard_bits), "shard long, bits binary").toLocalIterator():  # 8 MB in all
        out[r.shard * size : (r.shard + 1) * size] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


_GRAMS = "block long, chunk long, lang string, n long, grams binary"


def _key_hashes(keys: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys.to_pylist()), np.uint64, len(keys))


def _candidates(shared, blocks: int):
    """Of each chunk the phrases that may be frequent, with their counts, by block; and for each language a
    row with its number of words, as block -1."""

    def run(batches):
        seen = _Map(shared.value)
        chunk_id = TaskContext.get().partitionId() << 32
        for chunk in _chunks(batches):
            texts = pa.array(list(chunk.ids), pa.binary())
            counts, keys = [], []
            for lang, ids, c, _ in _hashed_grams(chunk, (1, 2, 3), seen, True):
                key = texts.take(pa.array(ids[0]))
                for x in ids[1:]:
                    key = pc.binary_join_element_wise(key, texts.take(pa.array(x)), b" ")
                keys.append(pc.binary_join_element_wise(key, pa.scalar(lang.encode(), pa.binary()), b"\n"))
                counts.append(c)
            totals = [(lang, sum(int((at > _BREAK)[fresh].sum()) for at, fresh in rows)) for lang, rows in chunk.rows.items()]
            key = pa.concat_arrays([k.cast(pa.binary()) for k in keys])
            c, block = np.concatenate(counts), (mixed(_key_hashes(key)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            present, first = np.unique(block[order], return_index=True)
            cuts = [*first.tolist(), len(order)]
            rows = [(-1, chunk_id, lang, n, None) for lang, n in totals]
            for b, lo, hi in zip(present.tolist(), cuts, cuts[1:], strict=False):
                own = order[lo:hi]
                rows.append((b, chunk_id, None, None, counted(key.take(pa.array(own)), c[own])))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(_GRAMS_SCHEMA.names, r, strict=True)) for r in rows[k : k + 64]], schema=_GRAMS_SCHEMA)
            chunk_id += 1

    return run


_GRAMS_SCHEMA = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("grams", pa.binary())])
_INDEX = "block long, sizes binary, bits binary, ends binary, data binary, counts binary"


def _counted(least: int):
    """Rows (block, grams) sorted by block: the phrases of a block that may be frequent, their slots and
    exact counts by slot. A block's rows are held as they came, compressed."""

    def joined(parts):
        return tuple(np.concatenate([p[k] for p in parts]) for k in (0, 2)), pa.concat_arrays([p[1] for p in parts])

    def bincounts(stored: StoredKeys, rows: list[bytes]) -> np.ndarray:
        """Sums of the chunks' counts by slot, two halves at a time."""
        if len(rows) > 1:
            return bincounts(stored, rows[: len(rows) // 2]) + bincounts(stored, rows[len(rows) // 2 :])
        keys, n = uncounted(rows[0])
        slot = stored(_key_hashes(keys), keys)
        return np.bincount(slot[slot >= 0], weights=n[slot >= 0], minlength=len(stored)).astype(np.int64)  # exact: a chunk has few words

    def emit(block, parts, rows):
        (h, n), keys = joined(parts)
        which = np.unique(h, return_inverse=True)[1]
        often = np.flatnonzero(np.bincount(which, weights=n)[which] >= least)
        stored = StoredKeys.of(h[often], keys.take(pa.array(often)))
        columns = (*stored.dump(), bincounts(stored, rows).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)], names=["block", "sizes", "bits", "ends", "data", "counts"])

    def run(batches):
        at, parts, rows, held = None, [], [], 0
        for batch in batches:
            for block, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    if parts:
                        yield emit(at, parts, rows)
                    at, parts, rows, held = block, [], [], 0
                keys, n = uncounted(grams)
                rows.append(grams)
                parts.append((_key_hashes(keys), keys, n))
                held += len(keys)
                if held > 1 << 20 and len(parts) > 1:  # copies are drawn together before more come
                    (h, n), keys = joined(parts)
                    table = pa.table({"h": h, "k": keys, "n": n}).group_by(["h", "k"]).aggregate([("n", "sum")])
                    parts = [(table["h"].to_numpy(), table["k"].combine_chunks(), table["n_sum"].to_numpy())]
                    held = len(parts[0][0]) // 2
        if parts:
            yield emit(at, parts, rows)

    return run


def _frequent(row, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[str, list[bytes]]]]:
    """Slots, counts and (language, words) of a block's frequent phrases."""
    ends, data, counts = row
    counts = np.frombuffer(counts, np.int64)
    slot = np.flatnonzero(counts >= least)
    phrases = []
    for key in unpacked(ends, data).take(pa.array(slot)).to_pylist():
        phrase, _, lang = key.partition(b"\n")
        phrases.append((lang, phrase.split(b" ")))
    return slot, counts[slot], phrases


def _asked(words: list[bytes]):
    """The parts that a phrase is cut into, and those held inside it, each once with its place."""
    if len(words) == 2:
        return [words[:1], words[1:]]
    return [words[:1], words[1:], words[:2], words[2:]]


_ASKS = "block long, kind int, asker long, place binary, f binary, h binary, ends binary, data binary"


def _asks(least: int, blocks: int):
    """Rows (block, ends, data, counts): what each block asks of the others."""

    def run(batches):
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, f, phrases = _frequent(row, least)
                keys, places, weights = [], [], []
                for i, (lang, words) in enumerate(phrases):
                    if len(words) > 1:
                        for k, part in enumerate(_asked(words)):
                            keys.append(b" ".join(part) + b"\n" + lang)
                            places.append(4 * i + k)
                            weights.append(int(f[i]) if len(words) == 3 and len(part) == 2 else 0)
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                to = (mixed(h) % np.uint64(blocks)).astype(np.int64)
                column, place, weight = pa.array(keys, pa.binary()), np.array(places, np.int64), np.array(weights, np.int64)
                for b in np.unique(to).tolist():
                    own = np.flatnonzero(to == b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int64()), pa.array([1], pa.int32()), pa.array([block], pa.int64())]
                        + [pa.array([x], pa.binary()) for x in (place[own].tobytes(), weight[own].tobytes(), h[own].tobytes(), *packed(column.take(pa.array(own))))],
                        names=["block", "kind", "asker", "place", "f", "h", "ends", "data"],
                    )

    return run


def _answers(batches):
    """Rows (block, kind, asker, a, b, h, ends, data) sorted by the first three; kind 0 is the block's index with its
    counts. Counts by place for those that ask, and for the block itself the most frequent longer
    phrase around each slot (place null)."""
    at, keys, counts, around = None, None, None, None

    def emit(block, place, values):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([place], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["block", "kind", "place", "values"])

    for batch in batches:
        for block, kind, asker, a, b, h, ends, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                if at is not None:
                    yield emit(at, None, around)
                keys, counts = StoredKeys.load(a, h, ends, data), np.frombuffer(b, np.int64)
                at, around = block, np.zeros(len(counts), np.int64)
            else:
                slot = keys(np.frombuffer(h, np.uint64), unpacked(ends, data))
                np.maximum.at(around, slot, np.frombuffer(b, np.int64))
                yield emit(asker, a, counts[slot])
    if at is not None:
        yield emit(at, None, around)


def _scored(least: int, inside: int, top: int):
    """Rows (block, kind, ends or place, data or values, counts) sorted by (block, kind): the best of each
    language of a block."""

    def best(row, answers, around):
        slot, f, phrases = _frequent(row, least)
        got = np.zeros(4 * len(phrases), np.int64)
        for place, values in answers:
            got[np.frombuffer(place, np.int64)] = np.frombuffer(values, np.int64)
        by_lang = defaultdict(list)
        for i, (lang, words) in enumerate(phrases):
            a = int(f[i])
            if len(words) == 1 or 100 * int(around[slot[i]]) >= inside * a:
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = map(int, got[4 * i + 2 * (k - 1) : 4 * i + 2 * k])
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            by_lang[lang].append((-score, -a, b" ".join(words), left, right))
        out = [(lang.decode(), w, -a, left, right, -s) for lang, rows in by_lang.items() for s, a, w, left, right in sorted(rows)[:top]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.string(), pa.binary(), *[pa.int64()] * 4), strict=True)], names=["lang", "phrase", "a", "l", "r", "score"])

    def run(batches):
        row, answers, around = None, [], None
        for batch in batches:
            for _, kind, x, y, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if row is not None:
                        yield best(row, answers, around)
                    row, answers, around = (x, y, counts), [], None
                elif x is None:
                    around = np.frombuffer(y, np.int64)
                else:
                    answers.append((x, y))
        if row is not None:
            yield best(row, answers, around)

    return run


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 and 3 words
    that occur at least ``least`` times.

    A-Z are lower-cased; texts are split at . , ; : ! ? and the line ends \\x0A-\\x0D, the pieces at
    spaces and tabs. n is the number of words of the language, a the occurrences of the phrase,
    l and r those of the two parts of its lowest-scoring cut (of equal ones the first), score
    floor(1000000 * a * a / (l * r)) in exact integers. Phrases inside a longer candidate with at
    least ``inside`` percent of their occurrences go. Ties are settled by a, then by the phrase's
    bytes, so ranks are unique. Null texts are empty, a null language is ``und``; ids aren't used, so repeated
    rows count as often as they come. Texts of any length are taken in slices. Without
    candidates, or rows, there are no rows; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").cast("binary").alias("text")).filter("octet_length(text) > 0")
    n = shuffle_partitions(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(n, -(-size // BLOCK_TEXT))
    shared = spark.sparkContext.broadcast(apriori_map(texts, least))  # of fixed size, as the next
    shared = spark.sparkContext.broadcast(apriori_map(texts, least, (3,), shared))
    grams = written(texts.mapInArrow(_candidates(shared, blocks), _GRAMS), "grams")
    found = grams.filter("block >= 0").select("block", "grams").repartition(n, "block").sortWithinPartitions("block")
    table = written(found.mapInArrow(_counted(least), _INDEX), "gram-counts")

    asks = table.select("block", "ends", "data", "counts").mapInArrow(_asks(least, blocks), _ASKS)
    keys = table.select("block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("asker"), F.col("sizes").alias("place"), F.col("counts").alias("f"), F.col("bits").alias("h"), "ends", "data")
    answers = keys.unionByName(asks).repartition(n, "block").sortWithinPartitions("block", "kind", "asker").mapInArrow(_answers, "block long, kind int, place binary, values binary")
    rows = table.select("block", F.lit(0).alias("kind"), F.col("ends").alias("x"), F.col("data").alias("y"), "counts")
    told = answers.select("block", "kind", F.col("place").alias("x"), F.col("values").alias("y"), F.lit(None).cast("binary").alias("counts"))
    scored = rows.unionByName(told).repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(_scored(least, inside, top), "lang string, phrase binary, a long, l long, r long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("phrase", F.col("phrase").cast("string")).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = grams.filter("block = -1").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
