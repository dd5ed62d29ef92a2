"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles into classes (half, full]. For a class
of size u, documents are cut into windows of 2u shingles, a new one every u, so that each passage
of u shingles lies whole in some window and window and item are of comparable size however long
the document is. A window is a candidate when any of ``hashes`` MinHash values equals the item's:
containment c gives a Jaccard similarity of at least c / (4 + 2 (1 - c)), and the chance to miss
all values falls geometrically. Windows of larger classes are made of those of smaller ones
(minima of minima), so all classes cost one pass. Items too small for that (up to ``BASE``
shingles) form a class with windows of one shingle. Items of fewer words than a shingle are one
shingle of all their words; documents are looked through for shingles of that many words.

Candidates are settled by exact containment of the item's shingles in the whole document.
Items are taken in blocks of bounded size (``block_bytes`` of text), each block against all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

BASE = 8
_TABLE = bytes(ord(" ") if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def bare_words(text: str) -> list[bytes]:
    """Words in lower case (A-Z only); ASCII punctuation and white space separate them."""
    return text.encode("utf-8").translate(_TABLE).split()


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """All n-word shingles in order; fewer words: the whole sequence; no words: none."""
    if not words:
        return []
    return [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]


def _hash_rows(words: list[bytes], n: int, mix: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles, made of word hashes: one multiplication each."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = max(1, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(n, len(words))):
        out = (out ^ h[k : k + m]) * mix[0]
        out ^= out >> np.uint64(29)
    return out


def _functions(hashes: int) -> np.ndarray:
    """Odd 32-bit multipliers of the MinHash functions."""
    return np.array([xxhash.xxh64_intdigest(b"minhash %d" % k) & 0xFFFFFFFF | 1 for k in range(hashes)], np.uint32)


_MIX = np.array([0x9E3779B97F4A7C15], np.uint64)


def _values(rows: np.ndarray, mult: np.uint32) -> np.ndarray:
    folded = (rows ^ (rows >> np.uint64(32))).astype(np.uint32) * mult
    return folded ^ (folded >> np.uint32(15))


def size_class(n: int) -> int:
    """Largest size of the class of an item of n distinct shingles: 1 for small ones."""
    return 1 if n <= BASE else 1 << (n - 1).bit_length()


class Sketches:
    """The block's items: shingle sets, and by class and function their MinHash values; those of fewer
    words than a shingle by their number of words, with their one hash."""

    def __init__(self, items: list[tuple[int, str]], n: int, hashes: int):
        self.n, self.mult = n, _functions(hashes)
        words = [(i, w) for i, t in items if (w := bare_words(t))]
        self.sets = [(i, min(n, len(w)), frozenset(shingles(w, n))) for i, w in words]
        by: dict[int, list] = {}
        short: dict[int, list] = {}
        for at, (_, size, own) in enumerate(self.sets):
            if size < n:
                (text,) = own
                short.setdefault(size, []).append((int(_hash_rows(text.split(), size, _MIX)[0]), at))
                continue
            rows = np.unique(np.concatenate([_hash_rows(s.split(), n, _MIX) for s in own]))
            by.setdefault(size_class(len(own)), []).append((at, rows))
        self.classes = {}
        for u, members in by.items():
            values = np.array([[_values(rows, m).min() for _, rows in members] for m in self.mult], np.uint32)
            order = np.argsort(values, axis=1)
            owner = np.array([at for at, _ in members])
            self.classes[u] = (np.take_along_axis(values, order, 1), owner[order])
        self.short = {size: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([at for _, at in sorted(x)])) for size, x in short.items()}


def _hits(found: np.ndarray, table: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
    """(position, item) where a found value equals an item's."""
    lo = np.searchsorted(table, found)
    same = np.flatnonzero((lo < len(table)) & (table[np.minimum(lo, len(table) - 1)] == found))
    out = set()
    for p in same.tolist():
        k = int(lo[p])
        while k < len(table) and table[k] == found[p]:
            out.add((p, int(owner[k])))
            k += 1
    return out


def candidates(rows: np.ndarray, doc_of: np.ndarray, sketches: Sketches) -> set[tuple[int, int]]:
    """(document, item) pairs of which some window and item share a MinHash value.

    rows: shingle hashes of several documents, each padded to a whole number of BASE shingles by
    repeating its last one; doc_of: document of each BASE block."""
    out: set[tuple[int, int]] = set()
    windows = sorted(u for u in sketches.classes if u > 1)
    for k, mult in enumerate(sketches.mult):
        values = _values(rows, mult)
        if 1 in sketches.classes:
            table, owner = sketches.classes[1]
            out |= {(int(doc_of[p // BASE]), i) for p, i in _hits(values, table[k], owner[k])}
        if not windows:
            continue
        level = values.reshape(-1, BASE).min(1)  # minima of blocks of u shingles, a document after the other
        doc, u = doc_of, BASE
        while u < windows[-1] * 2:
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            place = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
            if u in sketches.classes:
                table, owner = sketches.classes[u]
                follows = np.r_[doc[1:] == doc[:-1], False]
                window = np.where(follows, np.minimum(level, np.r_[level[1:], level[-1:]]), level)
                out |= {(int(doc[p]), i) for p, i in _hits(window, table[k], owner[k])}
            level = np.minimum.reduceat(level, pair := np.flatnonzero(place % 2 == 0))
            doc, u = doc[pair], 2 * u
    return out


_FOUND = "doc_id long, item_id long, shared long, item_shingles long, containment double"
_CHUNK = 1 << 20


def _search(shared, least: float):
    def found(ids: list, words: list[list[bytes]], s: Sketches):
        parts, sizes, pairs = [], [], set()
        for d, w in enumerate(words):
            for size, (table, owner) in s.short.items():
                if len(w) >= size:
                    pairs |= {(d, i) for _, i in _hits(np.unique(_hash_rows(w, size, _MIX)), table, owner)}
            r = _hash_rows(w, s.n, _MIX)
            parts += [r, np.repeat(r[-1:], -len(r) % BASE)]
            sizes.append((len(r) + BASE - 1) // BASE)
        sizes = np.array(sizes)
        doc_of = np.repeat(np.arange(len(words)), sizes)
        if s.classes:
            pairs |= candidates(np.concatenate(parts), doc_of, s)
        own: dict[tuple[int, int], set] = {}
        for d, i in sorted(pairs):
            item, size, want = s.sets[i]
            if (d, size) not in own:
                own[d, size] = set(shingles(words[d], size))
            n = len(want & own[d, size])
            if n >= least * len(want):
                yield ids[d], item, n, len(want), n / len(want)

    def run(batches):
        s = shared.value
        for batch in batches:
            out, ids, words, size = [], [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w := bare_words(t):
                    ids.append(i)
                    words.append(w)
                    size += len(t)
                if size > _CHUNK:
                    out += found(ids, words, s)
                    ids, words, size = [], [], 0
            if ids:
                out += found(ids, words, s)
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, least: float = 0.8, hashes: int = 64, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per (document, item) where the document holds at least ``least`` of the item's
    distinct shingles: doc_id, item_id, shared, item_shingles, containment.

    Words are compared without case and ASCII punctuation. Null and wordless texts and items match
    nothing; an item of fewer words than a shingle is one shingle of all its words, found wherever
    they follow each other. Repeated rows are reported for each; an item that repeats id and text is
    one, and different texts of one id are looked for apart. Empty tables: no rows. Items are dealt
    by a hash into blocks of about ``block_bytes`` of text, each sent to all tasks; one longer text
    is a block's at least.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].cast("string").alias("words")).filter(F.col("words").isNotNull()).distinct()
    blocks = 1 + (items.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0) // block_bytes
    rows = id_and_text(docs, id_col, text_col)
    out = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else items
        sketches = Sketches([tuple(r) for r in block.collect()], shingle, hashes)
        part = rows.mapInArrow(_search(spark.sparkContext.broadcast(sketches), least), _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns kept, that hold no item of the benchmark (see contaminated). Rows
    of one id go together; a row with a null id is judged by itself, known by a hash of its text."""
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    key = F.coalesce(docs[id_col].cast("long"), F.xxhash64(docs[text_col]))
    bad = contaminated(docs.select(key.alias("doc_id"), docs[text_col].alias("text")), benchmark, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.withColumn("__key", key).join(bad, F.col("__key") == F.col("__bad"), "left_anti").select(*docs.columns)
