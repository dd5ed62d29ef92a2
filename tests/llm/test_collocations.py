"""Collocations against plain counting, perfect hashing, and the cases that the docstring states."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import collocations as c
from gridloom.llm.slots import PerfectHash, StoredKeys, packed, unpacked

from .util import SCHEMA, prose, table


def brute(rows, least=10, inside=50, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in (1, 2, 3):
                for k in range(len(words) - n + 1):
                    counts[lang, tuple(words[k : k + n])] += 1
    kept = {(lang, p): a for (lang, p), a in counts.items() if len(p) > 1 and a >= least}
    out = {}
    for (lang, p), a in kept.items():
        if len(p) == 2 and any(q[k : k + 2] == p and 100 * b >= inside * a for (other, q), b in kept.items() if other == lang and len(q) == 3 for k in (0, 1)):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -s) for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def got(df, **options):
    return sorted(tuple(r) for r in c.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, many):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randint(1, 6)) for _ in range(25)] + ["Ada Lovelace", "a b c d", "x x x x", "\x00 \x1c\xa0nb", "É é", "don't--stop"]
    for _ in range(many):
        parts = [rng.choice(pool) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "; "]) for _ in range(rng.randint(0, 12))]
        yield "".join(parts), rng.choice(["de", "fr", None, "und", "x\ny"])


def test_collocations_against_counting(spark, monkeypatch):
    rows = [*texts(1, 300), (None, "de"), ("", None), ("one", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = brute(rows)
    assert len(want) > 50 and len({r[0] for r in want}) == 4 and got(df) == want
    assert got(df, least=3, inside=90, top=7) == brute(rows, 3, 90, 7)
    # slices of a few bytes, chunks of a few texts, blocks by the hundred, a map without room
    monkeypatch.setattr(c, "SLICE", 7)
    monkeypatch.setattr(c, "CHUNK", 200)
    monkeypatch.setattr(c, "BLOCK_TEXT", 100)
    assert got(df) == want
    assert [len(c._tail([*w])) for w in ([], [b"\n"], [b"a", b"\n"], [b"\n", b"\n"], [b"\n", b"a", b""], [b"a", b"b", b"c"])] == [0, 0, 0, 0, 1, 2]


def test_collocations_slices(monkeypatch):
    monkeypatch.setattr(c, "SLICE", 5)
    for text in (b"", b"aaaaaaaaaaaa", b"a b c d e f g", b"aaaaaaa bbbbbbbbbbbb\nc ", b"  \n  \n   "):
        parts = list(c._slices(text))
        assert b"".join(parts) == text and all(p[-1:] in (b" ", b"\n") for p in parts[:-1])


def test_collocations_edges(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == [] and got(spark.createDataFrame([(1, None, None, "s", None), (2, "rare words only", "de", "s", 3)], SCHEMA)) == []
    df = table(spark, [("so it goes " * 30000, "de"), ("so it goes", "de"), ("so it goes", "de")], "text string, lang string")
    clashing = df.withColumns({x: F.lit("!") for x in ("block", "chunk", "n", "h", "c", "ends", "data", "rank", "phrase", "score", "doc_id")})
    rows = [("so it goes " * 30000, "de"), ("so it goes", "de"), ("so it goes", "de")]
    assert got(clashing) == brute(rows)


def test_perfect_hash():
    for m in (0, 1, 2, 1000, 50_000):
        h = np.unique(np.random.default_rng(m).integers(0, 1 << 63, m, np.int64).view(np.uint64))
        hashing = PerfectHash.load(*PerfectHash.of(h).dump())
        assert sorted(hashing(h).tolist()) == list(range(len(h)))
        other = hashing(h + np.uint64(1))
        assert ((other >= -1) & (other < max(1, len(h)))).all()


def test_stored_keys_with_equal_hashes():
    keys = pa.array([b"a", b"bb", b"a", b"", b"dd", b"e"], pa.binary())
    h = np.array([1, 1, 1, 2, 3, 3], np.uint64)
    stored = StoredKeys.load(*StoredKeys.of(h, keys).dump())
    slots = stored(h, keys).tolist()
    assert slots[0] == slots[2] and sorted(set(slots)) == [0, 1, 2, 3, 4] and len(stored) == 5
    assert [stored.keys[i].as_py() for i in slots] == keys.to_pylist()
    assert stored(np.array([1, 9], np.uint64), pa.array([b"zz", b"a"], pa.binary())).tolist() == [-1, -1]
    assert unpacked(*packed(keys)).to_pylist() == keys.to_pylist()
