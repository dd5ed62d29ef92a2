"""Exact, line and near deduplication against plain versions."""

import hashlib
import random
import time
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, simhash
from gridloom.llm.exact_dedup import grace_dedup
from gridloom.llm.graph import components as spark_components
from gridloom.llm.line_dedup import dedup_lines, edit_distance_within

from .util import components, documents, edit_distance, prose, table


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "ä" * 5000), (7, "ä" * 5000), (None, "a"), (9, "a "), (8, "b"), (8, "b")]
    for options in ({}, {"table_bytes": 1, "bucket_bytes": 1, "fan_out": 2, "max_levels": 3}):
        got = [tuple(r) for r in grace_dedup(table(spark, rows).repartition(3), **options).collect()]
        assert len(got) == len(rows)
        for doc, keep, size, _, sha in got:
            text = dict((i, t or "") for i, t in rows)[doc]
            same = [i for i, t in rows if (t or "") == text]
            assert (keep, size, sha) == (max(i for i in same if i is not None), len(same), hashlib.sha256(text.encode()).hexdigest())
        assert sorted(doc for doc, _, _, kept, _ in got if kept) == [3, 5, 7, 8, 9]


def test_exact_dedup_empty_and_clashing_columns(spark):
    assert grace_dedup(table(spark, [])).collect() == []
    df = table(spark, [(1, "x"), (2, "x")]).withColumns({c: F.lit("!") for c in ("rep", "keep_id", "bucket", "text_sha256", "n", "split")})
    assert sorted(r.kept for r in grace_dedup(df).collect()) == [False, True]


def test_exact_dedup_null_ids(spark):
    got = grace_dedup(table(spark, [(None, "x"), (None, "x")])).collect()
    assert sorted(r.kept for r in got) == [False, True] and got[0].keep_id is None and got[0].group_size == 2


def test_grace_levels(spark):
    reps = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"), F.lit(10).cast("long").alias("n_bytes"))
    sized = exact_dedup._bucketed(reps, 100, 4, 8).groupBy("bucket").agg(F.sum("n_bytes").alias("b"))
    assert sized.agg(F.max("b")).first()[0] <= 100


def brute_lines(rows, edits, least):
    every = [(i, k, line) for i, t in sorted(rows) if t is not None for k, line in enumerate(t.split("\n")) if line.strip(" \t\n\v\f\r")]

    def near(x, y):
        return x == y or min(len(x), len(y)) >= least and abs(len(y) - len(x)) <= edits and edit_distance(x, y) <= edits

    gone = {x[:2] for n, x in enumerate(every) if any(near(x[2], y[2]) for y in every[:n])}
    return {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [prose(rng, rng.randint(2, 9)) for _ in range(12)] + ["", " \t", "kurz", "Of.", "äöü ßéñ äöü ßéñ äöü", "fifteen letters", "sixteen letters!"]

    def changed(line):
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(line))
            line = rng.choice((line[:k] + "x" + line[k:], line[:k] + line[k + 1 :], line[:k] + "é" + line[k + 1 :]))
        return line

    rows = [(i, "\n".join(changed(rng.choice(pool)) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, "Of.\n \nOf."), (64, "Of.")]
    for edits, block in ((1, 4096), (2, 3), (3, 4096)):
        got = {r.doc_id: r for r in dedup_lines(table(spark, rows).repartition(3), edits=edits, block=block).collect()}
        want = brute_lines(rows, edits, 16)
        assert {i: r.text for i, r in got.items()} == want
        assert got[60].n_lines == 0 and got[61].n_lines == 1 and got[62].n_lines == 3 and got[62].text == "\n\n"
        assert sum(r.n_dropped for r in got.values()) > 30
    with pytest.raises(ValueError):
        dedup_lines(table(spark, rows), edits=2, min_chars=2)


def test_line_dedup_beyond_the_first_plane(spark):
    """Characters of two UTF-16 units are one character: four different ones are four edits, two are two."""
    lines = ["the same long line 😀😀😀😀", "the same long line 🎉🎉🎉🎉", "the same long line 😀😀🎉🎉", "𝒶𝒷𝒸𝒹𝑒𝒻𝑔𝒽𝒾𝒿𝓀𝓁𝓂𝓃𝑜𝓅", "𝒶𝒷𝒸𝒹𝑒𝒻𝑔𝒽𝒾𝒿𝓀𝓁𝓂𝓃𝑜𝓆", "𝒶𝒷𝒸𝒹𝑒𝒻𝑔𝒽𝒾𝒿𝓀𝓁𝓂𝓃𝑜"]
    rows = list(enumerate(lines))
    got = {r.doc_id: r.text for r in dedup_lines(table(spark, rows)).collect()}
    assert got == brute_lines(rows, 2, 16) == {0: lines[0], 1: lines[1], 2: "", 3: lines[3], 4: "", 5: lines[5]}


def test_line_dedup_shared_segment(spark):
    """A segment that hundreds of different lines share is dealt out in blocks."""
    rows = [(k, f"{'boilerplate of one site that all pages have, page '}{k * 7919:07d}{'x' * (k % 40)}") for k in range(400)]
    got = {r.doc_id for r in dedup_lines(table(spark, rows), block=50).collect() if r.text}
    one = {r.doc_id for r in dedup_lines(table(spark, rows), block=4096).collect() if r.text}
    assert got == one == {i for i, t in brute_near(rows)}


def brute_near(rows):
    """(id, line) of lines of equal shape that no earlier one is within two edits of."""
    out = []
    for k, (i, x) in enumerate(rows):
        if not any(abs(len(x) - len(y)) <= 2 and sum(a != b for a, b in zip(x, y, strict=False)) <= 14 and edit_distance(x[45:], y[45:]) <= 2 for _, y in rows[:k]):
            out.append((i, x))
    return out


def test_line_dedup_odd_input(spark):
    line = "the same long line of text"
    rows = [(1, f"{line}\n{line}"), (1, f"{line}\n{line}"), (None, line), (2, "\n".join([line] * 3000))]
    df = table(spark, rows).withColumns({c: F.lit("!") for c in ("n_lines", "row", "at", "key", "gone", "first")})
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped, r.gone) for r in dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 2, 2, "!"), (1, "", 2, 2, "!"), (None, line, 1, 0, "!"), (2, "", 3000, 3000, "!")], key=str)
    assert dedup_lines(table(spark, [])).collect() == []


def test_banded_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(3, 9)))
        b = "".join(rng.choice("ab") for _ in range(max(3, len(a) + rng.randint(-2, 2))))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", edit_distance_within(F.split("a", "(?!^)"), F.split("b", "(?!^)"), edits).alias("near")).collect()
        assert all(r.near == (edit_distance(r.a, r.b) <= edits) for r in got)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 199), rng.randint(0, 199)) for _ in range(120)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 360)] + [(5, 5)]
    got = dict(map(tuple, spark_components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = components(360, links)
    assert all(got[n] == want[n] for n in got) and {n for x in links if x[0] != x[1] for n in x} == set(got)
    assert spark_components(spark.createDataFrame([], "a long, b long")).collect() == []


def bits_between(a, b):
    return bin(a ^ b).count("1")


def test_pigeonring_links(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for _ in range(20)}
    fps = sorted(fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bits_between(fps[i], fps[j]) <= 3]
    want = components(len(fps), links)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for block in (1024, 4):
        found = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.pigeonring_links(nodes, 3, block).collect()]
        assert all(bits_between(a, b) <= 60 for a, b in found)
        at = {x: i for i, x in enumerate(fps)}
        assert components(len(fps), [(at[a], at[b]) for a, b in found]) == want
    with pytest.raises(ValueError):
        simhash.pigeonring_links(nodes, 9)


def test_simhash_components(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(30)]
    texts += [t + " more" for t in texts[:10]] + [texts[3]] * 5 + [None, "", "  ", "One", "ONE", "two words", "x " * 30000]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in simhash.simhash_components(docs.repartition(3)).collect()}
    fps = [simhash.fingerprint(t or "", 3) for t in texts]
    want = components(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if bits_between(fps[i], fps[j]) <= 3])
    assert all(got[i].component_id == want[i] and got[i].fingerprint == f"{fps[i]:016x}" for i in got) and len(got) == len(texts)
    assert simhash.simhash_components(table(spark, [])).collect() == []


def test_fingerprint_by_hand():
    import xxhash

    words = "a b c d e".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint("A b\tc\nd E", 3) == want and simhash.fingerprint("a B", 3) == xxhash.xxh64_intdigest("a b", 42)


def test_near_duplicates(spark):
    rng = random.Random(6)
    texts = [prose(rng, 200) for _ in range(40)]

    def edited(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "changed"
        return " ".join(w)

    copies = [edited(texts[k % 10], 2) for k in range(40)]
    docs = documents(spark, [*texts, *copies, None, ""])
    for block in (4096, 8):
        gone = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, block=block).collect()}
        assert {i: c for i, c in gone.items() if i < 80} == {40 + k: k % 10 for k in range(40)} and gone[81] == 80
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 41


def test_near_duplicates_follow_the_similarity(spark):
    """Pairs at 0.7, 0.75, 0.8 and 0.85, some of one size and some within each other: none below 0.8 goes, none above stays."""
    rng = random.Random(11)
    texts, want = [], set()

    def words(n):
        return ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(n)]

    def grams(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for size in (20, 40, 150, 600):
        for share in (70, 75, 80, 85):
            for k in range(12):
                same = size * share // 100
                common, left = words(same + 4), size - same
                one, other = (0, left) if k % 2 else (left // 2, left - left // 2)
                pair = [[*common, *words(one)], [*words(other), *common]]
                a, b = map(grams, pair)
                assert len(a & b) == same and len(a | b) == size
                if 5 * same >= 4 * size:
                    want.add(len(texts) + 1)
                texts += [" ".join(w) for w in pair]
    assert len(want) == 4 * 2 * 12
    assert {r.doc_id for r in simhash.near_duplicates(documents(spark, texts)).collect()} == want


def test_near_duplicates_beyond_the_first_forest(spark):
    """Links that the forest of the nearest fingerprints leaves out are found all the same: components equal all pairs' of exact similarity."""
    rng = random.Random(12)
    base = prose(rng, 120).split()
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"odd{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    links = [(i, j) for i in range(60) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = components(60, links)
    for block in (4096, 8):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, texts), block=block).collect()}
        assert got == {i: c for i, c in enumerate(want) if i != c} and 5 < len(got) < 59


def test_marks_do_not_follow_the_number_of_frequent_shingles(monkeypatch):
    """Prefixes take frequent shingles last, and finding those takes no pass over all frequent ones with each text."""
    rng = random.Random(13)
    texts = [prose(rng, 60) for _ in range(40)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    known = np.concatenate([s[::3] for s in sets])
    took = {}
    for many in (1 << 10, 1 << 16):
        others = np.random.default_rng(many).integers(0, 1 << 63, many).astype(np.uint64) * np.uint64(2)
        frequent = np.unique(np.concatenate([known, others]))
        monkeypatch.setattr(simhash, "_frequent", lambda texts, shingle, own=frequent: own)
        run = simhash._marks(SimpleNamespace(mapInArrow=lambda run, schema: run), 5, Fraction("0.8"))
        batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
        for _ in range(3):
            began = time.process_time()
            (marks,) = run([batch])
            took[many] = min(took.get(many, 1e9), time.process_time() - began)
        late = set(frequent.tolist())
        for s, prefix in zip(sets, marks.column("prefix").to_pylist(), strict=True):
            want = sorted(s.tolist(), key=lambda h: h in late)[: len(s) - -(-4 * len(s) // 5) + 1]
            assert [h % (1 << 64) for h in prefix] == want
    assert took[1 << 16] < 5 * took[1 << 10]


def test_line_keys_are_two_numbers(spark, monkeypatch):
    """The key table names lines by 63 bits of their ids, and near lines are found through it."""
    from gridloom.llm import line_dedup

    kept, written = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, **o: kept.setdefault(name, written(df, name, **o)))
    rows = [(1, "a line that is long enough\nanother that is long enough"), (2, "a line thet is long enough"), (3, "nothing like the lines before")]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    codes = {r[0] for r in kept["line-keys"].select("code").collect()}
    assert kept["line-keys"].columns == ["key", "code", "index"] and len(codes) == 3
    assert codes <= {r.id >> 1 for r in kept["line-firsts"].collect()}
