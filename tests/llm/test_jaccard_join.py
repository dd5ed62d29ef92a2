"""The Jaccard join against all pairs, DivideSkip against counting, and the cases of the docstring."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import jaccard_join as j

from .util import components, prose, table


def shingles(text, k=5):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, similar=80):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    label = components(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    return sorted(((i, len(sets[k]), i if not sets[k] else least.get(label[k])) for k, (i, _) in enumerate(rows)), key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in j.jaccard_components(df, **options).collect()), key=repr)


def near_copies(seed, groups=12):
    """Groups of texts with a few words changed, dropped or moved, so that many pairs lie about 0.8."""
    rng, rows = random.Random(seed), []
    passages = [prose(rng, 60) for _ in range(3)]
    for _ in range(groups):
        words = prose(rng, rng.choice([3, 6, 12, 40, 120, 400])).split() + (rng.choice(passages).split() if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 14)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = [rng.choice(["NEW", "ba", "Do"])] * rng.randint(0, 2)
            rows.append(" ".join(own) or "x")
    rng.shuffle(rows)
    return rows + ["", None, " \n", "Ba Do", "ba do", "one", "one two three four five", "One two three four five"]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed, monkeypatch):
    rows = [(3 * k + 1, t) for k, t in enumerate(near_copies(seed))]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1]), (None, "nothing like it at all here")]
    df = table(spark, rows).repartition(5)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 30 and got(df) == want
    # blocks of two records, parts of one query, shards of a few entries
    for name, value in (("RECORDS", 2), ("QUERIES", 1), ("SHARD", 8), ("PACK", 50), ("SHINGLES", 300)):
        monkeypatch.setattr(j, name, value)
    assert got(df) == want


def test_join_of_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(j, "RECORDS", 8)
    rng = random.Random(9)
    words = prose(rng, 80).split()
    rows = [(k, " ".join([*words[:40], f"own{k}", *words[40:]])) for k in range(120)]
    assert got(table(spark, rows)) == [(k, 77, 0) for k in sorted(range(120), key=lambda k: repr((k, 77, 0)))]


def test_join_edges(spark):
    assert got(table(spark, [])) == [] and got(table(spark, [(2, None), (1, " ")])) == [(1, 0, 1), (2, 0, 2)]
    long = "so it goes on and " * 40_000
    df = table(spark, [(1, long), (2, long + "on"), (3, "a b")]).withColumns({c: F.lit("!") for c in ("n", "node", "block", "role", "same", "component", "least", "low", "short", "home", "cut", "part", "hashes")})
    assert got(df) == [(1, 5, 1), (2, 6, 1), (3, 1, 3)]


def test_divide_skip_against_counting():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64)) for n in (1, 5, 9, 30, 200)]
    sets = []
    for x in base:
        for _ in range(25):
            own = x[rng.random(len(x)) > rng.choice([0, 0.05, 0.12])]
            sets.append(np.union1d(own if len(own) else x, rng.integers(0, 1 << 40, rng.integers(0, 1 + len(x) // 6)).astype(np.uint64)))
    for s in (Fraction("0.8"), Fraction("0.5"), Fraction(1)):
        lists = j.Lists(sets, s)
        for x in sets:
            want = [k for k, y in enumerate(sets) if (i := len(np.intersect1d(x, y))) >= s * (len(x) + len(y) - i)]
            assert lists.search(x).tolist() == want
        assert lists.search(np.array([3], np.uint64)).tolist() == []


def test_lists_draw_groups_together():
    x = np.arange(10, dtype=np.uint64)
    lists = j.Lists([x, x, x + np.uint64(50), x], Fraction("0.8"))
    assert lists.drawn(lists.search(x)) == [0, 1, 3] and lists.drawn(lists.search(x)) == [0]
    assert lists.search(x, 1).tolist() == []


def test_list_lengths_bound_every_list(spark):
    texts = ["a b c d e f", "a b c d e", "q", None]
    df = table(spark, list(enumerate(texts))).selectExpr("doc_id", "coalesce(text, '') text").repartition(3)
    lengths = j.list_lengths(df, 5)
    assert int(lengths.sum()) == 4 and sorted(lengths[lengths > 0].tolist()) in ([1, 1, 2], [1, 3], [4])


def test_wanted_entries_against_all_pairs():
    rng = np.random.default_rng(5)
    for size, blocks, groups in ((60, 3, 2), (200, 6, 4), (200, 5, 40)):
        key = rng.integers(0, 9, size).astype(np.uint64)
        node = np.concatenate([rng.permutation(size // 2)] * 2)
        home, label = rng.integers(0, blocks, size), rng.integers(0, groups, size)
        block, group = home[node], label[node]
        want = set()
        for k in range(size):
            for i in range(size):
                if key[i] == key[k] and group[i] != group[k] and block[i] <= block[k]:
                    want.add((int(key[k]), int(block[k]), int(node[k]), 1))
                    if block[i] < block[k]:
                        want.add((int(key[k]), int(block[k]), int(node[i]), 0))
        for most in (1 << 22, 3):
            found = set()
            for one in np.unique(key):
                own = key == one
                for at, nodes, role in j._wanted(key[own], node[own], block[own], group[own], most):
                    found |= {(int(one), b, x, role) for b, x in zip(at.tolist(), nodes.tolist(), strict=True)}
            # an indexed entry comes with all of its block once another group is there
            assert want <= found and {x for x in found if x[3] == 0} == {x for x in want if x[3] == 0}


def test_a_group_is_not_sent_to_its_own_blocks(spark, monkeypatch):
    """Of near copies in many blocks that the first round joins, none is a query of another block."""
    monkeypatch.setattr(j, "RECORDS", 8)
    counts, written = {}, j.written

    def counting(df, name, **options):
        out = written(df, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(j, "written", counting)
    words = prose(random.Random(9), 80).split()
    rows = [(k, " ".join([*words[:40], f"own{k}", *words[40:]])) for k in range(120)]
    assert {c for _, _, c in got(table(spark, rows))} == {0}
    assert counts["jaccard-needs"] < 2 * len(rows)


def test_a_passage_that_all_texts_share_is_not_met_by_all_blocks(spark, monkeypatch):
    """What is counted of texts with most of a passage in common follows their number, not its square."""
    monkeypatch.setattr(j, "RECORDS", 8)
    passage = prose(random.Random(3), 160)
    made, plain = [], j._needs

    def counting(batches, total):
        for batch in batches:
            total.add(sum(len(x) for x in batch.column("lists").to_pylist()) // 4)
            yield batch

    def needs(ranges):
        run, total = plain(ranges), spark.sparkContext.accumulator(0)
        made.append(total)
        return lambda batches: counting(run(batches), total)

    monkeypatch.setattr(j, "_needs", needs)
    counts = []
    for many in (80, 320):
        made.clear()
        rows = [(k, " ".join(f"w{k}x{i}" for i in range(40)) + " " + passage) for k in range(many)]
        assert [c for _, _, c in sorted(got(table(spark, rows)))] == list(range(many))
        counts.append(sum(x.value for x in made))
    assert 0 < counts[1] < 6 * counts[0]
