"""Small tables and plain reference versions for the tests of the text operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, **columns):
    rows = [(k, t, columns.get("lang", {}).get(k), "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


SYLLABLES = {"aa": ["ba", "do", "li", "ren", "so", "ta"], "bb": ["kr", "oy", "zu", "ptem", "wix", "ghe"]}


def prose(rng: random.Random, words: int, kind: str = "aa") -> str:
    return " ".join("".join(rng.choice(SYLLABLES[kind]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def components(n: int, links) -> list[int]:
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
