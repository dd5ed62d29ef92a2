"""Language identification by prediction by partial matching.

One variable-order byte context tree per language, orders 3 to 0. A node predicts a seen symbol
with n / (N + distinct), escapes with distinct / (N + distinct) to the next shorter context, and
symbols already offered there are excluded; below order 0 all symbols are equally likely. The
statistics are frozen after fitting, so each (context, symbol) has one exact code length, worked
out once per node. Scoring a text is then a walk over its bytes: find the longest known context,
add that node's code length under each language. The language with the shortest code wins. Trees of
up to ``DENSE_BYTES`` are laid out with a code length for every symbol at every context; larger ones
keep those that were seen and the escapes between, and walk down the orders, to the same lengths.

Fitting uses a bounded sample of labelled rows (``sample_per_lang``, expected documents a
language, chosen by a hash of the id); every document is scored over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

ORDER = 3
DENSE_BYTES = 128 << 20
UNKNOWN = "und"


def _byte_classes() -> np.ndarray:
    """Bytes to symbols: letters without case, one class each for digits, white space and other
    ASCII; every byte above 127 is its own symbol. Symbol 0 also stands before a text."""
    out = np.zeros(256, np.int64)
    out[: 128] = 1
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[48:58] = 2
    for i in range(26):
        out[65 + i] = out[97 + i] = 3 + i
    out[128:] = 29 + np.arange(128)
    return out


CLASSES = _byte_classes()
SYMBOLS = int(CLASSES.max()) + 1


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER zeros, and where each text's padding starts."""
    raw = [b" " * ORDER + t.encode("utf-8") for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    return CLASSES[np.frombuffer(b"".join(raw), np.uint8)], starts


def _grams(sym: np.ndarray) -> np.ndarray:
    """At each position the number of its context of ORDER symbols and itself."""
    code = sym.copy()
    for k in range(1, ORDER + 1):
        code[k:] += sym[:-k] * SYMBOLS**k
    return code


def _count(batches):
    """Per batch of (lang, text): how often each gram occurs in each language."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang in sorted(set(langs)):
            sym, starts = _symbols([t for t, x in zip(texts, langs, strict=True) if x == lang])
            inside = np.ones(len(sym), bool)
            for k in range(ORDER):
                inside[starts[:-1] + k] = False
            gram, n = np.unique(_grams(sym)[inside], return_counts=True)
            out["lang"] += [lang] * len(gram)
            out["gram"] += gram.tolist()
            out["n"] += n.tolist()
        yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))


@dataclass(frozen=True)
class FrozenTrees:
    """langs; known: sorted context numbers of order ORDER seen in any language; state of a
    context is its place there, else len(known) + its order-2 context's number. cost: natural-log
    code length by language and state * SYMBOLS + symbol."""

    langs: list[str]
    known: np.ndarray
    cost: np.ndarray
    short: np.ndarray


def _ppm_rows(parent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probabilities of a set of contexts from their counts and their parents' probabilities."""
    distinct, total = (counts > 0).sum(1), counts.sum(1)
    left = np.where(counts > 0, 0.0, parent)
    mass = left.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        whole = total + np.where(mass > 0, distinct, 0)  # nothing to escape to: no escape
        own = counts / whole[:, None]
        rest = np.where(mass > 0, distinct / whole / np.where(mass > 0, mass, 1), 0.0)
    out = own + left * rest[:, None]
    return np.where(total[:, None] > 0, out, parent)


def frozen_trees(counts: list[tuple[str, int, int]]) -> FrozenTrees:
    """The trees of (lang, gram, n) rows: at most languages x seen contexts of three symbols."""
    langs = sorted({x[0] for x in counts})
    gram = np.array([x[1] for x in counts], np.int64)
    which = np.array([langs.index(x[0]) for x in counts], np.int64)
    n = np.array([x[2] for x in counts], np.float64)
    known = np.unique(gram // SYMBOLS)
    pairs = np.unique(known % SYMBOLS**2)
    short = np.full(SYMBOLS**2, -1, np.int32)
    short[pairs] = len(known) + np.arange(len(pairs))
    ones = np.arange(SYMBOLS)
    cost = np.zeros((len(langs), (len(known) + len(pairs) + SYMBOLS) * SYMBOLS), np.float32)
    for i in range(len(langs)):
        mine, w = gram[which == i], n[which == i]
        sym = mine % SYMBOLS

        def table(rows: np.ndarray, size: int, sym=sym, w=w) -> np.ndarray:
            return np.bincount(rows * SYMBOLS + sym, w, size * SYMBOLS).reshape(size, SYMBOLS)

        p0 = _ppm_rows(np.full((1, SYMBOLS), 1 / SYMBOLS), table(np.zeros(len(mine), np.int64), 1))
        p1 = _ppm_rows(np.repeat(p0, SYMBOLS, 0), table(mine // SYMBOLS % SYMBOLS, SYMBOLS))
        at2 = np.searchsorted(pairs, mine // SYMBOLS % SYMBOLS**2)
        p2 = _ppm_rows(p1[pairs % SYMBOLS], table(at2, len(pairs)))
        p3 = _ppm_rows(p2[np.searchsorted(pairs, known % SYMBOLS**2)], table(np.searchsorted(known, mine // SYMBOLS), len(known)))
        cost[i] = -np.log(np.concatenate([p3, p2, p1[ones]])).astype(np.float32).ravel()
    short[short < 0] = len(known) + len(pairs) + np.arange(SYMBOLS**2)[short < 0] % SYMBOLS
    return FrozenTrees(langs, known, cost, short)


@dataclass(frozen=True)
class SparseTrees:
    """langs; for each, by order from the highest to 1: sorted grams (context and symbol) with their
    code lengths, sorted contexts with those of their escapes; and the row of order 0."""

    langs: list[str]
    orders: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    base: list[np.ndarray]


def sparse_trees(counts: list[tuple[str, int, int]]) -> SparseTrees:
    """The same trees as frozen_trees, as large as what was seen."""
    langs = sorted({x[0] for x in counts})
    orders, base = [], []
    for lang in langs:
        gram, n = (np.array([x[k] for x in counts if x[0] == lang], t) for k, t in ((1, np.int64), (2, np.float64)))
        row = _ppm_rows(np.full((1, SYMBOLS), 1 / SYMBOLS), np.bincount(gram % SYMBOLS, n, SYMBOLS)[None])[0]
        levels: list = []

        def lower(keys: np.ndarray, levels=levels, row=row) -> np.ndarray:
            """Code length of grams (context and symbol) by the orders made so far."""
            return _walked(keys, levels[::-1], row)

        for order in range(1, ORDER + 1):
            keys, at = np.unique(gram % SYMBOLS ** (order + 1), return_inverse=True)
            times = np.bincount(at, n)
            contexts, of = np.unique(keys // SYMBOLS, return_inverse=True)
            total, distinct = np.bincount(of, times), np.bincount(of)
            mass = 1 - np.bincount(of, np.exp(-lower(keys % SYMBOLS**order)))
            more = distinct < SYMBOLS
            whole = total + np.where(more, distinct, 0)
            with np.errstate(divide="ignore"):
                escape = np.where(more, -np.log(distinct / whole / np.maximum(mass, 1e-300)), 0.0)
            levels.append((keys, -np.log(times / whole[of]), contexts, escape))
        orders.append(levels[::-1])
        base.append(-np.log(row))
    return SparseTrees(langs, orders, base)


def _walked(grams: np.ndarray, levels: list, base_row: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams))
    left = np.arange(len(grams))
    for order, (keys, length, contexts, escape) in zip(range(len(levels), 0, -1), levels, strict=True):
        key = grams[left] % SYMBOLS ** (order + 1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        out[left[hit]] += length[at[hit]]
        left, key = left[~hit], key[~hit]
        up = np.minimum(np.searchsorted(contexts, key // SYMBOLS), len(contexts) - 1)
        known = contexts[up] == key // SYMBOLS
        out[left[known]] += escape[up[known]]
    out[left] += -np.log(base_row[grams[left] % SYMBOLS])
    return out


def _states(model: FrozenTrees) -> np.ndarray:
    """State of every context number: three known symbols, else two, else one."""
    context = np.tile(model.short, SYMBOLS)
    context[model.known] = np.arange(len(model.known), dtype=np.int32)
    return context


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def code_lengths(texts: list[str], model: FrozenTrees | SparseTrees, states: np.ndarray | None) -> np.ndarray:
    """Exact code length in nats of each whole text under each language."""
    sym, starts = _symbols(texts)
    gram = _grams(sym)
    pad = (starts[:-1, None] + np.arange(ORDER)).ravel()
    out = np.empty((len(texts), len(model.langs)))
    dense = isinstance(model, FrozenTrees)
    node = states[gram // SYMBOLS].astype(np.int64) * SYMBOLS + sym if dense else gram
    for i in range(len(model.langs)):
        bits = model.cost[i][node].astype(np.float64) if dense else _walked(node, model.orders[i], np.exp(-model.base[i]))
        bits[pad] = 0
        out[:, i] = np.add.reduceat(bits, starts[:-1])
    return out


_SCORED = "doc_id long, held_out boolean, lang_pred string, score double, nats_per_byte double"
_CHUNK = 1 << 20


def _score(model):
    def run(batches):
        trees = model.value
        states = _states(trees) if trees.langs and isinstance(trees, FrozenTrees) else None
        for batch in batches:
            ids, texts, held = (batch.column(k).to_pylist() for k in range(3))
            pred: list = [UNKNOWN] * len(ids)
            score, per_byte = [0.0] * len(ids), [None] * len(ids)
            todo = [k for k, t in enumerate(texts) if trees.langs and t is not None and _has_letter(t)]
            while todo:  # a few MB of text at a time
                n, size = 0, 0
                while n < len(todo) and (n == 0 or size + len(texts[todo[n]]) <= _CHUNK):
                    size += len(texts[todo[n]])
                    n += 1
                now, todo = todo[:n], todo[n:]
                cost = code_lengths([texts[k] for k in now], trees, states)
                best = cost.argmin(1)
                least = cost[np.arange(n), best]
                odds = 1 / np.exp(-np.minimum(cost - least[:, None], 700)).sum(1)
                for k, b, c, p in zip(now, best.tolist(), least.tolist(), odds.tolist(), strict=True):
                    pred[k], score[k], per_byte[k] = trees.langs[b], p, c / len(texts[k].encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "nats_per_byte"])

    return run


def fit_trees(source: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, sample_per_lang: int = 3000, dense_bytes: int = DENSE_BYTES) -> FrozenTrees | SparseTrees:
    """Trees of a bounded sample of the labelled rows outside the held-out fold; what comes to the
    driver and goes to the tasks is bounded by the sample."""
    labelled = source.select(source[id_col].cast("long").alias("doc_id"), source[text_col].cast("string").alias("text"), source[lang_col].cast("string").alias("lang")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~_held(folds, held_fold))
    sizes = labelled.groupBy("lang").count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sampled = labelled.join(F.broadcast(sizes), "lang").filter(place * F.col("count") < sample_per_lang).select("lang", "text")  # a row per language
    grams = sampled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = list(grams.toPandas().itertuples(index=False, name=None))  # languages x seen contexts of three symbols
    if counts and 4 * len({x[0] for x in counts}) * (len({x[1] // SYMBOLS for x in counts}) + SYMBOLS) * SYMBOLS > dense_bytes:
        return sparse_trees(counts)
    return frozen_trees(counts) if counts else FrozenTrees([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0, np.int32))


def _held(folds: int, held_fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, sample_per_lang: int = 3000, dense_bytes: int = DENSE_BYTES, train: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, nats_per_byte.

    Learns from rows with text and lang whose crc32(doc_id as text) mod ``folds`` is not
    ``held_fold`` (of ``train`` if given, else of docs); a null doc_id is neither learned from nor
    held out. ``score`` is the posterior of the predicted language under equal priors, in 0..1.
    Null texts, texts without a letter, and all texts where nothing could be learned give ``und``
    and score 0; ties go to the first language by name. Repeated rows are scored alike.
    """
    model = fit_trees(docs if train is None else train, id_col=id_col, text_col=text_col, lang_col=lang_col, folds=folds, held_fold=held_fold, sample_per_lang=sample_per_lang, dense_bytes=dense_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.select("doc_id", "text", _held(folds, held_fold).alias("held_out")).mapInArrow(_score(shared), _SCORED)


def keep_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_nats_per_byte: float = 3.2, **options) -> DataFrame:
    """The rows of docs, all columns kept, whose language is known: not ``und``, and coded by the
    best language in at most ``max_nats_per_byte`` (prose takes 1 to 2.5, random bytes 4 to 5.5).
    A null lang takes the predicted value. Repeated rows, and rows with a null id, are judged by their texts
    alone; of languages that code a text alike the first by name counts. Null texts, and texts without a
    letter, go. Without labelled rows nothing is known, and all go; empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_trees(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options))
    score, inner = _score(shared), docs.schema

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            ids = pa.array([0] * len(text), pa.int64())
            (out,) = score([pa.RecordBatch.from_arrays([ids, text, pa.nulls(len(text), pa.bool_())], names=["doc_id", "text", "held_out"])])
            pred, per_byte = out.column(2).to_pylist(), out.column(4).to_pylist()
            keep = [p != UNKNOWN and x is not None and x <= max_nats_per_byte for p, x in zip(pred, per_byte, strict=True)]
            at = batch.schema.get_field_index(lang_col)
            lang = pa.array([x if x is not None else p for x, p in zip(batch.column(at).to_pylist(), pred, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), lang).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, inner)
