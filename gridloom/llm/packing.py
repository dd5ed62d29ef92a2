"""Best-fit packing with certified bounds.

Texts become token ids and one end id; documents longer than a sequence are cut into whole
sequences, the first piece holding what is over. Whole pieces fill a sequence each. The others are
packed by best-fit decreasing in partitions of bounded size, each in one task. A partition's bin
count is certified by dual feasible functions: no packing of its pieces can use fewer bins than
their largest bound. What a certified partition keeps is final except its emptiest bin; partitions
with a gap keep their full bins. The documents of all other bins are exchanged: dealt anew into
fewer partitions and packed again, until one partition is left, nothing is left or the rounds end.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written

CAPACITY = 2048
#: The added tokens of the vocabulary's JSON form, which the ranks file doesn't hold.
ADDED = {"<|endoftext|>": 50256}
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, ids array<int>"
_ARROW = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "row": pa.int64(), "ids": pa.list_(pa.int32())}


def load_tokenizer(vocabulary: str | None = None, added: bool = False, model: str | None = None):
    """Function from a text to its ids as a uint32 array. vocabulary, model: paths of the ranks and
    of the JSON form of the 50k byte-level BPE; by default the installed public files. With added
    the ids are those that tokenizers gives with the JSON form, which is slower by a factor of three:
    an added token that stands in a text is one id. Without, it is text like any other
    (encode_special_tokens there). Texts whose runs of white space are too long for the ranks' pattern
    are encoded by the JSON form."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED if added else {})
    whole: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # the pattern's stack is spent
            if not whole:
                whole.append(Tokenizer.from_file(model or public_tokenizers.path("byte_bpe_50k.json")))
                whole[0].encode_special_tokens = not added
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones last, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, added: bool = False, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, row (a number of the input
    row), ids (null unless asked for). A null or empty text is one piece of the end id alone."""

    def run(batches):
        from pyspark import TaskContext

        encode, row = load_tokenizer(vocabulary, added), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _ARROW}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for name, v in zip(_ARROW, (i, k, start, length, zlib.crc32(own := ids[start : start + length]), row, own.astype(np.int32) if with_ids else None), strict=True):
                        out[name].append(v)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in _ARROW.items()], names=list(_ARROW))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each length, and what each bin has left.
    Bins wait by room left; a bit set of the rooms in use gives the tightest one at once."""
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bin_of[k], offset[k] = b, capacity - room
        left[b] = room - size
        if left[b]:
            waiting[left[b]].append(b)
            rooms |= 1 << left[b]
    return bin_of, offset, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins any packing needs, by two families of dual feasible functions: for every k up
    to half the capacity, lengths over capacity - k count whole and those under k not at all; and
    for small n, the rounding of (n + 1) x / capacity down to n-ths unless it is whole."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """lower_bound from how often each length 0..capacity occurs."""
    sizes = np.arange(capacity + 1)
    number, weight = np.cumsum(count), np.cumsum(count * sizes)
    best = math.ceil(int(weight[-1]) / capacity)
    for k in range(1, capacity // 2 + 1):
        big = int(number[-1] - number[capacity - k])
        best = max(best, big + math.ceil(int(weight[capacity - k] - weight[k - 1]) / capacity))
    for n in range(1, 33):
        whole = sizes * (n + 1) % capacity == 0
        scaled = np.where(whole, sizes * n, sizes * (n + 1) // capacity * capacity)  # in 1 / (n * capacity)
        best = max(best, math.ceil(int((count * scaled).sum()) / (n * capacity)))
    return best


_PACKED = "row long, piece int, length long, bin long, offset long, part long, done boolean, bound long, bins long"


def _packer(capacity: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bin_of, offset, left = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if last:
            done = np.ones(len(left), bool)
        elif len(left) == bound:
            done = np.arange(len(left)) != left.argmax()
        else:
            done = left == 0
        out = table.select(["row", "piece", "length"])
        n = len(lengths)
        for name, v in (("bin", bin_of), ("offset", offset), ("part", table["part"]), ("done", done[bin_of]), ("bound", np.full(n, bound)), ("bins", np.full(n, len(left)))):
            out = out.append_column(name, v if isinstance(v, pa.ChunkedArray) else pa.array(v))
        return out

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, partition_items: int = 50_000, max_rounds: int = 6) -> DataFrame:
    """Packs (row, piece, length < capacity): sequence_id, offset and certified (its partition's
    bin count equals the bound) for each. Sequence numbers are unique over the rounds."""
    out, todo = None, items.select("row", "piece", "length")
    for step in range(max_rounds):
        n = todo.count()
        if not n:
            break
        parts = max(1, math.ceil(n / partition_items))
        last = parts == 1 or step == max_rounds - 1
        part = F.pmod(F.xxhash64("row", "piece", F.lit(step)), F.lit(parts))
        packed = written(todo.withColumn("part", part).groupBy("part").applyInArrow(_packer(capacity, last), _PACKED), "packed")
        final = packed.filter("done").select("row", "piece", ((F.lit(step).cast("long") * (1 << 54)) + F.col("part") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset", (F.col("bound") == F.col("bins")).alias("certified"))
        out = final if out is None else out.unionByName(final)
        if last:
            break
        todo = packed.filter("not done").select("row", "piece", "length")
    if out is None:
        return todo.select("row", "piece", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    return out


def against_bound(packed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used, the bound below which no packing of all these pieces can go, and the
    gap between them. From counts of at most ``capacity`` lengths. Empty table: zeros."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    bound = bound_of_counts(counts, capacity)
    used = packed.agg(F.count_distinct("sequence_id").alias("sequences"))
    return used.select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))


def best_fit_packing(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, added: bool = False, partition_items: int = 50_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset,
    certified. ids are the piece's tokens, null unless ``with_ids``; ``added`` is load_tokenizer's.

    Every token of every document is in exactly one piece; a sequence's pieces lie without gaps
    from 0. Null and empty texts are their end token. Repeated rows are packed as often as they
    occur, null ids included; equal lengths may go to either place. Empty table: no rows.
    """
    cut_up = written(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, vocabulary=vocabulary, added=added, with_ids=with_ids), "pieces")
    whole = cut_up.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = cut_up.filter(F.col("length") < capacity)
    placed = rest.join(pack(rest, capacity=capacity, partition_items=partition_items), ["row", "piece"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "certified").unionByName(whole)
