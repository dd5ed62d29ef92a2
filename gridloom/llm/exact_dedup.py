"""Exact deduplication by Grace hashing.

1. Fold: each map task streams its rows through an open-addressing table (a Python dict keyed by
   the whole text: equal hashes are settled by comparing complete content). The table is bounded
   in bytes; full tables are emitted and cleared. A third of all rows being one text thus leaves
   each task as one representative per table. The fold is written once to the shared folder.
2. Partition: representatives go to buckets by a hash of the content digest. Buckets whose
   distinct texts exceed ``bucket_bytes`` are split again by another hash, level by level, until
   each fits. Spark's shuffle files are the spill files, so a lost executor is recovered from
   lineage; nothing is kept in machine-local folders by hand.
3. Settle: each bucket streams through a table of complete texts, giving every representative the
   id that stays and the size of the group.
4. The verdict joins back to the rows on the representative's number, which is spread like the
   input, never on the text or digest of a hot group.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shuffle_partitions, written

_FOLDED = "doc_id long, text_sha256 string, rep long, first_top boolean, text string, n_bytes long, n long, top long"
_SETTLED = "rep long, keep_id long, keep_rep long, group_size long"


def _arrow(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))


_FOLDED_KINDS = {"doc_id": pa.int64(), "text_sha256": pa.string(), "rep": pa.int64(), "first_top": pa.bool_(), "text": pa.string(), "n_bytes": pa.int64(), "n": pa.int64(), "top": pa.int64()}
_SETTLED_KINDS = {"rep": pa.int64(), "keep_id": pa.int64(), "keep_rep": pa.int64(), "group_size": pa.int64()}


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _fold(table_bytes: int):
    def emit(table: dict[str, list], rep: int):
        out: dict[str, list] = {k: [] for k in _FOLDED_KINDS}
        for text, ids in table.items():
            raw = text.encode("utf-8")
            top, sha = None, hashlib.sha256(raw).hexdigest()
            for i in ids:
                top = _larger(top, i)
            at = ids.index(top)
            for k, i in enumerate(ids):
                for name, v in zip(_FOLDED_KINDS, (i, sha, rep, k == at, None if k else text, None if k else len(raw), None if k else len(ids), None if k else top), strict=True):
                    out[name].append(v)
            rep += 1
        return _arrow(out, _FOLDED_KINDS)

    def run(batches):
        rep = TaskContext.get().partitionId() << 40
        table: dict[str, list] = {}
        held = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += 8
                ids = table.get(text)
                if ids is None:
                    table[text] = [i]
                    held += len(text) + 100
                else:
                    ids.append(i)
                if held > table_bytes:
                    yield emit(table, rep)
                    rep += len(table)
                    table, held = {}, 0
        if table:
            yield emit(table, rep)

    return run


def _settle(batches):
    """Rows come bucket by bucket; the table holds one bucket's distinct texts."""

    def emit(table):
        out: dict[str, list] = {k: [] for k in _SETTLED_KINDS}
        for n, top, top_rep, reps in table.values():
            for r in reps:
                for name, v in zip(_SETTLED_KINDS, (r, top, top_rep, n), strict=True):
                    out[name].append(v)
        return _arrow(out, _SETTLED_KINDS)

    table: dict[str, list] = {}
    at = None
    for batch in batches:
        for bucket, rep, text, n, top in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if bucket != at:
                if table:
                    yield emit(table)
                table, at = {}, bucket
            entry = table.get(text)
            if entry is None:
                table[text] = [n, top, rep, [rep]]
                continue
            entry[0] += n
            entry[3].append(rep)
            best = _larger(entry[1], top)
            if best != entry[1] or (best == top and rep < entry[2]):
                entry[1], entry[2] = best, rep
    if table:
        yield emit(table)


def _bucketed(reps: DataFrame, bucket_bytes: int, fan_out: int, max_levels: int) -> DataFrame:
    """Adds ``bucket``: recursive hash partitioning until each bucket's distinct texts fit."""
    total = reps.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(shuffle_partitions(reps.sparkSession), 1 + 2 * total // bucket_bytes)
    keyed = reps.withColumn("bucket", F.pmod(F.xxhash64("text_sha256"), F.lit(n)))
    for level in range(1, max_levels + 1):
        sizes = keyed.groupBy("bucket", "text_sha256").agg(F.max("n_bytes").alias("b")).groupBy("bucket").agg(F.sum("b").alias("b"), F.count("*").alias("texts"))
        over = sizes.filter((F.col("b") > bucket_bytes) & (F.col("texts") > 1)).select("bucket", F.lit(True).alias("split"))
        if over.isEmpty():
            break
        part = F.pmod(F.xxhash64("text_sha256", F.lit(level)), F.lit(fan_out))
        keyed = keyed.join(over, "bucket", "left").withColumn("bucket", F.when(F.col("split"), F.xxhash64("bucket", F.lit(level), part)).otherwise(F.col("bucket"))).drop("split")
    return keyed


def grace_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20, table_bytes: int = 32 << 20, fan_out: int = 16, max_levels: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty texts are one group.
    The row with the largest doc_id of a group stays (null ids rank lowest; a group of null ids
    only has keep_id null and one kept row). Of rows that repeat id and text exactly one is kept.
    Whole texts are compared, however long. An empty table gives an empty result; other columns
    are ignored whatever their names.
    """
    folded = written(id_and_text(docs, id_col, text_col).mapInArrow(_fold(table_bytes), _FOLDED), "grace-fold")
    reps = folded.filter(F.col("text").isNotNull())
    keyed = _bucketed(reps, bucket_bytes, fan_out, max_levels)
    n = shuffle_partitions(docs.sparkSession)
    settled = keyed.select("bucket", "rep", "text", "n", "top").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle, _SETTLED)
    return folded.select("doc_id", "rep", "first_top", "text_sha256").join(settled, "rep").select("doc_id", "keep_id", "group_size", (F.col("first_top") & (F.col("rep") == F.col("keep_rep"))).alias("kept"), "text_sha256")
