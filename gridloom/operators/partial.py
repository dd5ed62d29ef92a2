"""User statistics with partial aggregation: a group's cells needn't fit one task.

A ``Partial`` says how a state begins, takes in an array of values, and is merged with another. Every
task makes states of its own cells, some hundred thousand cells at a time; states of a group are merged first
within parts, then over them.
"""

from __future__ import annotations

import pickle
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from ..cube import Cube

#: Cells that are grouped at a time; parts that a group's states are merged in first.
CELLS, PARTS = 1 << 18, 64


class Partial:
    """A statistic in steps. ``update`` gets the valid values of some of a group's cells, in no order."""

    def init(self):
        raise NotImplementedError

    def update(self, state, values: np.ndarray):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def result(self, state) -> float | None:
        raise NotImplementedError


def _states(how: Partial, keys: int, names: list[str]):
    """Rows (keys..., values...): states of the groups of each run of cells."""

    def emit(parts):
        table = pa.Table.from_batches(parts)
        columns = [f"k{i}" for i in range(keys)] + names[keys:]
        table = table.rename_columns(columns)
        group = table.group_by(columns[:keys], use_threads=False).aggregate([(c, "list") for c in columns[keys:]])
        made = []
        for c in columns[keys:]:
            lists = group[f"{c}_list"].combine_chunks()
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
            made.append(pa.array([pickle.dumps(how.update(how.init(), v[~np.isnan(v)])) for v in (values[a:b] for a, b in zip(ends, ends[1:], strict=False))], pa.binary()))
        own = [group[c].combine_chunks() for c in columns[:keys]]
        return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (*own, *made)], names=names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch)
            if held >= CELLS:
                yield emit(parts)
                parts, held = [], 0
        if held:
            yield emit(parts)

    return run


def _merged(how: Partial, keys: int, last: bool):
    """Rows (keys..., states...) sorted by the keys: one for each, with results if ``last``."""

    def run(batches):
        at, held = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            out = []
            for row in rows:
                key, own = row[:keys], [pickle.loads(s) for s in row[keys:]]
                if key == at:
                    held = [how.merge(a, b) for a, b in zip(held, own, strict=True)]
                    continue
                if held is not None:
                    out.append((at, held))
                at, held = key, own
            if out:
                yield emit(out, batch.schema)
            schema = batch.schema
        if held is not None:
            yield emit([(at, held)], schema)

    def emit(rows, schema):
        columns = [pa.array([k[i] for k, _ in rows], schema.field(i).type) for i in range(keys)]
        for j in range(keys, len(schema)):
            own = [h[j - keys] for _, h in rows]
            columns.append(pa.array([how.result(s) for s in own], pa.float64()) if last else pa.array([pickle.dumps(s) for s in own], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def partial_reduce(cube: Cube, keys: tuple[str, ...], how: Partial, out: dict[str, str]) -> Cube:
    """One row for each group; a group without a valid value gives the result of the state that no value has
    updated."""
    df = cube.df.select(*keys, *[F.col(v).cast("double").alias(v) for v in cube.vars])
    if not keys:
        df = df.select(F.lit(0).alias("__all"), *cube.vars)
    by = list(keys) or ["__all"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [StructField(f.name, f.dataType) for f in df.schema if f.name in by]
    states = StructType(own + [StructField(v, BinaryType()) for v in cube.vars])
    results = StructType(own + [StructField(v, DoubleType()) for v in cube.vars])
    made = df.mapInArrow(_states(how, len(by), df.columns), states)
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("__part")
    dealt = made.select(part, *by, *cube.vars).repartition(n, "__part", *by).sortWithinPartitions("__part", *by)
    first = dealt.mapInArrow(_merged(how, len(by) + 1, False), StructType([StructField("__part", dealt.schema["__part"].dataType), *states]))
    done = first.drop("__part").repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_merged(how, len(by), True), results)
    rows: DataFrame = done.select(*keys, *[F.col(v).alias(out[v], metadata=cube.meta(v)) for v in cube.vars])
    return replace(cube, df=rows, dims=keys, vars=tuple(out.values()), coords=())
