"""The data model: a labelled cube as a long DataFrame, one row per cell.

``Cube`` holds no data. Dimensions and coordinates are key columns, variables are value columns,
column attributes live in the schema's metadata. Missing cells are absent rows or NULLs; NaN is
turned to NULL on the way in, since Spark's aggregates skip NULL but propagate NaN.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    dims: tuple[str, ...]
    vars: tuple[str, ...]
    coords: tuple[str, ...] = ()
    attrs: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, dims, variables=None, coords=(), attrs: dict | None = None) -> Cube:
        """A cube of a long frame; variables default to the columns that are neither dimension nor
        coordinate. NaN values become NULL."""
        dims, coords = names(dims), names(coords)
        chosen = names(variables) if variables is not None else tuple(c for c in df.columns if c not in (*dims, *coords))
        kinds = {f.name: f for f in df.schema}
        columns = [F.col(c) for c in (*dims, *coords)]
        for v in chosen:
            c = F.col(v)
            if isinstance(kinds[v].dataType, (DoubleType, FloatType)):
                c = F.when(~F.isnan(c), c)
            columns.append(c.alias(v, metadata=kinds[v].metadata))
        return cls(df.select(*columns), dims, chosen, coords, dict(attrs or {}))

    def meta(self, column: str) -> dict:
        return dict(self.df.schema[column].metadata or {})

    def with_meta(self, column: str, **values) -> Cube:
        kept = {k: v for k, v in {**self.meta(column), **values}.items() if v is not None}
        return self.with_df(self.df.withMetadata(column, kept))

    def with_df(self, df: DataFrame, **changes) -> Cube:
        return replace(self, df=df, **changes)

    def without(self, *dims: str) -> tuple[str, ...]:
        return tuple(d for d in self.dims if d not in dims)



def names(x) -> tuple[str, ...]:
    """None, a name or names as a tuple."""
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


def labelled(name: str, label: str | None) -> str:
    """Variable name with the label of the statistic, if there is one."""
    return f"{name}_{label}" if label else name


def aggregated(cube: Cube, keys: list[Column | str], out_dims, exprs: dict[str, Column], sources: dict[str, str] | None = None) -> Cube:
    """Grouped aggregation in one pass over all variables. Column attributes, which aggregates
    lose, are put back from the source variables; coordinates that are not grouped by go."""
    grouped = cube.df.groupBy(*keys) if keys else cube.df.groupBy()
    out = grouped.agg(*[e.alias(n) for n, e in exprs.items()])
    for new, old in (sources or {}).items():
        if kept := cube.meta(old):
            out = out.withMetadata(new, kept)
    return replace(cube, df=out, dims=tuple(out_dims), vars=tuple(exprs), coords=())
