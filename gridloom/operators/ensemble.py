"""Statistics over the members of an ensemble."""

from __future__ import annotations

from ..cube import Cube
from ..detect import find_axis
from ..functions import statistics as st
from . import reduce as core
from .temporal import _with


def reduce(cube: Cube, how: st.How = "mean", *, dim: str | None = None, **options) -> Cube:
    """Over the ensemble dimension; ValueError if there is none."""
    return core.reduce(cube, how, dim=dim or find_axis(cube, "realization", required=True), **options)


mean, median, std, min, max, sum = (_with(reduce, h, f"The {h} of the members.") for h in ("mean", "median", "std", "min", "max", "sum"))  # noqa: A001
standard_deviation = std
