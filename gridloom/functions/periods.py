"""Calendar periods: resampling buckets with their labels, and datetime components with bins."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of frequencies, as period codes and as datetime components.
CODES = {"dayofyear": "D", "weekofyear": "W", "month": "MS", "hour": "h", "year": "YE", "month_start": "MS", "month_end": "ME", "week": "W", "day": "D"}
COMPONENTS = {"D": "dayofyear", "W": "weekofyear", "M": "month", "ME": "month", "MS": "month", "H": "hour", "h": "hour", "YE": "year", "Y": "year"}
BIN_MAXIMA = {"dayofyear": 366, "weekofyear": 53, "month": 12, "hour": 24}
SEASONS = ("DJF", "MAM", "JJA", "SON")
_FIXED = {"D": 86_400_000_000, "h": 3_600_000_000, "H": 3_600_000_000, "min": 60_000_000, "T": 60_000_000, "s": 1_000_000, "S": 1_000_000}


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), ntz(c))


def from_micros(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", c, F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Period:
    """n times a unit; code as pandas writes it."""

    n: int
    code: str

    @classmethod
    def parse(cls, frequency: str) -> Period:
        m = re.fullmatch(r"(\d*)\s*([A-Za-z_]+)(?:-[A-Z]{3})?", CODES.get(frequency, frequency))
        code = m and {"M": "ME", "Y": "YE", "A": "YE", "Q": "QE", "H": "h", "T": "min", "S": "s"}.get(m[2], m[2])
        if not m or code not in (*_FIXED, "W", "MS", "ME", "QS", "QE", "YS", "YE") or (m[1] and int(m[1]) < 1):
            raise ValueError(f"unknown frequency {frequency!r}")
        return cls(int(m[1] or 1), code)

    @property
    def anchored(self) -> bool:
        """Whether buckets count from the first label of the data."""
        return self.n > 1

    def label(self, t: Column, origin: Column | None = None) -> Column:
        """The bucket label of a time; ``origin``: the first time of the data, for anchored ones."""
        t = ntz(t)
        if self.code in _FIXED:
            if not self.anchored:
                unit = {"D": "day", "h": "hour", "min": "minute", "s": "second"}[self.code]
                return ntz(F.date_trunc(unit, t))
            size = self.n * _FIXED[self.code]
            start = micros(F.date_trunc("day", origin))
            return from_micros(start + F.floor((micros(t) - start) / size).cast("long") * size)
        if self.code == "W":
            day = micros(F.date_trunc("week", t)) + 6 * _FIXED["D"]
            if not self.anchored:
                return from_micros(day)
            first, size = micros(F.date_trunc("week", origin)) + 6 * _FIXED["D"], self.n * 7 * _FIXED["D"]
            return from_micros(first + F.ceil((day - first) / size).cast("long") * size)
        months = {"M": 1, "Q": 3, "Y": 12}[self.code[0]]
        size, ends = months * self.n, self.code.endswith("E")
        month = F.year(t) * 12 + F.month(t) - 1
        if not self.anchored:
            first = F.floor(month / months) * months
            return _month_end(first + months - 1) if ends else _month_start(first)
        base = F.floor((F.year(origin) * 12 + F.month(origin) - 1) / months) * months
        if ends:  # closed on the right: the first bucket is one unit long
            return _month_end(base + months - 1 + F.ceil((month - (base + months - 1)) / size) * size)
        return _month_start(base + F.floor((month - base) / size) * size)

    def sequence(self, low: Column, high: Column) -> Column:
        """All labels from one to another, as an array."""
        if self.code in _FIXED or self.code == "W":
            size = self.n * (_FIXED.get(self.code) or 7 * _FIXED["D"])
            return F.transform(F.sequence(micros(low), micros(high), F.lit(size)), from_micros)
        size = {"M": 1, "Q": 3, "Y": 12}[self.code[0]] * self.n
        month = F.sequence((F.year(low) * 12 + F.month(low) - 1).cast("int"), (F.year(high) * 12 + F.month(high) - 1).cast("int"), F.lit(size))
        return F.transform(month, _month_end if self.code.endswith("E") else _month_start)


def _month_start(month: Column) -> Column:
    m = month.cast("int")
    return ntz(F.make_date(F.floor(m / 12).cast("int"), F.pmod(m, F.lit(12)) + 1, F.lit(1)))


def _month_end(month: Column) -> Column:
    return ntz(F.last_day(_month_start(month).cast("date")))


def component(name: str, t: Column) -> tuple[str, Column]:
    """Output column name and value of a datetime component."""
    name = COMPONENTS.get(name, name)
    made = {
        "dayofyear": F.dayofyear,
        "weekofyear": F.weekofyear,
        "week": F.weekofyear,
        "month": F.month,
        "hour": F.hour,
        "year": F.year,
        "quarter": F.quarter,
        "day": F.dayofmonth,
        "dayofweek": F.weekday,
        "weekday": F.weekday,
        "minute": F.minute,
        "date": lambda x: x.cast("date"),
        "season": lambda x: F.element_at(F.array(*map(F.lit, SEASONS)), (F.floor((F.month(x) % 12) / 3) + 1).cast("int")),
    }
    if name not in made:
        raise ValueError(f"unknown datetime component {name!r}")
    return name, made[name](t)


def parse_component(frequency: str) -> tuple[str, int | None]:
    """'3MS' as ('month', 3), 'month' as ('month', None)."""
    m = re.fullmatch(r"(\d+)([A-Za-z]+)", frequency)
    if m and m[2] in COMPONENTS:
        return COMPONENTS[m[2]], int(m[1])
    return COMPONENTS.get(frequency, frequency), None


def bins(name: str, value: Column, widths: int | list[float] | tuple[float, ...]) -> Column:
    """Right edge of the half-open bin (a, b] of a component; values in none are null. An int makes
    bins of that width from 0; a list gives the edges."""
    if isinstance(widths, int):
        if name not in BIN_MAXIMA:
            raise ValueError(f"{name!r} has no bins of equal width; give the edges")
        edges = list(range(0, BIN_MAXIMA[name] + 1, widths))
    else:
        edges = sorted(widths)
    out = None
    for low, high in zip(edges, edges[1:], strict=False):
        inside = (value > low) & (value <= high)
        out = F.when(inside, F.lit(float(high))) if out is None else out.when(inside, F.lit(float(high)))
    if out is None:
        raise ValueError("bins need at least two edges")
    return out


def season_order(season: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEASONS)), season)


def parse_timedelta(x) -> timedelta:
    """timedelta, dict of its arguments, or text such as '12h', '1 day', '-90 minutes'."""
    if isinstance(x, timedelta):
        return x
    if isinstance(x, dict):
        return timedelta(**x)
    units = {"d": 86400, "day": 86400, "h": 3600, "hr": 3600, "hour": 3600, "m": 60, "min": 60, "minute": 60, "s": 1, "sec": 1, "second": 1, "w": 604800, "week": 604800, "ms": 1e-3, "millisecond": 1e-3}
    m = re.fullmatch(r"\s*([+-]?\d*\.?\d*)\s*([A-Za-z]+?)s?\s*", str(x))
    unit = m and (m[2].lower() if m[2].lower() in units else f"{m[2].lower()}s" if f"{m[2].lower()}s" in units else None)
    if not unit:
        raise ValueError(f"not a time span: {x!r}")
    return timedelta(seconds=float(m[1] if m[1] not in ("", "+", "-") else f"{m[1]}1") * units[unit])


#: Microseconds of the units that spans are named in.
_SPANS = {"days": _FIXED["D"], "hours": _FIXED["h"], "minutes": _FIXED["min"], "seconds": _FIXED["s"]}


def span_name(span: timedelta) -> str:
    """A span, also a negative one, in its largest unit: 'days' for one of it, else '(1.5 minutes)';
    below a second 'x milliseconds'. Six decimals; a hundred-thousandth off one still is one."""
    micros = span // timedelta(microseconds=1)
    fitting = {size: unit for unit, size in _SPANS.items() if size <= abs(micros)}
    if not fitting:
        return f"{micros / 1000} milliseconds"
    size = max(fitting)
    if 100_000 * abs(micros - size) <= max(micros, size):
        return fitting[size]
    amount = f"{micros / size:.6f}".rstrip("0").rstrip(".")
    return f"({amount} {fitting[size]})"


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "SSSSSS", "y": "yy"}


def datetime_pattern(fmt: str) -> str:
    """strftime format as Spark's datetime pattern; letters that are not directives are quoted."""
    out, at = [], 0
    for m in re.finditer(r"%(.)", fmt):
        out += [_literal(fmt[at : m.start()]), "%" if m[1] == "%" else _STRFTIME[m[1]]]
        at = m.end()
    return "".join([*out, _literal(fmt[at:])])


def _literal(text: str) -> str:
    return "".join(f"'{p}'" if i % 2 else p for i, p in enumerate(re.split(r"([A-Za-z0-9]+)", text)))


def with_origin(df: DataFrame, t: str, period: Period) -> tuple[DataFrame, Column | None]:
    """The frame with its first time in every row where the period is anchored; stays lazy: the
    first time is one row, joined to all."""
    if not period.anchored:
        return df, None
    first = df.agg(F.min(t).alias("__origin"))
    return df.crossJoin(F.broadcast(first)), F.col("__origin")


def time_range(t: Column, low: str | None, high: str | None) -> Column | None:
    """Label range, both ends in; a partial date stands for all of its period. None if either end is open."""
    if low is None or high is None:
        return None
    return (t >= F.lit(_bound(str(low), False)).cast("timestamp_ntz")) & (t < F.lit(_bound(str(high), True)).cast("timestamp_ntz"))


def _bound(text: str, after: bool) -> datetime:
    """Start of the period that a partial date names, or the start of the one after it."""
    for fmt, unit in (("%Y", "year"), ("%Y-%m", "month"), ("%Y-%m-%d", "day"), ("%Y-%m-%d %H", "hour"), ("%Y-%m-%dT%H", "hour"), ("%Y-%m-%d %H:%M", "minute"), ("%Y-%m-%dT%H:%M", "minute")):
        try:
            at = datetime.strptime(text, fmt)
        except ValueError:
            continue
        if not after:
            return at
        if unit == "year":
            return at.replace(year=at.year + 1)
        if unit == "month":
            return at.replace(year=at.year + at.month // 12, month=at.month % 12 + 1)
        return at + timedelta(**{f"{unit}s": 1})
    at = datetime.fromisoformat(text)
    return at + timedelta(seconds=1) if after and not at.microsecond else at
