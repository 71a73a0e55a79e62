"""Column expressions: everything here stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.config import MISSING, SECONDS_PER_DAY

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floordiv(c: ColumnOrName, n: int) -> Column:
    """Division rounded toward minus infinity, so days before an anchor index correctly."""
    return F.floor(_col(c) / F.lit(n)).cast("long")


def mod(c: ColumnOrName, n: int) -> Column:
    return F.pmod(_col(c), F.lit(n))


def day_of(seconds: ColumnOrName) -> Column:
    return floordiv(seconds, SECONDS_PER_DAY).cast("int")


def hour_of(seconds: ColumnOrName) -> Column:
    return F.pmod(floordiv(seconds, 3600), F.lit(24)).cast("int")


def weekday_of(seconds: ColumnOrName) -> Column:
    return F.pmod(floordiv(seconds, SECONDS_PER_DAY), F.lit(7)).cast("int")


def null_nan(c: ColumnOrName) -> Column:
    """NaN as NULL: Spark orders NaN above every number and aggregates count it as a value."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def level(c: ColumnOrName) -> Column:
    """A key as text, with null a level of its own."""
    return F.coalesce(_col(c).cast("string"), F.lit(MISSING))


def thousandths(c: ColumnOrName) -> Column:
    """Amount in thousandths, rounded half to even."""
    return F.rint(_col(c) * 1000).cast("long")


def is_whole(c: ColumnOrName) -> Column:
    return F.pmod(thousandths(c), F.lit(1000)) == 0


def is_round_in_band(c: ColumnOrName, step: float, low: float, high: float) -> Column:
    """A multiple of `step` inside the closed band, decided on thousandths."""
    t = thousandths(c)
    unit = round(step * 1000)
    return (F.pmod(t, F.lit(unit)) == 0) & t.between(round(low * 1000), round(high * 1000))


def log_amount(c: ColumnOrName) -> Column:
    return F.log1p(_col(c))


def hour_cycle(c: ColumnOrName) -> tuple[Column, Column]:
    """The hour as a point on the unit circle."""
    angle = _col(c).cast("double") * F.lit(2 * 3.141592653589793 / 24)
    return F.sin(angle), F.cos(angle)


def presence(c: ColumnOrName) -> Column:
    return _col(c).isNotNull().cast("byte")


def coverage(columns: Sequence[str]) -> Column:
    """How many of the expected inputs a row carries."""
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))


def clip(c: ColumnOrName, low: float, high: float) -> Column:
    """Clamp; a null stays null, which `greatest`/`least` alone would not give."""
    column = _col(c)
    return F.when(column.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), column)))


def expit(c: ColumnOrName) -> Column:
    return 1 / (1 + F.exp(-_col(c)))


def logit(c: ColumnOrName, eps: float) -> Column:
    p = clip(c, eps, 1 - eps)
    return F.ln(p) - F.log1p(-p)


def in_range(c: ColumnOrName, low: float, high: float) -> Column:
    """Closed-range test; null is false."""
    return F.coalesce(_col(c).between(low, high), F.lit(False))


def equals(c: ColumnOrName, value: object) -> Column:
    """Equality test; null is false."""
    return F.coalesce(_col(c) == F.lit(value), F.lit(False))


def literal_map(values: Mapping[str, float | int | str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def map_lookup(c: ColumnOrName, values: Mapping, default: object = None) -> Column:
    """A fixed small map applied as a literal: no join and no shuffle."""
    if not values:
        return F.lit(default)
    found = F.try_element_at(literal_map(values), _col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def band(c: ColumnOrName, moderate: float, significant: float) -> Column:
    """Name of the stability band an index falls in."""
    column = _col(c)
    return (
        F.when(column < moderate, "stable")
        .when(column < significant, "moderate")
        .when(column.isNotNull(), "significant")
    )


def to_body(columns: Sequence[str]) -> Column:
    """The row as JSON text with nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
