"""Column expressions (JVM side, inside whole-stage codegen).

Conventions: missing is SQL NULL; pandas-style comparisons with missing are
false, so predicates are wrapped with ``coalesce(cond, false)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    """Column by exact name (dots, commas and spaces allowed) or pass-through."""
    if isinstance(c, str):
        return F.col("`" + c.replace("`", "``") + "`")
    return c


def true_or_false(cond: Column) -> Column:
    """pandas boolean semantics: a comparison with a missing value is False."""
    return F.coalesce(cond, F.lit(False))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def try_num(c) -> Column:
    """text -> double, unparsable text -> NULL (never raises under ANSI)."""
    return nan_to_null(col(c).try_cast("double"))


def safe_div(a, b, inf_as_null: bool = False) -> Column:
    """float division with pandas semantics: x/0 = +-inf, 0/0 = NULL;
    ``inf_as_null=True`` gives NULL for every zero denominator."""
    a, b = col(a), col(b)
    if inf_as_null:
        return F.when(b != 0, a / b)
    return (F.when(b == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)))
             .otherwise(a / b))


def floor_hour(c) -> Column:
    """floor a ``timestamp_ntz`` to the hour, time-zone free."""
    c = col(c)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                F.lit(0), F.lit(0))


def hours(n) -> Column:
    """Interval literal of ``n`` hours (whole hours)."""
    return F.make_dt_interval(hours=F.lit(int(n)))


def add_hours(c, n) -> Column:
    return col(c) + hours(n)


def hours_between(later, earlier) -> Column:
    """(later - earlier) in fractional hours as double."""
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / F.lit(3.6e9)


def least_present(*cols) -> Column:
    """smallest non-null value (Spark ``least`` already skips NULL)."""
    return F.least(*[col(c) for c in cols])


def clip_upper(c, hi) -> Column:
    """upper clip that keeps NULL (``least`` alone would return ``hi``)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(hi)))


def value_map(c, mapping: Mapping, default=None) -> Column:
    """literal value map, unmapped -> NULL (or ``default``)."""
    c = col(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None
               else out.when(c == F.lit(k), F.lit(v)))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def consolidate(c, merges: Mapping[str, Sequence[str]]) -> Column:
    """map listed source values onto a target, keep every other value."""
    c = col(c)
    out = None
    for target, sources in merges.items():
        cond = c.isin(list(sources))
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return c if out is None else out.otherwise(c)


def keep_or_other(c, keep: Iterable[str], other: str = "OTHER") -> Column:
    """keep values of a list, everything else (a missing value too) becomes ``other``."""
    c = col(c)
    return F.when(c.isin(list(keep)), c).otherwise(F.lit(other))


def regex_last_paren(c) -> Column:
    """text inside the last trailing parentheses; no match -> NULL."""
    v = F.regexp_extract(col(c), r".*\((.*)\)$", 1)
    return F.when(v != "", v)


def height_to_m(value, uom) -> Column:
    """inch -> cm -> m applied in sequence (value in inch or cm)."""
    v, u = col(value), col(uom)
    cm = F.when(true_or_false(u == "Inch"), v * 2.54).otherwise(v)
    return cm / 100.0


def fahrenheit_to_celsius(v) -> Column:
    return (col(v) - 32) * 5 / 9


_OPS = {
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
}


def threshold_score(c, op: str, cuts: Sequence[float]) -> Column:
    """ordinal 0..len(cuts); later (more severe) cuts win, NULL -> 0."""
    c = col(c)
    f = _OPS[op]
    out = None
    for level in range(len(cuts), 0, -1):
        cond = f(c, F.lit(cuts[level - 1]))
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return out.otherwise(F.lit(0))


def weighted_sum(flags: Mapping[str, float]) -> Column:
    """sum of int(flag) * weight, missing flag counts 0."""
    terms = [F.coalesce(col(f).cast("int"), F.lit(0)) * F.lit(w) for f, w in flags.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def sigmoid(c) -> Column:
    """F18."""
    return 1.0 / (1.0 + F.exp(-col(c)))


def explanation_link(concepts: Sequence, relevances: Sequence) -> Column:
    """1 - 1/exp(sum concept * relevance) over matching columns."""
    s = None
    for a, b in zip(concepts, relevances):
        t = col(a) * col(b)
        s = t if s is None else s + t
    return 1.0 - 1.0 / F.exp(s)


def bool_to_int(c) -> Column:
    return col(c).cast("int")
