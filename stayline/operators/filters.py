"""Row filters and conditional updates (PF2-PF5, PF11, PF12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import col, true_or_false


def where_matches(c, pattern: str) -> Column:
    """PF2: regex match, NULL text -> False (Java regex, ``find`` semantics)."""
    return true_or_false(col(c).rlike(pattern))


def is_in(c, values: Sequence) -> Column:
    """PF4: IN a literal list; NULL -> False."""
    return true_or_false(col(c).isin(list(values)))


def not_in(c, values: Sequence) -> Column:
    """PF4: NOT IN where NULL counts as 'not in' (pandas ``~isin``)."""
    return ~true_or_false(col(c).isin(list(values)))


def keep_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """PF3: membership filter against another table's keys (left semi join).

    A semi join never multiplies rows, so duplicates in ``keys`` are harmless;
    the planner picks broadcast or shuffle from measured sizes (AQE)."""
    return df.join(keys, on=on, how="left_semi")


def update_when(df: DataFrame, rules: Sequence[tuple[Column, str, object]]) -> DataFrame:
    """PF11: ordered ``loc[mask, col] = value`` updates; a later rule sees the
    results of earlier ones (each rule is one projection; Catalyst collapses
    them into a single codegen'd projection)."""
    out = df
    for cond, c, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = out.withColumn(c, F.when(true_or_false(cond), v).otherwise(F.col(c)))
    return out


def drop_literal(df: DataFrame, label_col: str, label: str, value_col: str, value: str) -> DataFrame:
    """PF12: drop rows of one label carrying a literal value (e.g. device 'None')."""
    return df.where(~true_or_false((F.col(label_col) == label) & (F.col(value_col) == value)))


def columns_like(df: DataFrame, text: str) -> list[str]:
    """PF9: names of the columns containing ``text`` (schema only, no job)."""
    return [c for c in df.columns if text in c]


def columns_of(df: DataFrame, *types: str) -> list[str]:
    """PF9: names of the columns whose simple type is one of ``types``
    (e.g. ``'double'``, ``'boolean'``)."""
    return [c for c, t in df.dtypes if t in types]
