"""Window operators on the contiguous hourly panel.

All frames are ROW frames partitioned by stay and ordered by hour.  Panel rows
per stay are bounded by the stay's time span, so one stay per window partition
is safe; operators that share ``(keys, order)`` share one exchange and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.expr import col as Q_
from stayline.functions.expr import hours, true_or_false


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def spec(keys, order="hour"):
    return Window.partitionBy(*_as_list(keys)).orderBy(*_as_list(order))


def ffill_col(c, keys, order="hour", limit: int | None = None) -> Column:
    """Last non-null value at or before the row (``limit`` rows back)."""
    w = spec(keys, order).rowsBetween(Window.unboundedPreceding if limit is None else -int(limit), 0)
    return F.last(Q_(c) if isinstance(c, str) else c, ignorenulls=True).over(w)


def ffill(df: DataFrame, cols: Sequence[str], keys, order="hour", limit: int | None = None) -> DataFrame:
    """Forward fill several columns with one window spec."""
    return df.withColumns({c: ffill_col(c, keys, order, limit) for c in cols})


def hours_since_start(keys, order="hour") -> Column:
    """Running row counter from 0."""
    return (F.row_number().over(spec(keys, order)) - 1).cast("bigint")


def rolling_max(c, keys, n: int, order="hour") -> Column:
    """Trailing n-row max (min_periods 0 -> NULL only when all missing)."""
    return F.max(Q_(c)).over(spec(keys, order).rowsBetween(-(n - 1), 0))


def future_max(c, keys, n: int, order="hour") -> Column:
    """The row and the next n-1 rows."""
    return F.max(Q_(c)).over(spec(keys, order).rowsBetween(0, n - 1))


def score_horizon(c, keys, n: int, mode: str = "reference", order="hour") -> Column:
    """Future max of the rolling max = max over rows t-(n-1)..t+(n-1).

    ``mode='future'`` gives the next-n-rows reading of the README."""
    if mode == "future":
        return future_max(c, keys, n, order)
    return F.max(Q_(c)).over(spec(keys, order).rowsBetween(-(n - 1), n - 1))


def rolling_mean(c, keys, n: int, default: float | None = 0.0, order="hour") -> Column:
    """Trailing n-row mean over present values (min_periods 1), then default."""
    m = F.avg(Q_(c)).over(spec(keys, order).rowsBetween(-(n - 1), 0))
    return m if default is None else F.coalesce(m, F.lit(default))


def observed_mask(c) -> Column:
    """1 when present, else 0."""
    return Q_(c).isNotNull().cast("int")


def time_since_observed(c, keys, order="hour") -> Column:
    """Rows since the last observation strictly before the row; 0 on a
    stay's first row; counted from the stay start when never observed."""
    w = spec(keys, order)
    rn = F.row_number().over(w)
    last_obs = F.max(F.when(Q_(c).isNotNull(), rn_plain(keys, order))).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(rn == 1, F.lit(0)).otherwise(rn - F.coalesce(last_obs, F.lit(1))).cast("double")


def rn_plain(keys, order="hour") -> Column:
    return F.row_number().over(spec(keys, order))


def latest_state(df: DataFrame, keys, a: str, b: str, order="hour") -> DataFrame:
    """State 1 when ``a`` == 1, 2 when ``b`` == 1 (b wins in the same
    row), forward filled; then two flags ``a`` (state 1) and ``b`` (state 2)."""
    state = F.when(true_or_false(F.col(b) == 1), F.lit(2)).when(true_or_false(F.col(a) == 1), F.lit(1))
    x = df.withColumn("_state", state)
    x = x.withColumn("_state", ffill_col("_state", keys, order))
    return x.withColumns({a: true_or_false(F.col("_state") == 1),
                          b: true_or_false(F.col("_state") == 2)}).drop("_state")


def horizon_label(event: str, t: str, horizon_hours: float) -> Column:
    """L1: event - t <= horizon; true also after the event; missing -> false."""
    return true_or_false((F.col(event) - F.col(t)) <= hours(horizon_hours))
