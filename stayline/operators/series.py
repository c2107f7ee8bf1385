"""W3-W11 on series that no stay bounds (a device, a ward, a market feed): one key
may hold a third of all rows.

A plain window puts a whole key into one task.  Here the rows are numbered in the
order (keys, order) - range-partitioned, written once - and every key is cut into
blocks of ``block`` rows by that number.  Row frames of up to ``reach`` rows then need
only a halo: the last rows of a block stand in the next one as well, the first rows
in the one before.  State that reaches further back (last value, last observation)
is carried: a summary of one row per block holds the block's last state, and its
running last over earlier blocks fills what a block's own rows cannot.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.expr import col as Q_
from stayline.functions.expr import true_or_false
from stayline.operators.ranking import group_rank, null_safe_join

NO, BLOCK, HALO = "_sr_no", "_sr_block", "_sr_halo"


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


class LongSeries:
    """Rows of ``df`` numbered from 0 inside each key.  ``order`` should be total;
    rows that tie are ordered by a hash of the row."""

    def __init__(self, df: DataFrame, keys, order, block: int = 100_000, reach: int = 1_000):
        if reach > block:
            raise ValueError("reach must not exceed the block")
        self.keys, self.block, self.reach, self.columns = _as_list(keys), block, reach, df.columns
        rows = group_rank(df, self.keys, _as_list(order), NO)
        self.rows = rows.withColumn(BLOCK, F.floor(F.col(NO) / block).cast("bigint"))

    def counter(self, out: str) -> "LongSeries":
        """Running row counter from 0."""
        return self._with(self.rows.withColumn(out, F.col(NO)))

    def _with(self, rows: DataFrame) -> "LongSeries":
        new = object.__new__(LongSeries)
        new.__dict__.update(self.__dict__, rows=rows)
        return new

    def frames(self, columns: Mapping[str, Callable[[list[str], str], Column]]) -> "LongSeries":
        """W4, W6-W9 and any row frame of at most ``reach`` rows to either side: each
        function gets the partition keys and the order to build its window on,
        e.g. ``lambda keys, order: rolling_max("v", keys, 24, order)``."""
        inside = F.col(NO) - F.col(BLOCK) * self.block
        copies = F.array(F.struct(F.col(BLOCK).alias("b"), F.lit(False).alias("h")),
                         F.when((F.col(BLOCK) > 0) & (inside < self.reach), F.struct((F.col(BLOCK) - 1).alias("b"), F.lit(True).alias("h"))),
                         F.when(inside >= self.block - self.reach, F.struct((F.col(BLOCK) + 1).alias("b"), F.lit(True).alias("h"))))
        x = self.rows.withColumn("_sr_c", F.explode(F.filter(copies, lambda c: c.isNotNull())))
        x = x.withColumns({BLOCK: F.col("_sr_c.b"), HALO: F.col("_sr_c.h")}).drop("_sr_c")
        part = [*self.keys, BLOCK]
        x = x.withColumns({out: make(part, NO) for out, make in columns.items()})
        return self._with(x.where(~F.col(HALO)).drop(HALO))

    def _carried(self, local: Mapping[str, Column]) -> DataFrame:
        """The rows with ``_l_<name>`` (last non-null state of the block up to the row)
        and ``_c_<name>`` (that of earlier blocks)."""
        here = Window.partitionBy(*self.keys, BLOCK).orderBy(NO).rowsBetween(Window.unboundedPreceding, 0)
        x = self.rows.withColumns({f"_s_{n}": c for n, c in local.items()})
        ends = x.groupBy(*self.keys, BLOCK).agg(*[
            F.max_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col(NO))).alias(f"_c_{n}") for n in local])
        before = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*self.keys, BLOCK, *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in local])
        x = x.withColumns({f"_l_{n}": F.last(f"_s_{n}", ignorenulls=True).over(here) for n in local})
        return null_safe_join(x, ends, [*self.keys, BLOCK])

    def _drop_state(self, x: DataFrame, names) -> "LongSeries":
        return self._with(x.drop(*[f"_{k}_{n}" for k in "slc" for n in names]))

    def ffill(self, cols: Sequence[str]) -> "LongSeries":
        """Last non-null value at or before the row."""
        names = {f"{i}": Q_(c) for i, c in enumerate(cols)}
        x = self._carried(names)
        x = x.withColumns({c: F.coalesce(F.col(f"_l_{i}"), F.col(f"_c_{i}")) for i, c in enumerate(cols)})
        return self._drop_state(x, names)

    def since_observed(self, col: str, out: str) -> "LongSeries":
        """Rows since the last observation strictly before the row; 0 on the
        first row; counted from the start when never observed."""
        here = Window.partitionBy(*self.keys, BLOCK).orderBy(NO)
        seen = F.when(Q_(col).isNotNull(), F.col(NO))
        x = self._carried({"o": seen})
        last = F.coalesce(F.lag("_l_o").over(here), F.col("_c_o"), F.lit(0))
        x = x.withColumn(out, F.when(F.col(NO) == 0, F.lit(0)).otherwise(F.col(NO) - last).cast("double"))
        return self._drop_state(x, ["o"])

    def latest_state(self, a: str, b: str) -> "LongSeries":
        """Which of two flags was set last (``b`` wins in the same row)."""
        state = F.when(true_or_false(Q_(b) == 1), F.lit(2)).when(true_or_false(Q_(a) == 1), F.lit(1))
        x = self._carried({"st": state})
        now = F.coalesce(F.col("_l_st"), F.col("_c_st"))
        x = x.withColumn("_sr_now", now).withColumns({a: true_or_false(F.col("_sr_now") == 1), b: true_or_false(F.col("_sr_now") == 2)})
        return self._drop_state(x.drop("_sr_now"), ["st"])

    def frame(self) -> DataFrame:
        """The rows with the new columns."""
        return self.rows.drop(NO, BLOCK)
