"""Stay construction: sessionize (W1), stay roll-up (AG1), first stay per key
(W2), length filters (PF6), end capping (F9), outcome flag (L2).

Scale notes
-----------
``sessionize`` is a gap-based running count.  A plain window partitioned by
the key puts a hot key (a third of all rows) into a single task, so:

1. rows are range-partitioned on ``(key, start, end, tie-break)``, numbered and
   written once (``ranking.range_numbered``): sampled bounds cut a hot key into
   as many partitions as its rows fill, whatever its time span;
2. rows are windowed per ``(key, partition)``: local ``lag`` and running count of
   breaks;
3. a summary (last row's end, break count) of the keys that a partition's bound cuts,
   at most one a partition, gets the carry with a window over partitions and is
   broadcast back: all other rows are shuffled once, for the windows.

Keys may be NULL: rows without a key are a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.expr import hours, least_present, true_or_false
from stayline.operators.ranking import PID, POS, null_safe_join, range_numbered
from stayline.session import cut_lineage

def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def sessionize(df: DataFrame, key, start: str, end: str, gap_hours: float = 24,
               out: str = "session_no", partitions: int | None = None,
               tiebreak: Sequence[str] = (), running_end: bool = False) -> DataFrame:
    """Number contiguous records per key (1, 2, ...).

    A new session starts at the key's first row and whenever
    ``start - previous_row.end > gap`` (the previous row in ``(start, end)``
    order, not the running maximum).  A missing previous end never splits.
    ``running_end=True`` compares with the largest end seen so far instead
    (a nested record then never splits a stay).  Rows without a start sort last.
    """
    keys = _as_list(key)
    gap = F.make_dt_interval(hours=F.lit(int(gap_hours))) if float(gap_hours).is_integer() \
        else F.make_dt_interval(secs=F.lit(float(gap_hours) * 3600))
    order = [F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last()] + \
        [F.col(t).asc_nulls_last() for t in tiebreak]
    x = range_numbered(df, keys, order, partitions)
    local = Window.partitionBy(PID, *keys).orderBy(POS)
    upto, before = (local.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    chunks = Window.partitionBy(*keys).orderBy(PID)
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    breaks = lambda prev: true_or_false((F.col(start) - prev) > gap).cast("int")

    # a key cut by a partition's bound heads the later partition: only these keys, one
    # a partition at most, have anything to hand on
    heads = F.broadcast(x.where(F.col(POS) == 0).select(*keys).distinct())
    cut = null_safe_join(x, heads, keys, "left_semi")

    # what the rows of earlier partitions hand on: their last (or largest) end
    ends = F.max(end) if running_end else F.max_by(F.col(end), F.col(POS))
    carry = cut.groupBy(PID, *keys).agg(ends.alias("_end"))
    handed = F.max("_end").over(earlier) if running_end else F.lag("_end").over(chunks)
    carry = carry.select(PID, *keys, handed.alias("_carry"), F.lag(F.lit(1)).over(chunks).alias("_later"))
    carry = F.broadcast(cut_lineage(carry.where(F.col("_later").isNotNull())))  # joined twice
    first_here = F.lag(F.lit(1)).over(local).isNull()
    if running_end:
        prev = F.greatest(F.max(end).over(before), F.col("_carry"))
    else:
        prev = F.when(first_here, F.col("_carry")).otherwise(F.lag(end).over(local))

    def counted(rows: DataFrame) -> DataFrame:
        r = null_safe_join(rows, carry, [PID, *keys], "left")
        return r.withColumn("_brk", F.when(first_here & F.col("_later").isNull(), F.lit(1)).otherwise(breaks(prev)))

    n = counted(cut).groupBy(PID, *keys).agg(F.sum("_brk").alias("_n"))
    n = n.select(PID, *keys, F.sum("_n").over(earlier).alias("_offset")).where(F.col("_offset") > 0)
    x = counted(x).withColumn("_cum", F.sum("_brk").over(upto))
    res = null_safe_join(x, F.broadcast(n), [PID, *keys], "left").withColumn("_offset", F.coalesce("_offset", F.lit(0)))
    res = res.withColumn(out, (F.col("_offset") + F.col("_cum")).cast("bigint"))
    return res.select(*[f"`{c}`" for c in df.columns if c != out], out)


def daily_records(df: DataFrame, key, t: str, start: str = "first_at", end: str = "last_at") -> DataFrame:
    """Points in time as records for ``sessionize``: one per key and calendar day, from
    the day's first point to its last.  Points of a day are less than 24 hours apart,
    so with a gap of 24 hours or more the sessions have the same ends as those of the
    points.  Combined before the shuffle; points without a time are one record."""
    x = df.groupBy(*_as_list(key), F.to_date(t).alias("_day")).agg(F.min(t).alias(start), F.max(t).alias(end))
    return x.drop("_day")


def rollup_stays(df: DataFrame, keys, start: str, end: str,
                 flag_col: str | None = None, flag_values: Sequence[str] = (),
                 start_out: str = "intime", end_out: str = "outtime",
                 sums: dict[str, str] | None = None) -> DataFrame:
    """AG1: min start, max end and 'visited X' flags per stay; null keys dropped.
    ``sums`` adds sums of columns (output name -> column) in the same pass."""
    keys = _as_list(keys)
    aggs = [F.min(start).alias(start_out), F.max(end).alias(end_out)]
    for v in flag_values:
        aggs.append(F.coalesce(F.bool_or(F.col(flag_col) == F.lit(v)), F.lit(False)).alias(v))
    aggs += [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond).groupBy(*keys).agg(*aggs)


def first_per_key(df: DataFrame, key, order: Sequence, tiebreak: Sequence = ()) -> DataFrame:
    """First row per key in ``order``; ties broken by ``tiebreak``.

    Planned as ``WindowGroupLimit`` (top-1 kept map side before the shuffle),
    so a hot key sends one row per map task, not all of its rows.
    """
    keys = _as_list(key)
    cols = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in list(order) + list(tiebreak)]
    w = Window.partitionBy(*keys).orderBy(*cols)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def length_between(start: str, end: str, lo_hours: float | None = None,
                   hi_hours: float | None = None) -> Column:
    """PF6: lo <= end - start <= hi (both inclusive) as an interval comparison."""
    d = F.col(end) - F.col(start)
    cond = F.lit(True)
    if lo_hours is not None:
        cond = cond & (d >= hours(lo_hours))
    if hi_hours is not None:
        cond = cond & (d <= hours(hi_hours))
    return true_or_false(cond)


def cap_end(end: str, *limits: str) -> Column:
    """end replaced by an earlier limit (death, discharge); nulls ignored."""
    return F.when(F.col(end).isNotNull(), least_present(end, *limits))


def outcome_within(event: str, ref: str, horizon_hours: float) -> Column:
    """L2 / L1: event - ref <= horizon, missing -> False (true also after)."""
    return true_or_false((F.col(event) - F.col(ref)) <= hours(horizon_hours))
