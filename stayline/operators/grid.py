"""Reshaping and the hourly panel: one-hot (R1), pivot (R2), contiguous hourly
grid (R3), interval spreading (R4), as-of attachment (J6-J8).

Scale notes
-----------
* Raw events are combined per ``(stay, timestamp, label)`` before the first
  exchange, which spreads a hot stay, and a hot hour, over its timestamps; only
  the means move on to ``(stay, hour)`` for the median.
* Everything after that is hourly data: rows per stay are bounded by the stay's
  time span (a stay of a year is 8,760 rows) whatever the event volume, so the
  panel windows partition by stay.
* The contiguous grid is produced without a spine join: each present hour emits
  itself plus the empty hours up to the next present hour (``lead`` +
  ``sequence``), in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.expr import col as Q_
from stayline.functions.expr import floor_hour, true_or_false
from stayline.operators.ranking import PID, POS, null_safe_join, range_numbered

def one_hour():
    return F.make_dt_interval(hours=F.lit(1))


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- R1 one-hot
def one_hot(df: DataFrame, c: str, domain: Sequence[str], prefix: str | None = None,
            sep: str = ", ", drop: bool = True) -> DataFrame:
    """One boolean column per domain value; a NULL row is all false."""
    cols = {}
    for v in domain:
        name = f"{prefix}{sep}{v}" if prefix else v
        cols[name] = true_or_false(Q_(c) == F.lit(v))
    out = df.withColumns(cols)
    return out.drop(c) if drop else out


# ---------------------------------------------------------------- R2 pivot
def known_label(label: str, labels: Sequence[str]) -> Column:
    """The label; one that the caller did not list stops the job."""
    return F.when(F.col(label).isin(list(labels)), F.col(label)).otherwise(
        F.raise_error(F.concat(F.lit("unlisted label: "), F.col(label))))


def label_domain(df: DataFrame, label: str, most: int = 2000) -> list[str]:
    """The labels that occur, sorted: columns of a pivot.  More than ``most`` stop
    the job, so no more than that ever reach the driver."""
    rows = df.select(F.col(label).alias("l")).where(F.col("l").isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels in {label}")
    return sorted(r["l"] for r in rows)


def pivot_labels(df: DataFrame, keys, label: str, value: str, labels: Sequence[str] | None = None,
                 agg: str = "avg", unlisted: str = "error") -> DataFrame:
    """R2: long -> wide, one aggregate per label; ``labels`` default to all that occur.

    Conditional aggregation (``agg(CASE WHEN label = L THEN v END)``) is one
    hash aggregate with map-side combine; rows whose labels are all missing
    and NULL labels are dropped like the pandas pivot table.  A label outside
    ``labels`` stops the job (``unlisted="drop"``: its rows are left out on purpose).
    """
    keys = _as_list(keys)
    fn = {"avg": F.avg, "median": F.median, "sum": F.sum, "max": F.max, "min": F.min}[agg]
    x = df.where(F.col(label).isNotNull() & F.col(value).isNotNull())
    labels = label_domain(x, label) if labels is None else list(labels)
    if unlisted == "drop":
        x = x.where(F.col(label).isin(labels))
    x = x.select(*keys, (F.col(label) if unlisted == "drop" else known_label(label, labels)).alias("_label"),
                 F.col(value).alias("_v"))
    return x.groupBy(*keys).agg(*[fn(F.when(F.col("_label") == F.lit(L), F.col("_v"))).alias(L) for L in labels])


# ---------------------------------------------------------------- R3 grid
def fill_grid(wide: DataFrame, keys, hour: str = "hour") -> DataFrame:
    """Make an hourly table contiguous per stay: missing hours become rows of
    NULLs between the first and the last present hour."""
    keys = _as_list(keys)
    w = Window.partitionBy(*keys).orderBy(hour)
    nxt = F.lead(hour).over(w)
    x = wide.withColumn("_upto", F.coalesce(nxt - one_hour(), F.col(hour)))
    x = x.withColumn("_h", F.explode(F.sequence(F.col(hour), F.col("_upto"), one_hour())))
    vals = [c for c in wide.columns if c not in keys and c != hour]
    present = F.col("_h") == F.col(hour)
    return x.select(*keys, F.col("_h").alias(hour),
                    *[F.when(present, Q_(c)).alias(c) for c in vals])


def hourly_grid(df: DataFrame, keys, t: str, label: str, value: str, labels: Sequence[str],
                hour: str = "hour", first_times: Sequence[str] = (), unlisted: str = "error") -> DataFrame:
    """Mean per timestamp, median per hour, contiguous hours per stay.

    Output: ``keys, hour, <one double column per label>``; the grid runs from
    the first to the last hour holding any value; empty hours are NULL.
    ``first_times`` adds ``<label>_first_time`` = earliest timestamp of that
    label in the hour (computed in the same aggregate, so an outcome time
    needs no second pass over the events).  A label outside ``labels`` stops the
    job (``unlisted="drop"``: its rows are left out on purpose).
    """
    keys = _as_list(keys)
    x = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    if unlisted == "drop":
        x = x.where(F.col(label).isin(list(labels)))
    lab = F.col(label) if unlisted == "drop" else known_label(label, labels)
    x = x.select(*keys, F.col(t).alias("_t"), lab.alias("_label"),
                 F.col(value).cast("double").alias("_v"))
    tmean = x.groupBy(*keys, "_t", "_label").agg(F.avg("_v").alias("_v")).withColumn(hour, floor_hour("_t"))
    wide = tmean.groupBy(*keys, hour).agg(
        *[F.median(F.when(F.col("_label") == F.lit(L), F.col("_v"))).alias(L) for L in labels],
        *[F.min(F.when(F.col("_label") == F.lit(L), F.col("_t"))).alias(f"{L}_first_time") for L in first_times])
    return fill_grid(wide, keys, hour)


# ---------------------------------------------------------------- R4 spread
def hourly_amount(start: str, end: str, amount: str):
    """amount / (hours between floored ends + 1), the per-hour share."""
    h = F.timestamp_diff("HOUR", floor_hour(start), floor_hour(end))
    return F.col(amount) / (h + F.lit(1)).cast("double")


def spread_intervals(df: DataFrame, keys, start: str, end: str, per_hour: str,
                     out: str, hour: str = "hour") -> DataFrame:
    """One row per hour from floor(start) to floor(end) inclusive, the
    per-hour amount summed per ``(keys, hour)``.  Reversed intervals give no
    rows (guarded: ``sequence`` would raise)."""
    keys = _as_list(keys)
    s, e = floor_hour(start), floor_hour(end)
    x = df.where(true_or_false(s <= e)).select(
        *keys, F.col(per_hour).alias("_a"), F.explode(F.sequence(s, e, one_hour())).alias(hour))
    return x.groupBy(*keys, hour).agg(F.sum("_a").alias(out))


def attach_hourly(panel: DataFrame, series: DataFrame, keys, cols: Sequence[str],
                  default=None, hour: str = "hour") -> DataFrame:
    """Left join per-hour series onto the panel; optional default.
    An existing panel column of the same name is replaced."""
    keys = _as_list(keys)
    base = panel.drop(*[c for c in cols if c in panel.columns])
    out = base.join(series.select(*keys, hour, *cols), on=[*keys, hour], how="left")
    if default is not None:
        out = out.withColumns({c: F.coalesce(Q_(c), F.lit(default)) for c in cols})
    return out


# ---------------------------------------------------------------- J6 as-of
def asof_to_grid(events: DataFrame, grid_bounds: DataFrame, keys, t: str,
                 lo: str = "first_hour", hi: str = "last_hour",
                 tolerance_hours: float = 1, hour: str = "hour") -> DataFrame:
    """J6 on a contiguous hourly grid: nearest grid hour, ties to the earlier
    hour, tolerance inclusive.  Nearest = floor(t + 30 min - 1 us) clamped to the
    stay's first/last hour; kept when |t - hour| <= tolerance.  One equi-join
    with the per-stay bounds, no as-of machinery."""
    keys = _as_list(keys)
    half = F.make_dt_interval(mins=F.lit(29), secs=F.lit(59.999999))
    near = floor_hour(F.col(t) + half)
    x = events.join(grid_bounds, on=keys, how="inner")
    clamped = F.when(near < F.col(lo), F.col(lo)).when(near > F.col(hi), F.col(hi)).otherwise(near)
    tol = F.make_dt_interval(secs=F.lit(float(tolerance_hours) * 3600))
    x = x.withColumn(hour, clamped)
    dist = F.when(F.col(t) >= F.col(hour), F.col(t) - F.col(hour)).otherwise(F.col(hour) - F.col(t))
    return x.where(dist <= tol).drop(lo, hi)


def asof_nearest(left: DataFrame, right: DataFrame, by, lt: str, rt: str,
                 payload: Sequence[str], tolerance_hours: float = 1,
                 partitions: int | None = None) -> DataFrame:
    """J6 general form: for each left row the nearest right row of the same
    ``by`` key within the tolerance (inclusive); exact matches allowed; a tie
    goes to the earlier right row.  Output: left columns + ``payload`` of the
    matched right row (+ ``match_t``); unmatched left rows keep NULLs.

    Both sides are united in (key, time) order, range-partitioned and written
    once, so a hot key is cut into balanced pieces.  Windows per (key, piece)
    find the nearest right row before and after inside a piece; a summary (first
    and last right row per key and piece) carries those of other pieces.
    """
    keys = _as_list(by)
    tol_iv = F.make_dt_interval(secs=F.lit(float(tolerance_hours) * 3600))
    lcols = list(left.columns)
    r = right.select(*keys, F.col(rt).alias("_rt"), *[Q_(p).alias(f"_p_{p}") for p in payload])
    r = r.where(F.col("_rt").isNotNull()).withColumn("_side", F.lit(0)).withColumn("_sort_t", F.col("_rt"))
    for c in lcols:
        if c not in keys:
            r = r.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    l = left.withColumn("_side", F.lit(1)).withColumn("_sort_t", F.col(lt)) \
            .withColumn("_rt", F.lit(None).cast("timestamp_ntz"))
    for p in payload:
        l = l.withColumn(f"_p_{p}", F.lit(None).cast(right.schema[p].dataType))
    # at one time right rows stand first, so that an exact match lies before
    u = range_numbered(l.unionByName(r), keys, ["_sort_t", "_side"], partitions)
    rs = F.when(F.col("_side") == 0, F.struct(F.col("_rt").alias("t"), *[F.col(f"_p_{p}").alias(p) for p in payload]))
    u = u.withColumn("_r", rs)
    w = Window.partitionBy(PID, *keys).orderBy(POS)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    summ = u.groupBy(PID, *keys).agg(
        F.max_by(F.when(F.col("_side") == 0, F.col("_r")), F.when(F.col("_side") == 0, F.col(POS))).alias("_la"),
        F.min_by(F.when(F.col("_side") == 0, F.col("_r")), F.when(F.col("_side") == 0, F.col(POS))).alias("_fi"))
    c = Window.partitionBy(*keys).orderBy(PID)
    summ = summ.select(PID, *keys,
                       F.last("_la", ignorenulls=True).over(c.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
                       F.first("_fi", ignorenulls=True).over(c.rowsBetween(1, Window.unboundedFollowing)).alias("_cf"))
    u = u.withColumn("_b0", F.last("_r", ignorenulls=True).over(back)) \
         .withColumn("_f0", F.first("_r", ignorenulls=True).over(fwd))
    u = null_safe_join(u.where(F.col("_side") == 1), summ, [PID, *keys])
    u = u.withColumn("_b", F.coalesce("_b0", "_cb")).withColumn("_f", F.coalesce("_f0", "_cf"))
    bd = F.col(lt) - F.col("_b.t")
    fd = F.col("_f.t") - F.col(lt)
    pick_b = F.col("_b").isNotNull() & (F.col("_f").isNull() | (bd <= fd))
    best = F.when(pick_b, F.col("_b")).otherwise(F.col("_f"))
    u = u.withColumn("_m", best)
    dist = F.when(F.col(lt) >= F.col("_m.t"), F.col(lt) - F.col("_m.t")).otherwise(F.col("_m.t") - F.col(lt))
    u = u.withColumn("_m", F.when(true_or_false(dist <= tol_iv), F.col("_m")))
    return u.select(*lcols, F.col("_m.t").alias("match_t"),
                    *[F.col(f"_m.{p}").alias(p) for p in payload])
