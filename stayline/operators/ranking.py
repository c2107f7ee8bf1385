"""Distributed ranks and prefix sums without a single-partition window.

A window ``row_number() OVER (PARTITION BY g ORDER BY v)`` or a global
cumulative sum puts a whole group (or the whole table) into one task.  Here the
rows are range-partitioned on ``(g, v)`` (sampled bounds split a hot group over
many partitions), sorted inside each partition, numbered, and **written once** to
the shared checkpoint folder.  Partition number and position are then columns of
the written rows: everything derived from them - the per-partition counts as
well as the rows themselves - reads the same numbers, whatever the optimizer
prunes, reuses or re-partitions.  A table of about one row per partition and
group gives each partition's offset; no group is ever gathered into one task.
Groups with a NULL key are groups like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import cut_lineage

_LOW33 = (1 << 33) - 1
PID, POS = "_rk_pid", "_rk_pos"


def _as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def range_numbered(df: DataFrame, by, order, partitions: int | None = None) -> DataFrame:
    """``df`` in the order (by, order) with ``_rk_pid`` (partition, in order) and
    ``_rk_pos`` (place inside the partition), written once.  Equal sort keys lie
    in one partition."""
    keys = [*_as_list(by), *_as_list(order)]
    rng = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    num = rng.sortWithinPartitions(*keys).withColumn("_rk_id", F.monotonically_increasing_id())
    num = num.withColumn(PID, F.shiftright("_rk_id", 33)).withColumn(
        POS, F.col("_rk_id").bitwiseAND(F.lit(_LOW33))).drop("_rk_id")
    return cut_lineage(num)


def null_safe_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the left key columns stay."""
    on = _as_list(on)
    r = right.withColumnsRenamed({k: f"_ns_{k}" for k in on})
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"`_ns_{k}`"))
    return left.join(r, cond, how).drop(*[f"_ns_{k}" for k in on])


def group_rank(df: DataFrame, by, order, out: str = "_rank",
               partitions: int | None = None) -> DataFrame:
    """0-based rank of each row inside its ``by`` group in ``order`` (sort
    expressions allowed, e.g. ``F.col('v').desc()``); ties get distinct ranks
    (a hash of the row orders them, so a frequent value spreads over partitions)."""
    by, order = _as_list(by), _as_list(order)
    cols = df.columns
    x = df.withColumn("_rk_tie", F.xxhash64(*[F.col(f"`{c}`") for c in cols]))
    srt = range_numbered(x, by, [*order, "_rk_tie"], partitions)
    part = srt.groupBy(PID, *by).agg(F.min(POS).alias("_rk_first"), F.count(F.lit(1)).alias("_rk_cnt"))
    wp = Window.partitionBy(*by).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_rk_off", F.coalesce(F.sum("_rk_cnt").over(wp), F.lit(0)))
    res = null_safe_join(srt, part.drop("_rk_cnt"), [PID, *by])
    res = res.withColumn(out, (F.col("_rk_off") + F.col(POS) - F.col("_rk_first")).cast("bigint"))
    return res.select(*[f"`{c}`" for c in cols if c != out], out)


def hash_rank(df: DataFrame, by, digest: str, ties, out: str = "_rank", total: str | None = None,
              partitions: int | None = None) -> DataFrame:
    """0-based rank of each row inside its ``by`` group in the order (digest, ties)
    for a column of hex digests; ``total`` adds the group's size.

    Digests are even, so their leading digits cut a group into as many equal
    buckets as there are shuffle partitions, without sampling: ``df`` is evaluated
    once and written, and counts, offsets and ranks all read the written rows."""
    by, ties = _as_list(by), _as_list(ties)
    cols = df.columns
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * n / F.lit(1 << 32)).cast("int")
    x = cut_lineage(df.withColumn("_rk_b", bucket))
    part = x.groupBy(*by, "_rk_b").agg(F.count(F.lit(1)).alias("_rk_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_rk_b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*by, "_rk_b", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"),
                       F.sum("_rk_n").over(group).alias("_rk_all"))
    local = F.row_number().over(Window.partitionBy(*by, "_rk_b").orderBy(digest, *ties)) - 1
    res = null_safe_join(x.withColumn("_rk_pos", local), part, [*by, "_rk_b"])
    res = res.withColumn(out, (F.col("_rk_off") + F.col("_rk_pos")).cast("bigint"))
    return res.select(*[f"`{c}`" for c in cols if c not in (out, total)], out,
                      *([F.col("_rk_all").alias(total)] if total else []))


def prefix_sums(df: DataFrame, order, cols: Sequence[str], by=None, suffix: str = "_cum",
                partitions: int | None = None, totals: str | None = None, following: str | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order`` inside ``by`` groups; with
    ``totals`` also the group's sum under that suffix, with ``following`` the next
    row's values (null at a group's end): each piece hands its first row on to the
    piece before it."""
    by, order = _as_list(by), _as_list(order)
    names = df.columns
    srt = range_numbered(df, by, order, partitions)
    part = srt.groupBy(PID, *by).agg(*[F.sum(c).alias(f"_rkt_{c}") for c in cols])
    group = Window.partitionBy(*by)
    frame = group.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(PID, *by, *[F.coalesce(F.sum(f"_rkt_{c}").over(frame), F.lit(0)).alias(f"_rko_{c}") for c in cols],
                       *([F.sum(f"_rkt_{c}").over(group).alias(f"{c}{totals}") for c in cols] if totals else []))
    wo = Window.partitionBy(PID, *by).orderBy(POS)
    wl = wo.rowsBetween(Window.unboundedPreceding, 0)
    loc = srt.withColumns({f"_rkl_{c}": F.sum(c).over(wl) for c in cols})
    if following:
        first = srt.groupBy(PID, *by).agg(*[F.min_by(c, POS).alias(f"_rkf_{c}") for c in cols])
        first = first.select(PID, *by, *[F.lead(f"_rkf_{c}").over(group.orderBy(PID)).alias(f"_rkf_{c}") for c in cols])
        part = null_safe_join(part, first, [PID, *by])
        loc = loc.withColumns({f"_rkn_{c}": F.lead(c).over(wo) for c in cols})
    res = null_safe_join(loc, part, [PID, *by])
    return res.select(*[f"`{c}`" for c in names],
                      *[(F.col(f"_rko_{c}") + F.col(f"_rkl_{c}")).alias(f"{c}{suffix}") for c in cols],
                      *([f"{c}{totals}" for c in cols] if totals else []),
                      *([F.coalesce(f"_rkn_{c}", f"_rkf_{c}").alias(f"{c}{following}") for c in cols] if following else []))
