"""Joins beyond plain equi-joins: interval containment by an interval index
and prior history (J4).

Prior history never emits pairs.  "Any fact of the same subject strictly
before now" is a running OR in time order.  Flags are packed into ``bigint`` words
(one bit each); facts and probes are reduced to one row per (subject, time)
before anything is sorted; these rows are range-partitioned on (subject, time)
and written once, so a hot subject is cut into balanced pieces, and a summary
(about one row per subject and piece) carries the OR of earlier pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.expr import col as Q_
from stayline.functions.expr import true_or_false
from stayline.operators.ranking import PID, POS, null_safe_join, range_numbered
from stayline.session import cut_lineage


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz, time-zone free."""
    c = F.col(c) if isinstance(c, str) else c
    since = c.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01'")
    return F.call_function("div", since, F.expr("INTERVAL '0.000001' SECOND"))


_LOOKUP = 200_000  # rows of a table that is handed to every task


def counted_lookup(df: DataFrame, limit: int = _LOOKUP) -> DataFrame:
    """The small side of a join, written once and counted: broadcast if it has at most
    ``limit`` rows, so that the other side is not shuffled; joined by key beyond."""
    x = cut_lineage(df)
    return F.broadcast(x) if x.limit(limit + 1).count() <= limit else x


_COARSEST = 62  # bits of the widest cell


def _own_level(stays: DataFrame, start: str, end: str, finest: int) -> DataFrame:
    """Adds ``_lv``, the level whose cells (2**level microseconds) are longer than the
    stay.  Stays without a start or an end, and those that end before they start,
    contain nothing and go."""
    lo, hi = epoch_micros(start), epoch_micros(end)
    level = F.greatest(F.lit(finest), F.least(F.lit(_COARSEST), F.length(F.bin(hi - lo))))
    return stays.where(lo <= hi).withColumn("_lv", level.cast("int"))


def _cells(stays: DataFrame, start: str, end: str) -> DataFrame:
    """The cells of level ``_lv`` that a stay touches, one row each."""
    first, last = (F.call_function("shiftright", epoch_micros(c), F.col("_lv")) for c in (start, end))
    return stays.withColumn("_cell", F.explode(F.sequence(first, last)))


def stay_cells(stays: DataFrame, start: str, end: str, finest: int) -> DataFrame:
    """Interval index: adds ``_lv`` and ``_cell`` to a stay.  A stay of length l lies
    on the level whose cells (2**level microseconds) are longer than l, so it
    touches two of them at most, however long it is.  Stays without a start or
    an end, and those that end before they start, contain nothing and go."""
    return _cells(_own_level(stays, start, end, finest), start, end)


_SPAN = 4  # levels that share the cells of the finest of them


def shared_levels(levels: Sequence[int]) -> dict[int, int]:
    """Level -> the level whose cells it uses, the finest of ``_SPAN`` neighbours: a
    stay touches at most nine cells, and an event is looked up on a quarter of the levels."""
    out: dict[int, int] = {}
    base = None
    for k in sorted(levels):
        base = k if base is None or k >= base + _SPAN else base
        out[k] = base
    return out


def events_in_stay(events: DataFrame, stays: DataFrame, on, t: str, start: str = "intime", end: str = "outtime",
                   finest: int = 32, index: DataFrame | None = None,
                   summary: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Attach each event to its stays with ``start <= t <= end`` (both inclusive).

    Interval index: stays are cut into cells of about their own length's level
    (``stay_cells``; 2**32 microseconds, about 72 minutes, is the finest; four
    neighbouring levels share the finest one's cells), events look up their cell on
    every level in use (at most eight, found by one small aggregate), and the exact ends are checked inside the equi-join on (key, level,
    cell).  An event meets only stays that are near it in time, so neither a key
    with a third of all events nor one with many stays makes all pairs; keys spread
    over their cells.  ``index``: stays that went through ``stay_cells`` and were
    written, for use with several event tables.

    ``summary`` (name -> (``count``, ``sum``, ``min`` or ``max``, event column)) gives one row per
    stay with an event and these figures of its events instead of the pairs, whose
    number in one key grows with its events times its stays (``_stay_figures``)."""
    on = _as_list(on)
    if summary is not None:
        return _stay_figures(events, stays, on, t, start, end, summary)
    own = cut_lineage(_own_level(stays, start, end, finest)) if index is None else index  # read twice
    levels = [r[0] for r in own.select("_lv").distinct().collect()]  # at most 63 - finest numbers
    if index is None:
        shared = shared_levels(levels)
        level = F.coalesce(*[F.when(F.col("_lv") == k, F.lit(v)) for k, v in shared.items()], F.col("_lv"))
        cells, levels = _cells(own.withColumn("_lv", level), start, end), sorted(set(shared.values()))
    else:
        cells = index
    s = cells.select(*[F.col(c).alias(f"_st_{c}") for c in cells.columns])
    e = events.withColumn("_at", epoch_micros(t)).where(F.col("_at").isNotNull())
    spots = [F.struct(F.lit(int(k)).alias("lv"), F.shiftright("_at", int(k)).alias("cell")) for k in sorted(levels)]
    none = F.array().cast("array<struct<lv:int,cell:bigint>>")
    e = e.withColumn("_p", F.explode(F.array(*spots) if spots else none)).drop("_at")
    cond = (F.col("_p.lv") == F.col("_st__lv")) & (F.col("_p.cell") == F.col("_st__cell"))
    for k in on:
        cond = cond & (Q_(k) == Q_(f"_st_{k}"))
    j = e.join(s, on=cond & (Q_(t) >= Q_(f"_st_{start}")) & (Q_(t) <= Q_(f"_st_{end}")), how="inner")
    return j.select(*[Q_(c) for c in events.columns],
                    *[Q_(f"_st_{c}").alias(c) for c in stays.columns if c not in on])


_FAN = 3  # bits: eight blocks of a level make one of the next


def _stay_figures(events: DataFrame, stays: DataFrame, on: list[str], t: str, start: str, end: str,
                  summary: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Figures per stay without pairs.  Events and the two ends of every stay are put in
    one order (key, time; starts before, ends after equal times) and numbered, so a
    stay's events are the events between its two numbers.  Aligned blocks of 8, 64, ...
    rows carry the figures of their events, and a stay is a union of at most 14
    blocks of each level: work grows as (events + stays) times the levels."""
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    names = {n: f"_f{i}" for i, n in enumerate(summary)}
    key = [f"_k{i}" for i in range(len(on))]
    own = [Q_(c).alias(k) for c, k in zip(on, key)]
    held = lambda df: df.where(F.forall(F.array(*[F.col(k).isNotNull() for k in key]), lambda x: x))
    s = stays.withColumn("_sid", F.monotonically_increasing_id())
    s = cut_lineage(s)  # the numbers tell equal stays apart: written before use
    ends = s.select(*own, "_sid", epoch_micros(start).alias("_lo"), epoch_micros(end).alias("_hi"))
    ends = held(ends).where(F.col("_lo") <= F.col("_hi"))
    ends = ends.select(*key, "_sid", F.explode(F.array(F.struct(F.col("_lo").alias("at"), F.lit(0).alias("side")),
                                                       F.struct(F.col("_hi").alias("at"), F.lit(2).alias("side")))).alias("_e"))
    ends = ends.select(*key, "_e.at", "_e.side", "_sid")
    vals = [(F.lit(1).cast("bigint") if kind == "count" else Q_(c)).alias(names[n]) for n, (kind, c) in summary.items()]
    ev = held(events.select(*own, epoch_micros(t).alias("at"), F.lit(1).alias("side"), *vals)).where(F.col("at").isNotNull())
    u = range_numbered(ev.unionByName(ends, allowMissingColumns=True), key, ["at", "side"])
    size = u.groupBy(PID).agg(F.count(F.lit(1)).alias("_c"))  # one row a partition
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(PID, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    u = u.join(F.broadcast(size), PID).withColumn("_no", F.col("_off") + F.col(POS))
    # a stay: the numbers [lo, hi) between its ends, most often far more than its blocks
    span = u.where(F.col("side") != 1).groupBy("_sid").agg((F.min("_no") + 1).alias("_lo"), F.max("_no").alias("_hi"))
    span = cut_lineage(span.where(F.col("_lo") < F.col("_hi")))
    longest = span.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    top = -(-int(longest).bit_length() // _FAN)
    figures = [merge[kind](names[n]).alias(names[n]) for n, (kind, _) in summary.items()]
    rows = u.where(F.col("side") == 1).select(F.lit(0).alias("_lv"), F.col("_no").alias("_cell"), *names.values())
    low = rows.groupBy(F.lit(1).alias("_lv"), F.shiftright("_cell", _FAN).alias("_cell")).agg(*figures)
    low = cut_lineage(low)
    up = low.select(F.explode(F.array(*[F.struct(F.lit(k).alias("l"), F.shiftright("_cell", _FAN * (k - 1)).alias("c"))
                                        for k in range(2, max(top, 2) + 1)])).alias("_b"), *names.values())
    up = up.groupBy(F.col("_b.l").alias("_lv"), F.col("_b.c").alias("_cell")).agg(*figures)
    blocks = rows.unionByName(low).unionByName(up)
    spots = span.select("_sid", F.explode(F.flatten(F.array(*[_level_blocks(k) for k in range(top + 1)]))).alias("_b"))
    spots = spots.select("_sid", F.col("_b.lv").alias("_lv"), F.col("_b.cell").alias("_cell"))
    got = spots.join(blocks, ["_lv", "_cell"]).groupBy("_sid").agg(*figures)
    return s.join(got, "_sid").select(*[Q_(c) for c in stays.columns], *[F.col(f).alias(n) for n, f in names.items()])


def _level_blocks(k: int) -> Column:
    """Blocks of level ``k`` in the least set of aligned blocks that makes up [_lo, _hi)."""
    def inside(level):  # the blocks of a level that lie wholly inside: [first, stop)
        bits = _FAN * level
        return F.shiftright(F.col("_lo") + ((1 << bits) - 1), bits), F.shiftright("_hi", bits)

    (first, stop), (above, above_stop) = inside(k), inside(k + 1)
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    wide, many = F.lit(1 << _FAN).cast("bigint"), above < above_stop
    cells = F.when(many, F.concat(run(first, above * wide), run(above_stop * wide, stop))).otherwise(run(first, stop))
    return F.transform(cells, lambda c: F.struct(F.lit(k).alias("lv"), c.alias("cell")))


_BITS = 60  # flags per word


def pack_flags(flags: Sequence[Column], prefix: str = "_w") -> list[Column]:
    """Boolean columns as bits of ``bigint`` words ``prefix0``, ``prefix1``, ..."""
    words = []
    for k in range(0, len(flags), _BITS):
        bits = [F.when(true_or_false(c), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
                for i, c in enumerate(flags[k:k + _BITS])]
        total = bits[0]
        for x in bits[1:]:
            total = total.bitwiseOR(x)
        words.append(total.alias(f"{prefix}{k // _BITS}"))
    return words


def flag_of(words: Sequence[str], i: int) -> Column:
    """Flag ``i`` of packed words; no word: false."""
    return F.coalesce(Q_(words[i // _BITS]).bitwiseAND(F.lit(1 << i % _BITS)) != 0, F.lit(False))


def prior_words(probes: DataFrame, facts: DataFrame, on, t_now: str, t_then: str, words: Sequence[str],
                out: Sequence[str], partitions: int | None = None) -> DataFrame:
    """J4 on packed flags: the OR of ``words`` over facts of the same key with
    ``t_then < t_now``, as columns ``out`` (null where there is none)."""
    on = _as_list(on)
    f = facts.where(F.col(t_then).isNotNull()).select(*on, F.col(t_then).alias("_t"), *[
        Q_(w).alias(f"_w{k}") for k, w in enumerate(words)])
    words = [f"_w{k}" for k in range(len(words))]
    f = f.groupBy(*on, "_t").agg(*[F.bit_or(w).alias(w) for w in words]).withColumn("_probe", F.lit(False))
    p = probes.where(F.col(t_now).isNotNull()).select(*on, F.col(t_now).alias("_t")).distinct()
    p = p.select(*on, "_t", *[F.lit(0).cast("bigint").alias(w) for w in words], F.lit(True).alias("_probe"))
    u = f.unionByName(p).groupBy(*on, "_t").agg(*[F.bit_or(w).alias(w) for w in words],
                                                F.bool_or("_probe").alias("_probe"))
    u = range_numbered(u, on, ["_t"], partitions)
    local = Window.partitionBy(PID, *on).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*on).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    summ = u.groupBy(PID, *on).agg(*[F.bit_or(w).alias(w) for w in words])
    summ = summ.select(PID, *on, *[F.coalesce(F.bit_or(w).over(earlier), F.lit(0)).alias(f"_c{w}") for w in words])
    here = u.select(PID, *on, "_t", "_probe", *[F.coalesce(F.bit_or(w).over(local), F.lit(0)).alias(w) for w in words])
    here = null_safe_join(here.where("_probe"), summ, [PID, *on])
    here = here.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], F.col("_t").alias("_kt"),
                       *[F.col(w).bitwiseOR(F.col(f"_c{w}")).alias(w) for w in words])
    same = F.col(t_now) == F.col("_kt")
    for i, c in enumerate(on):
        same = same & Q_(c).eqNullSafe(F.col(f"_k{i}"))
    joined = probes.join(here, same, "left")
    return joined.select(*[Q_(c) for c in probes.columns], *[F.col(w).alias(o) for w, o in zip(words, out)])


def prior_history(probes: DataFrame, facts: DataFrame, on, t_now: str, t_then: str,
                  flags: Sequence[str], prefix: str = "prior_", partitions: int | None = None) -> DataFrame:
    """For every probe row, ``prefix + flag`` is true when a fact row of
    the same key with ``t_then < t_now`` (strictly earlier) carries the flag.
    A probe without a time, and facts without one, match nothing."""
    on, flags = _as_list(on), list(flags)
    packed = pack_flags([Q_(c) for c in flags], "_f")
    f = facts.select(*on, *([] if t_then in on else [t_then]), *packed)
    words = [f"_f{k}" for k in range(len(packed))]
    out = [f"_o{k}" for k in range(len(packed))]
    got = prior_words(probes, f, on, t_now, t_then, words, out, partitions)
    return got.select(*[Q_(c) for c in probes.columns],
                      *[flag_of(out, i).alias(f"{prefix}{c}") for i, c in enumerate(flags)])
