"""Preparation for modelling.

* The split is a deterministic function of a seeded hash, so every table can
  be assigned by joining on the stay key; exact per-class shares come from
  distributed ranks (no class gathered into one task).
* Scalers are fitted on Train rows with one aggregate (or one range sort for
  the quantile knots); the fitted model is a bounded set of numbers
  (columns x knots) used by a vectorised transform.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.expr import col as Q_

from stayline.operators.quality import exact_quantiles_long
from stayline.operators.ranking import hash_rank
from stayline.session import cut_lineage


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def seeded_order(keys, seed: int = 0):
    """Deterministic pseudo-random order key: md5 of ``key1|key2|...|seed``
    (text form), reproducible by any engine with md5."""
    parts = [Q_(k).cast("string") for k in _as_list(keys)] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


# ---------------------------------------------------------------- L3 / L4
def split_counts(n: int, weights: Sequence[float]) -> list[int]:
    """Per-class sizes: train = round-half-up(n * w_train), the rest split
    between test and val in proportion, rounding half up for test."""
    w_tr, w_te, w_va = weights
    n_tr = int(n * w_tr + 0.5)
    rest = n - n_tr
    n_te = int(rest * (w_te / (w_te + w_va)) + 0.5)
    return [n_tr, n_te, rest - n_te]


def stratified_split(stays: DataFrame, key, label: str, weights=(0.5, 0.25, 0.25),
                     seed: int = 0, out: str = "split") -> DataFrame:
    """L3: Train / Test / Val per stay with exact per-class shares.

    Order inside each class = ``seeded_order(key, seed)`` (ties by key).  ``stays`` is
    evaluated once: ranks and class sizes come from the same written rows."""
    keys = _as_list(key)
    w_tr, w_te, w_va = weights
    x = stays.withColumn("_cls", F.coalesce(F.col(label).cast("boolean"), F.lit(False))) \
             .withColumn("_h", seeded_order(keys, seed))
    r = hash_rank(x, "_cls", "_h", keys, "_r", "_n")
    n_tr = F.floor(F.col("_n") * w_tr + 0.5)
    n_te = F.floor((F.col("_n") - n_tr) * (w_te / (w_te + w_va)) + 0.5)
    split = (F.when(F.col("_r") < n_tr, F.lit("Train")).when(F.col("_r") < n_tr + n_te, F.lit("Test"))
              .otherwise(F.lit("Val")))
    return r.withColumn(out, split).drop("_cls", "_h", "_n", "_r")


def apply_split(df: DataFrame, ids: DataFrame, key, split: str = "split") -> DataFrame:
    """L4: give every row of a table the split of its stay (equi-join)."""
    keys = _as_list(key)
    return df.join(ids.select(*keys, split), on=keys, how="inner")


# ---------------------------------------------------------------- L5
def quantile_knots(train: DataFrame, cols: Sequence[str], n_quantiles: int = 1000) -> dict[str, list[float]]:
    """L5 fit: per column the linear-interpolation quantiles at
    ``linspace(0, 1, m)``, ``m = min(n_quantiles, n non-null train values)``.
    The result is a small model (columns x m numbers) returned to the driver."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), Q_(c).cast("double").alias("value")) for c in cols])).alias("_s")
    ).select("_s.*").where(F.col("value").isNotNull())
    # the fit runs several jobs (counts, range sampling, ranks): write the
    # narrow training values once to the shared checkpoint folder
    long = cut_lineage(long)
    q = exact_quantiles_long(long, "column", "value", n_grid=n_quantiles)
    got: dict[str, dict[int, float]] = {}
    for r in q.collect():  # columns x m numbers: the fitted model
        got.setdefault(r["column"], {})[int(r["qi"])] = r["q"]
    knots = {c: [kv[i] for i in range(len(kv))] for c, kv in got.items()}
    return knots


def quantile_transform(df: DataFrame, knots: dict[str, list[float]]) -> DataFrame:
    """L5 transform: map to [0, 1] by the mean of forward and backward linear
    interpolation over the knots; values at the first/last knot -> 0/1;
    NULL and NaN give NULL.

    All columns find their place among the distinct knots by one binary search
    each (Spark ML's bucketizer, in the JVM); the two interpolations then read a
    value, its first and last reference and a slope from arrays of that size."""
    from pyspark.ml.feature import Bucketizer
    cols = [c for c in knots if knots[c]]
    if not cols:
        return df
    names = {c: (f"_x{i}", f"_b{i}") for i, c in enumerate(cols)}
    x = df.withColumns({names[c][0]: Q_(c).cast("double") + 0.0 for c in cols})  # the search tells -0.0 from 0.0
    tables = {c: _knot_table(knots[c]) for c in cols}
    x = Bucketizer(splitsArray=[[-math.inf, *tables[c][0], math.inf] for c in cols],
                   inputCols=[names[c][0] for c in cols], outputCols=[names[c][1] for c in cols],
                   handleInvalid="keep").transform(x)
    out = {}
    for c in cols:
        at, first, last, slope = (F.array(*[F.lit(float(v)) for v in t]) for t in tables[c])
        v, below = F.col(names[c][0]), F.col(names[c][1]).cast("int") - 1  # distinct knots <= v, less one
        knot = F.get(at, below)
        forward = F.get(slope, below) * (v - knot) + F.get(last, below)
        backward = F.when(v == knot, F.get(first, below)).otherwise(
            F.get(first, below + 1) - F.get(slope, below) * (F.get(at, below + 1) - v))
        lo, hi = tables[c][0][0], tables[c][0][-1]
        out[c] = (F.when(v.isNull() | F.isnan(v), F.lit(None).cast("double")).when(v <= lo, F.lit(0.0))
                  .when(v >= hi, F.lit(tables[c][2][-1])).otherwise(0.5 * (forward + backward)))
    return x.withColumns(out).drop(*[n for pair in names.values() for n in pair])


def _knot_table(knots: Sequence[float]) -> tuple[list[float], list[float], list[float], list[float]]:
    """(distinct knots; reference of the first and of the last of equal ones; slope
    from the last one to the next distinct knot) for references linspace(0, 1, m)."""
    m = len(knots)
    at, first, last = [], [], []
    for i, k in enumerate(k + 0.0 for k in knots):
        ref = i / (m - 1) if m > 1 else 0.0
        if at and at[-1] == k:
            last[-1] = ref
        else:
            at.append(k)
            first.append(ref)
            last.append(ref)
    slope = [(first[i + 1] - last[i]) / (at[i + 1] - at[i]) for i in range(len(at) - 1)]
    return at, first, last, [*slope, 0.0]


# ---------------------------------------------------------------- L6
def minmax_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L6 fit: one-row table of per-column min and max over Train rows."""
    return train.agg(*[x for c in cols for x in (F.min(Q_(c)).alias(f"{c}__min"), F.max(Q_(c)).alias(f"{c}__max"))])


def minmax_transform(df: DataFrame, cols: Sequence[str], fitted: DataFrame) -> DataFrame:
    """L6 transform: (x - min) / (max - min); a constant column scales by 1
    (so Train values become 0); values outside the Train range not clipped."""
    x = df.crossJoin(F.broadcast(fitted))
    out = {}
    for c in cols:
        mn, mx = Q_(f"{c}__min"), Q_(f"{c}__max")
        rng = F.when(mx - mn == 0, F.lit(1.0)).otherwise((mx - mn).cast("double"))
        out[c] = (Q_(c) - mn) / rng
    return x.withColumns(out).drop(*[f"{c}__{s}" for c in cols for s in ("min", "max")])


def robust_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L5 README variant: per-column median and interquartile range of the
    Train rows (exact, distributed), one row."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), Q_(c).cast("double").alias("value")) for c in cols])).alias("_s")
    ).select("_s.*")
    from stayline.operators.quality import exact_quantiles
    q = exact_quantiles(long, "column", "value", [0.25, 0.5, 0.75], ["q1", "med", "q3"])
    return q.groupBy().pivot("column", list(cols)).agg(
        F.first("med").alias("med"), F.first(F.col("q3") - F.col("q1")).alias("iqr"))


def robust_transform(df: DataFrame, cols: Sequence[str], fitted: DataFrame) -> DataFrame:
    """(x - median) / IQR with the one-row fit broadcast; IQR 0 scales by 1."""
    x = df.crossJoin(F.broadcast(fitted))
    out = {}
    for c in cols:
        med, iqr = F.col(f"`{c}_med`"), F.col(f"`{c}_iqr`")
        out[c] = (Q_(c) - med) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
    return x.withColumns(out).drop(*[f"{c}_{s}" for c in cols for s in ("med", "iqr")])


def impute(df: DataFrame, cols: Sequence[str], keys, order: str = "hour", how: str = "ffill_zero",
           train: DataFrame | None = None) -> DataFrame:
    """Forward fill per stay, then 0 (reference) or the Train mean
    (``how='mean'``, the comment's intent; one-row statistics broadcast)."""
    from stayline.operators.windows import ffill
    x = ffill(df, cols, keys, order)
    if how == "mean":
        stats = (train if train is not None else df).agg(*[F.avg(Q_(c)).alias(f"_mean_{c}") for c in cols])
        x = x.crossJoin(F.broadcast(stats))
        x = x.withColumns({c: F.coalesce(Q_(c), F.col(f"`_mean_{c}`")) for c in cols})
        return x.drop(*[f"_mean_{c}" for c in cols])
    return x.withColumns({c: F.coalesce(Q_(c), F.lit(0.0)) for c in cols})


# ---------------------------------------------------------------- R6 / R7
def pack_sequences(df: DataFrame, keys, order: str, cols: Sequence[str],
                   pad_to: str | None = None, out: str = "x") -> DataFrame:
    """One row per stay: ``out`` = rows of ``cols`` in ``order`` as an
    ``array<array<double>>`` and ``maxsteps`` = true length.  With
    ``pad_to``, the array is padded with zero rows to that column's length
    (e.g. the split's longest stay).  Memory per row is bounded by the stay's
    span in hours."""
    keys = _as_list(keys)
    rowv = F.array(*[Q_(c).cast("double") for c in cols])
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), rowv.alias("v"))))
                              .alias("_rows"))
    g = g.withColumn(out, F.transform("_rows", lambda r: r["v"])).withColumn("maxsteps", F.size("_rows")).drop("_rows")
    if pad_to:
        zero = F.array_repeat(F.lit(0.0), len(cols))
        g = g.withColumn(out, F.concat(F.col(out), F.array_repeat(zero, F.col(pad_to) - F.col("maxsteps"))))
    return g


def longest_by_split(df: DataFrame, keys, split: str = "split") -> DataFrame:
    """Steps of the longest stay of each split (``_pad``), counted before the steps are packed."""
    n = df.groupBy(*_as_list(keys), split).agg(F.count(F.lit(1)).alias("_pad"))
    return n.groupBy(split).agg(F.max("_pad").cast("int").alias("_pad"))


def pad_to_split_max(packed: DataFrame, split: str = "split", out: str = "x", longest: DataFrame | None = None) -> DataFrame:
    """Pad every stay to the longest stay of its split (one small aggregate).
    ``longest``: ``longest_by_split`` of the steps, so that they are packed once."""
    mx = packed.groupBy(split).agg(F.max("maxsteps").alias("_pad")) if longest is None else longest
    x = packed.join(mx, on=split)  # one row per split value; AQE broadcasts it when small
    width = F.size(F.element_at(out, 1))
    zero = F.array_repeat(F.lit(0.0), width)
    return x.withColumn(out, F.concat(F.col(out), F.array_repeat(zero, F.col("_pad") - F.col("maxsteps")))).drop("_pad")


def unpack_sequences(packed: DataFrame, keys, cols: Sequence[str], arr: str = "x",
                     step: str = "step") -> DataFrame:
    """Padded arrays -> one row per valid step (truncated at maxsteps)."""
    keys = _as_list(keys)
    x = packed.select(*keys, F.posexplode(F.slice(F.col(arr), 1, F.col("maxsteps"))).alias(step, "_v"))
    return x.select(*keys, F.col(step).cast("bigint").alias(step),
                    *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)])


def length_classes(longest: int, ratio: float = 1.25) -> list[int]:
    """Upper bounds of the length classes up to ``longest``: each about ``ratio``
    times the one before."""
    out = [1]
    while out[-1] < longest:
        out.append(min(longest, max(out[-1] + 1, int(out[-1] * ratio))))
    return out


def pack_by_length(df: DataFrame, keys, order: str, cols: Sequence[str], segment: int = 512, ratio: float = 1.25,
                   batch: int = 256, seed: int = 0, out: str = "x") -> DataFrame:
    """R6 by length: one row per stay and segment of at most ``segment`` steps.

    A stay longer than that is cut: ``segment_no``, ``offset`` (steps before).  Rows of
    similar length form a class (``length_class``, bounds of ``length_classes``) and
    are padded with zero rows to the longest of their class only (``maxsteps``: true
    length); ``batch_no`` groups ``batch`` rows of a class in seeded order, so that a
    reader takes batches of one length.  Memory per row is bounded by the segment,
    whatever the stay's length."""
    keys = _as_list(keys)
    at = Window.partitionBy(*keys).orderBy(order)
    x = df.select(*keys, (F.row_number().over(at) - 1).cast("bigint").alias("_at"), F.array(
        *[Q_(c).cast("double") for c in cols]).alias("_v"))
    x = x.withColumn("segment_no", F.floor(F.col("_at") / segment).cast("bigint"))
    g = x.groupBy(*keys, "segment_no").agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_rows"))
    g = g.select(*keys, "segment_no", (F.col("segment_no") * segment).alias("offset"), F.size("_rows").alias("maxsteps"),
                 F.transform("_rows", lambda r: r["_v"]).alias(out))
    bounds = F.array(*[F.lit(b) for b in length_classes(segment, ratio)])
    g = g.withColumn("length_class", F.size(F.filter(bounds, lambda b: b < F.col("maxsteps"))))
    g = g.withColumn("_h", seeded_order([*keys, "segment_no"], seed))
    g = cut_lineage(hash_rank(g, "length_class", "_h", [*keys, "segment_no"], "_r"))
    top = g.groupBy("length_class").agg(F.max("maxsteps").alias("_pad"))  # one row a class
    g = g.join(top, "length_class")
    zero = F.array_repeat(F.lit(0.0), len(cols))
    return g.select(*keys, "segment_no", "offset", "length_class", F.floor(F.col("_r") / batch).cast("bigint").alias("batch_no"),
                    "maxsteps", F.concat(F.col(out), F.array_repeat(zero, F.col("_pad") - F.col("maxsteps"))).alias(out))


def padded_share(packed: DataFrame, arr: str = "x") -> DataFrame:
    """Steps, stored steps and the share of them that is padding, one row."""
    x = packed.agg(F.sum("maxsteps").alias("steps"), F.sum(F.size(arr)).cast("bigint").alias("stored"))
    return x.withColumn("padded_share", 1 - F.col("steps") / F.col("stored"))


def unpack_segments(packed: DataFrame, keys, cols: Sequence[str], arr: str = "x", step: str = "step") -> DataFrame:
    """R7 for ``pack_by_length``: one row per valid step of the whole stay."""
    keys = _as_list(keys)
    x = unpack_sequences(packed, [*keys, "offset"], cols, arr, step)
    return x.withColumn(step, F.col(step) + F.col("offset")).drop("offset")


# ---------------------------------------------------------------- S4 / S5
def sample_ids(df: DataFrame, key, n: int, seed: int = 0, where=None, by: str | None = None) -> DataFrame:
    """N distinct ids without replacement, deterministic: the n smallest
    seeded hashes (a top-k; Spark plans it as a partial + final TakeOrdered).
    ``by``: n ids of each value of that column (kept), cut before the shuffle."""
    keys = _as_list(key)
    cols = keys + ([by] if by else [])
    x = df.select(*cols).distinct() if where is None else df.where(where).select(*cols).distinct()
    if by:
        w = Window.partitionBy(by).orderBy(seeded_order(keys, seed), *keys)
        return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return x.orderBy(seeded_order(keys, seed), *keys).limit(n)


def case_control(df: DataFrame, key, label: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """All positive ids plus ``ratio`` x as many negatives, chosen by the
    smallest seeded hashes (distributed rank, exact count)."""
    keys = _as_list(key)
    ids = df.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col(label).cast("boolean")), F.lit(False)).alias("_pos"))
    r = cut_lineage(hash_rank(ids.withColumn("_h", seeded_order(keys, seed)), "_pos", "_h", keys, "_r"))
    n_pos = r.where("_pos").agg(F.count(F.lit(1)).alias("_np"))  # one row
    r = r.crossJoin(F.broadcast(n_pos)).where(F.col("_pos") | (F.col("_r") < F.floor(F.col("_np") * ratio)))
    return r.select(*keys, F.col("_pos").alias(label))


# ---------------------------------------------------------------- L9
def baseline_logistic(train: DataFrame, score: DataFrame, features: Sequence[str], label: str,
                      kind: str = "logistic", max_iter: int = 50):
    """Imputer -> VectorAssembler -> StandardScaler -> LogisticRegression
    (or gradient-boosted trees) fitted on Train, scored on ``score``; adds
    ``proba`` (probability of class 1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    feats = list(features)
    imp = Imputer(inputCols=feats, outputCols=[f"_i_{c}" for c in feats], strategy="mean")
    va = VectorAssembler(inputCols=[f"_i_{c}" for c in feats], outputCol="_fv")
    sc = StandardScaler(inputCol="_fv", outputCol="_features", withMean=True, withStd=True)
    if kind == "gbt":
        # its own checkpoints would be deleted twice, by it and by the session's cleaner
        clf = GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=max_iter, checkpointInterval=-1)
    else:
        clf = LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=max_iter)
    model = Pipeline(stages=[imp, va, sc, clf]).fit(train.withColumn("_y", F.col(label).cast("double")))
    out = model.transform(score.withColumn("_y", F.col(label).cast("double")))
    out = out.withColumn("proba", vector_to_array("probability")[1])
    keep = [c for c in score.columns] + ["proba"]
    return out.select(*keep)
