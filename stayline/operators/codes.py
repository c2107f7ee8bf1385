"""Diagnosis code grouping.

Rule grammar (own definition; the reference delegates the matching to an
external package): remove dots and spaces, drop a trailing ``x``, split at
``-`` into ``lo`` / ``hi`` (equal for single tokens).  A code of the same
version, stripped of dots and spaces, matches when
``substr(code, 1, len(lo)) >= lo`` and ``substr(code, 1, len(hi)) <= hi``.

A prefix test is a half-open range of strings: ``code >= lo`` and ``code < hi`` with
its last character raised by one.  The ends of all rules of a version, sorted, cut
the codes into disjoint elementary segments, and a segment lies wholly inside or
outside of every rule.  Each *distinct* code finds its segment by binary search;
segments map to groups; the codes' groups go back to the rows by an equi-join.  No
row is ever compared with a range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions import constants as K
from stayline.functions.expr import col as Q_
from stayline.functions.expr import weighted_sum
from stayline.operators.joins import counted_lookup, pack_flags


def _clean(tok: str) -> str:
    t = tok.replace(".", "").replace(" ", "").upper()
    return t[:-1] if t.endswith("X") else t


def parse_token(tok: str) -> tuple[str, str]:
    """One rule token -> (lo, hi) prefix bounds."""
    parts = tok.split("-")
    lo = _clean(parts[0])
    hi = _clean(parts[1]) if len(parts) > 1 else lo
    return lo, hi


def rule_rows(groups=K.COMORBIDITY_GROUPS) -> list[tuple]:
    """(group, version, lo, hi, first_char) rows, one per first character."""
    rows = []
    for g in groups:
        for ver, tokens in ((10, g["icd10"]), (9, g["icd9"])):
            for tok in tokens:
                lo, hi = parse_token(tok)
                for c in range(ord(lo[0]), ord(hi[0]) + 1):
                    rows.append((g["group"], ver, lo, hi, chr(c)))
    return rows


def code_rules(spark: SparkSession, groups=K.COMORBIDITY_GROUPS) -> DataFrame:
    return spark.createDataFrame(rule_rows(groups), "group string, version int, lo string, hi string, c1 string")


def group_names(groups=K.COMORBIDITY_GROUPS) -> list[str]:
    return [g["group"] for g in groups]


def moore_weights(groups=K.COMORBIDITY_GROUPS) -> dict[str, int]:
    return {g["group"]: g["moore17"] for g in groups}


def normalize_code(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(F.trim(c), r"[. ]", ""))


def code_segments(rules: DataFrame) -> DataFrame:
    """One row per version: ``bounds`` (ends of all rules, sorted) and ``groups``
    (the groups of each segment; segment i begins at bound i, the first has none).
    Its size is that of the rule sheet."""
    after = F.concat(F.expr("substr(hi, 1, length(hi) - 1)"), F.chr(F.ascii(F.expr("substr(hi, -1)")) + 1))
    r = rules.select("group", "version", "lo", after.alias("up")).distinct()
    ends = r.select("version", F.explode(F.array("lo", "up")).alias("b")).distinct()
    # a rule covers the segments that begin in [lo, up)
    inside = ends.alias("e").join(r.alias("r"), (F.col("e.version") == F.col("r.version")) & (F.col("b") >= F.col("lo"))
                                  & (F.col("b") < F.col("up")), "left")
    seg = inside.groupBy("e.version", "b").agg(F.sort_array(F.collect_set("group")).alias("g"))
    seg = seg.groupBy("version").agg(F.sort_array(F.collect_list(F.struct("b", "g"))).alias("s"))
    return seg.select("version", F.col("s.b").alias("bounds"),
                      F.concat(F.array(F.array().cast("array<string>")), F.col("s.g")).alias("groups"))


def _count_up_to(bounds: Column, value: Column) -> Column:
    """How many of the sorted bounds are <= value, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])  # a rule sheet of up to two million ends

    def step(at: Column, add: Column) -> Column:
        inside = (at + add <= F.size(bounds)) & (F.try_element_at(bounds, at + add) <= value)
        return F.when(inside, at + add).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def code_map(diag: DataFrame, code: str, version: str, rules: DataFrame) -> DataFrame:
    """``code``, ``version``, ``groups`` (array) of every distinct code that has a group."""
    d = diag.select(Q_(code).alias("code"), Q_(version).alias("version")).where(
        F.col("code").isNotNull() & F.col("version").isNotNull()).distinct()
    s = code_segments(rules).withColumnRenamed("version", "_v")
    x = d.join(s, F.col("version").cast("int") == F.col("_v"))
    x = x.withColumn("_norm", normalize_code("code"))
    x = x.select("code", "version", F.get("groups", _count_up_to(F.col("bounds"), F.col("_norm"))).alias("groups"))
    return x.where(F.size("groups") > 0)


def assign_groups(diag: DataFrame, code: str, version: str, rules: DataFrame,
                  out: str = "group", keep_unmatched: bool = False) -> DataFrame:
    """One row per (diagnosis, matched group); unmatched rows dropped or
    kept with a NULL group."""
    m = code_map(diag, code, version, rules).select(F.col("code").alias("_mc"), F.col("version").alias("_mv"), "groups")
    j = diag.join(m.withColumnRenamed("groups", "_mg"), (Q_(code) == F.col("_mc")) & (Q_(version) == F.col("_mv")),
                  "left" if keep_unmatched else "inner")
    each = F.explode_outer("_mg") if keep_unmatched else F.explode("_mg")
    return j.withColumn(out, each).drop("_mc", "_mv", "_mg")


def group_words(diag: DataFrame, code: str, version: str, rules: DataFrame, keys, groups,
                keep_unmatched: bool = False) -> tuple[DataFrame, list[str]]:
    """C2 + C3 packed: per key, the groups of its codes as bits of ``bigint`` words
    (bit i of the words: group i), for keys with a group; keys without one are
    dropped or kept with NULL words.  The bits are set once per distinct code
    and combined before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    m = code_map(diag, code, version, rules)
    words = pack_flags([F.array_contains("groups", g) for g in groups], "_g")
    m = counted_lookup(m.select(F.col("code").alias("_mc"), F.col("version").alias("_mv"), *words))
    names = [f"_g{k}" for k in range(len(words))]
    j = diag.join(m, (Q_(code) == F.col("_mc")) & (Q_(version) == F.col("_mv")), "left" if keep_unmatched else "inner")
    return j.groupBy(*keys).agg(*[F.bit_or(w).alias(w) for w in names]), names


def group_flags(assigned: DataFrame, keys, groups, out_prefix: str = "", group_col: str = "group") -> DataFrame:
    """Long assignments -> one boolean column per group and key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return assigned.groupBy(*keys).agg(*[
        F.coalesce(F.bool_or(F.col(group_col) == F.lit(g)), F.lit(False)).alias(f"{out_prefix}{g}")
        for g in groups])


def prior_score(flags_df: DataFrame, weights: Mapping[str, int], prefix: str = "",
                out: str = K.PRIOR_SCORE) -> DataFrame:
    """Weighted sum of the (prior) group flags."""
    return flags_df.withColumn(out, weighted_sum({f"{prefix}{g}": w for g, w in weights.items()}))
