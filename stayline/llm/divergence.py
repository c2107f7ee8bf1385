"""Operator 13: source divergence audit by count-cell ranking.

How far a (lang, source) group's smoothed term distribution is from those of the
other sources of its language, and which terms it overuses against the language.

1. Occurrences and document counts per (lang, source, term): blocks of rows are
   counted in the task that reads them, the counts combined before the shuffle.
2. A language keeps the terms in at least ``least`` of its documents; a kept
   term is one row with the list of its (source, count) - as many entries as
   the language has sources, never as many as it has rows.
3. Smoothed share of a count c in a group of size N: p(c) = 1 + floor(10^9 (c + 5)
   / (N + 5 V)).  It depends on the count alone, so terms of equal counts are one
   cell: (group count, language count) for terms, (count here, count there) for
   pairs of sources.  f = abs(p - q) is evaluated once a cell.
4. Terms: cells of equal f are merged, the ``top`` best values of a group ranked,
   their multiplicities summed up; only cells that begin within ``top`` ranks are
   expanded to terms, in UTF-8 order.
5. Pairs: cells where both counts are positive are counted from the lists; terms
   of one side only follow from the group's own histogram, and those of neither
   from V, so absent terms are never enumerated.

All arithmetic is exact: shares are integer quotients of decimals.

Scale: a hot source is combined map-side; a group's ranking keeps at most
``top`` cells of each task before the shuffle (window group limit), a value's
terms at most ``top`` as well; histograms have one row per distinct count.

Edge cases: null text, lang or source read as ''; texts without terms still
make their group occur; an occurring group without kept terms has N = 0; a
language without kept terms has pairs of value 0 and no term rows; rows with a
null or repeated doc_id are documents like any other; repeated rows count each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm import blocks
from stayline.llm.bpe_codec import distinct_spans
from stayline.llm.ship import ship_code
from stayline.session import cut_lineage

BLOCK = 4 << 20
_LETTER = blocks.byte_set([(65, 90), (97, 122), (128, 255)])


def _block_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Occurrences and documents per (lang, source, term) of a block of rows."""
    data, offsets = blocks.flat_utf8(text)
    data = blocks.LOWER[data]
    starts, ends, row = blocks.word_spans(data, offsets, _LETTER)
    first, word = distinct_spans(data, starts, ends, blocks.word_keys(data, starts, ends))
    raw = data.tobytes()
    terms = pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string())
    names = [x.dictionary_encode() for x in (lang, source)]
    code = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names]
    group = code[0] * max(1, len(names[1].dictionary)) + code[1]
    width = max(1, len(first))
    own, n = np.unique(row * width + word, return_counts=True)  # one entry per document and term
    cell, of = np.unique(group[own // width] * width + own % width, return_inverse=True)
    g, w = cell // width, cell % width
    many = max(1, len(names[1].dictionary))
    return pa.RecordBatch.from_arrays([
        names[0].dictionary.take(pa.array(g // many)), names[1].dictionary.take(pa.array(g % many)), terms.take(pa.array(w)),
        pa.array(np.bincount(of, weights=n, minlength=len(cell)).astype(np.int64)),
        pa.array(np.bincount(of, minlength=len(cell)).astype(np.int64))], names=["lang", "source", "term", "n", "d"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents); written once.  Blocks of
    rows are counted where they are read, so a term's occurrences are combined
    twice (in its block, in its task) before they are shuffled."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"),
                       F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks.row_blocks(batch.column(2), BLOCK):
                yield _block_counts(*[batch.column(k).slice(i, j - i) for k in range(3)])
        blocks.release()

    found = rows.mapInArrow(run, "lang string, source string, term string, n bigint, d bigint")
    return cut_lineage(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))


def _share(count: Column, total: str, kept: str) -> Column:
    """p of a count, by exact integer division."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (F.col(total) + 5 * F.col(kept)).cast("decimal(20,0)"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 30,
          top: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = term_counts(docs, text, lang, source)
    by_term = counts.groupBy("lang", "term").agg(
        F.sum("n").alias("cl"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("own"))
    kept = cut_lineage(by_term.where(F.col("d") >= least).drop("d"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("cl").alias("nl"))
    flat = kept.select("lang", "term", "cl", F.explode("own").alias("o")).select(
        "lang", "o.source", "term", F.col("o.n").alias("c"), "cl")
    seen = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    cells = cut_lineage(flat.groupBy("lang", "source", "c", "cl").agg(F.count(F.lit(1)).alias("m")))
    own = cells.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("m")).alias("ng"), F.sum("m").alias("vg"))
    groups = seen.join(own, ["lang", "source"], "left").join(size, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                                           for c in ("ng", "vg", "v", "nl")]))
    return _terms(flat, cells, groups, top).unionByName(_pairs(kept, cells, groups))


def _terms(flat: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    f = _share(F.col("c"), "ng", "v") - _share(F.col("cl"), "nl", "v")
    cells = cells.join(groups, ["lang", "source"]).select("lang", "source", "c", "cl", "m", f.alias("value")).where("value > 0")
    group = Window.partitionBy("lang", "source")
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    best = merged.withColumn("k", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("k") <= top)
    above = group.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("before", F.coalesce(F.sum("m").over(above), F.lit(0))).where(F.col("before") < top)
    # back to the counts that make these values, then to their terms
    chosen = cells.drop("m").join(best.select("lang", "source", "value", "before"), ["lang", "source", "value"])
    rows = flat.join(cut_lineage(chosen), ["lang", "source", "c", "cl"])
    tied = Window.partitionBy("lang", "source", "value").orderBy("term")
    rows = rows.withColumn("k", F.row_number().over(tied)).where(F.col("k") <= top)
    rank = (F.col("before") + F.col("k")).cast("int")
    return rows.where(rank <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          F.col("value").cast("bigint").alias("value"), rank.alias("rank"))


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    side = [F.col(c) for c in ("lang", "source", "ng", "vg", "v")]
    other = groups.select("lang", F.col("source").alias("item"), F.col("ng").alias("no"), F.col("vg").alias("vo"))
    pairs = groups.select(*side).join(other, "lang").where("source <> item")
    zero = F.lit(0)

    def gap(a: Column, b: Column) -> Column:
        return F.abs(_share(a, "ng", "v") - _share(b, "no", "v"))

    # both counts positive: pairs of entries of a term's list, counted per cell, each pair once
    two = F.expr("flatten(transform(own, (x, i) -> transform(slice(own, i + 2, size(own)), y -> struct("
                 "x.source AS source, y.source AS item, x.n AS c, y.n AS co))))")
    both = kept.where(F.size("own") > 1).select("lang", F.sort_array("own").alias("own"))
    both = both.select("lang", F.explode(two).alias("p")).select("lang", "p.*").groupBy(
        "lang", "source", "item", "c", "co").agg(F.count(F.lit(1)).alias("m"))
    met = both.join(pairs, ["lang", "source", "item"]).withColumns(
        {"f": gap(F.col("c"), F.col("co")), "fa": gap(F.col("c"), zero), "fb": gap(zero, F.col("co"))})
    met = met.groupBy("lang", "source", "item").agg(*[F.sum(F.col("m") * F.col(x)).alias(x) for x in ("f", "fa", "fb")],
                                                    F.sum("m").alias("m"))
    met = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "f",
                                     F.col("fb").alias("fa"), F.col("fa").alias("fb"), "m"))
    # a side alone: the other's count is 0 for all of its terms, less those that both have
    hist = cells.groupBy("lang", "source", "c").agg(F.sum("m").alias("m"))
    alone = hist.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * gap(F.col("c"), zero)).alias("ga"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("ga").alias("gb"))
    key = ["lang", "source", "item"]
    full = pairs.join(met, key, "left").join(alone, key, "left").join(back, key, "left").fillna(
        0, ["f", "fa", "fb", "m", "ga", "gb"])
    none = F.col("v") - F.col("vg") - F.col("vo") + F.col("m")
    value = F.col("f") + F.col("ga") - F.col("fa") + F.col("gb") - F.col("fb") + none * gap(zero, zero)
    full = full.select(*key, F.when(F.col("v") > 0, value).otherwise(F.lit(0)).cast("bigint").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return full.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                       F.row_number().over(order).cast("int").alias("rank"))
