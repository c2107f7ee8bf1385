"""Operator 7: benchmark decontamination by a prefix-filtered set join.  [native]

A window is ``span`` consecutive words of a benchmark item (an item of fewer
words is one window).  A document that holds a window holds all of its shingles
(pairs of neighbouring words; the word of a one-word window), so the rarest of
them is a necessary prefix token:

1. the shingles of all windows are counted over all documents, which orders them
   by rarity;
2. every distinct window is filed under its rarest shingle with its offset;
3. documents look their shingles up there; a hit fixes the window's place
   (positional bound: it must lie inside the text, length bound: all its words
   do) and the words of that stretch are compared exactly.

A document's texts are never shuffled: its words meet the windows, which are few,
as a broadcast when their measured number is at most ``SMALL`` rows; beyond that
the shingles are joined by key and only the texts with a candidate are met again.

Edge cases: a null text has no words; an item without words, or without an id,
takes no part; items that share a window are all reported; rows are told apart
by id and text, repeated rows get equal results; very long texts are read whole;
an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SMALL = 500_000  # windows; about 100 MB with their words


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; empty for null."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.array_remove(cut, "")


def _shingle(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def windows_of(benchmark: DataFrame, item: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: wid, words; which items have them: wid, item)."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    items = items.where(F.col("item").isNotNull() & (F.size("w") > 0))
    last = F.greatest(F.size("w") - span, F.lit(0))
    every = items.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    every = every.select("item", F.slice("w", F.col("at") + 1, span).alias("words"))
    every = cut_lineage(every.withColumn("wid", F.md5(F.concat_ws(" ", "words"))).distinct())
    return every.select("wid", "words").distinct(), every.select("wid", "item").distinct()


def _window_shingles(windows: DataFrame) -> DataFrame:
    """wid, words, offset, token: a window's shingles."""
    w = windows.select("wid", "words", F.posexplode("words").alias("offset", "w"))
    w = w.where((F.col("offset") < F.size("words") - 1) | (F.size("words") == 1))
    return w.select("wid", "words", "offset",
                    _shingle(F.col("w"), F.get("words", F.col("offset") + 1)).alias("token"))


def _document_shingles(docs: DataFrame, single: bool) -> DataFrame:
    """key columns, words, pos, token.  The last word pairs with null, as the word
    of a one-word window does; those have a token of every word besides."""
    d = docs.select("doc_id", "th", "words", F.posexplode("words").alias("pos", "w"))
    pair = _shingle(F.col("w"), F.get("words", F.col("pos") + 1))
    if not single:
        return d.select("doc_id", "th", "words", "pos", pair.alias("token"))
    alone = _shingle(F.col("w"), F.lit(None).cast("string"))
    return d.select("doc_id", "th", "words", "pos", F.explode(F.array_distinct(F.array(pair, alone))).alias("token"))


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, th, start, size, wid: every place where a window occurs."""
    n = windows.count()
    small = F.broadcast if n <= SMALL else (lambda d: d)
    single = not windows.where(F.size("words") == 1).isEmpty()
    shingles = _window_shingles(windows)
    found = _document_shingles(docs, single)
    wanted = small(shingles.select("token").distinct())
    rarity = found.select("token").join(wanted, "token", "left_semi").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
    # a window with a shingle that no document has cannot occur
    ranked = shingles.join(rarity, "token", "left").groupBy("wid").agg(
        F.min_by(F.struct("token", "offset", "words"), F.struct(F.coalesce("n", F.lit(0)), "token", "offset"))
        .alias("p"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
    prefix = cut_lineage(ranked.where("least > 0").select("wid", "p.token", "p.offset", F.col("p.words").alias("ww")))
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.size("ww") <= F.size("words"))
    if n <= SMALL:
        hit = found.join(F.broadcast(prefix), "token").where(inside)
    else:
        cand = found.select("doc_id", "th", "pos", "token").join(
            prefix.select("wid", "token", "offset"), "token").where(start >= 0).drop("token").distinct()
        hit = cand.join(prefix.select("wid", "ww"), "wid").alias("c")
        hit = hit.join(docs.alias("d"), _same("c", "d")).select("d.*", "c.pos", "c.wid", "c.ww", "c.offset").where(inside)
    hit = hit.where(F.slice("words", start + 1, F.size("ww")) == F.col("ww"))
    return hit.select("doc_id", "th", start.alias("start"), F.size("ww").alias("size"), "wid").distinct()


def _same(a: str, b: str) -> Column:
    """The same row, by id (which may be null) and text."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _covered(spans: Column) -> Column:
    """Number of positions in the union of sorted spans (start, stop)."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, s):
        more = F.greatest(s["stop"] - F.greatest(s["start"], acc["to"]), F.lit(0))
        return F.struct(F.greatest(acc["to"], s["stop"]).alias("to"), (acc["n"] + more).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", span: int = 10) -> DataFrame:
    """Per row: doc_id, th (hash of the text), n_words, n_hit, n_items,
    items_sha256, contaminated."""
    docs = documents.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"),
                            words_of(F.col(text)).alias("words"))
    windows, items = windows_of(benchmark, item, item_text, span)
    hits = cut_lineage(occurrences(docs, windows))
    covered = hits.select("doc_id", "th", F.struct("start", (F.col("start") + F.col("size")).alias("stop"))
                          .alias("s")).distinct().groupBy("doc_id", "th").agg(
        _covered(F.array_sort(F.collect_list("s"))).alias("n_hit"))
    named = hits.select("doc_id", "th", "wid").distinct().join(items, "wid").select(
        "doc_id", "th", "item").distinct().groupBy("doc_id", "th").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    out = docs.select("doc_id", "th", F.size("words").cast("bigint").alias("n_words"))
    found = covered.alias("c").join(named.alias("m"), _same("c", "m")).select("c.*", "m.n_items", "m.items_sha256")
    out = out.alias("d").join(found.alias("f"), _same("d", "f"), "left").select(
        "d.*", "f.n_hit", "f.n_items", "f.items_sha256")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select("doc_id", "th", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
          item: str = "item_id", item_text: str = "text", span: int = 10) -> DataFrame:
    """``documents`` without the rows that hold a window of the benchmark."""
    docs = documents.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"),
                            words_of(F.col(text)).alias("words"))
    windows, _ = windows_of(benchmark, item, item_text, span)
    bad = cut_lineage(occurrences(docs, windows).select("doc_id", "th").distinct())
    same = F.col(f"d.{key}").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("b.th"))
    return documents.alias("d").join(bad.alias("b"), same, "left_anti")
