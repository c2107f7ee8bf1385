"""Operator 4: sharding by proportional stratified interleaving.

Rows of every source are put in a seeded shuffle (order of a keyed digest of id,
size and checksum) and ranked; row r of n gets the fractional rank (2r - 1) / 2n.  All rows are
sorted by fractional rank, so every stretch holds the sources in proportion, and
the order is cut into shards whose row counts differ by one at most (law
``rows``).  ``slot`` is the place inside the shard, from 0.

Neither a source nor the table is sorted in one task.  The digest's leading bits
and the fractional rank's leading bits name buckets - functions of the row alone
- rows are numbered inside a bucket and shifted by the counts of the buckets
before it.  Rows equal in all these are one row with a count until they have their
ranks, so neither an id that a third of all rows share nor as many copies of one row
fill a bucket; they are unfolded in runs of ``RUN``.  Only ids, sizes and checksums are
shuffled, never texts.

Edge cases: a null source is a source of its own; a null text has size 1 (its
bytes plus 1) and no checksum; null ids come first; rows equal in id, source,
size and checksum may change places; an empty table gives no rows; fewer rows
than shards leave shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = "shard-shuffle:"
HEX = 3  # digest digits that name a bucket of a source: 16**HEX buckets
RUN = 65_536  # copies of one row that are unfolded together


def _running(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds the sum of ``cnt`` over earlier buckets, and over all."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("cnt").over(before), F.lit(0))).withColumn(
        "total", F.sum("cnt").over(Window.partitionBy(*by)))


def interleave(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
               shards: int = 16, fraction_buckets: int = 4096) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row."""
    rows = df.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"))
    text_form = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "size", "text_crc32")]
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(SEED), F.concat_ws(":", *text_form))))
    order = ["h", "doc_id", "size", "text_crc32"]
    rows = rows.groupBy("source", *order).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("hb", F.substring("h", 1, HEX))
    # rank inside the source; the few counts are joined back null-safely
    inside = Window.partitionBy("source", "hb").orderBy(*order)
    ranked = rows.withColumn("first", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    counts = _running(rows.groupBy("source", "hb").agg(F.sum("copies").alias("cnt")), ["source"], "hb")
    counts = counts.select(F.col("source").alias("cs"), F.col("hb").alias("ch"), "before", "total")
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("cs")) & (F.col("hb") == F.col("ch")))
    ranked = ranked.withColumn("first", F.col("before") + F.coalesce("first", F.lit(0)))
    # copies are unfolded: the runs of a row, spread by themselves, then the rows of a run
    runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {RUN}")))
    many = ranked.where("copies > 1").withColumn("run", runs).repartition(*order, "run")
    many = many.withColumn("c", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1)))
    ranked = ranked.where("copies = 1").withColumn("c", F.lit(0).cast("bigint")).unionByName(many.drop("run"))
    r = F.col("first") + F.col("c") + 1
    ranked = ranked.withColumn("frac", (2 * r - 1) / (2 * F.col("total")))
    ranked = ranked.withColumn("fb", F.floor(F.col("frac") * fraction_buckets).cast("int"))
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "h", "frac", "fb")
    # place in the whole order; bucket counts follow from the sources' counts alone
    whole = Window.partitionBy("fb").orderBy("frac", "source", *order)
    placed = ranked.withColumn("p", F.row_number().over(whole))
    buckets = ranked.groupBy("fb").agg(F.count(F.lit(1)).alias("cnt")).withColumn("all", F.lit(1))
    buckets = _running(buckets, ["all"], "fb").select(F.col("fb"), "before", "total")
    placed = placed.join(buckets, "fb").withColumn("g", F.col("before") + F.col("p") - 1)
    cut = F.expr(f"(g * {shards}) div total")
    placed = placed.withColumn("shard", cut.cast("int"))
    # shard s begins at the first g with g * shards >= s * total
    begin = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("g") - begin).alias("slot"))
