"""Operator 1: MinHash near-duplicates.

1. Every text becomes the sorted set of 64-bit hashes of its word shingles.
2. Texts with equal sets form a class; its representative is the smallest id.
   Only representatives go on, so copies are never paired.
3. One-permutation hashing with optimal densification: a set's hashes fall into
   ``BINS`` bins and each keeps its minimum; an empty bin takes the value of the
   first occupied bin in its own fixed random order, so filled bins agree with
   the probability of the sets' similarity, independently of each other.
4. ``BANDS`` bands of ``ROWS`` bins are hashed to buckets.  At similarity 0.8 a pair
   misses all 51 buckets with probability (1 - 0.8**5)**51 < 2e-9.
5. Star-shaped candidate edges: a bucket ties each member to one hub, so its
   pairs grow with its size.  Edges are confirmed on the full sets with
   100 * |A & B| >= 80 * |A | B|.
6. A bucket is settled when every member is linked to its hub.  All members of
   the other buckets of three or more go through one exact join (``rest_pairs``),
   so no pair of a bucket stays untested.
7. Components by large and small stars, once; ids of copies through their class.

Scale: hubs are a minimum combined before the shuffle; a bucket is never
gathered; joins on bucket, class and hub are ordinary joins, whose skewed keys
are split.  Sets are made once, for texts that share a bucket with another one
(texts move once for it), and serve both confirmations.  Signatures, stars, sets
and links are written to the shared folder.

Edge cases: a null or empty text has an empty set and is linked with nothing
(not even with another empty one); fewer words than a shingle make one shingle
of the whole sequence; rows that share a doc_id count as one node of the graph;
a row with a null doc_id is linked with nothing, its component_id is null and it
is kept; repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.ship import ship_code
from stayline.llm import blocks, graph
from stayline.session import cut_lineage

BINS, ROWS, BANDS = 256, 5, 51
_SPACE = blocks.byte_set([(9, 13), (32, 32)])
_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- sets
def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, offsets = blocks.flat_utf8(column)
    data = blocks.LOWER[data]
    starts, ends, row = blocks.word_spans(data, offsets, ~_SPACE)
    h = blocks.mix64(blocks.word_keys(data, starts, ends))
    n = np.bincount(row, minlength=len(column))
    to = np.cumsum(n)
    full = max(0, len(h) - words + 1)
    s = np.zeros(full, np.uint64)
    for k in range(words):
        s = s * _M + h[k:k + full]
    s = blocks.mix64(s)
    for i in range(len(column)):
        lo, hi = int(to[i] - n[i]), int(to[i])
        if n[i] >= words:
            own = np.sort(s[lo:hi - words + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n[i]:
            x = _U(0)
            with np.errstate(over="ignore"):
                for v in h[lo:hi]:
                    x = x * _M + v
            yield blocks.mix64(np.array([x + _U(int(n[i]))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For every bin a fixed random order of the bins, and each bin's place in it."""
    cell = np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)
    order = np.argsort(blocks.mix64(cell + _U(0xA5A5A5A5)), axis=1).astype(np.int32)
    return order, np.argsort(order, axis=1).astype(np.int32)


_ORDER, _PLACE = _orders()


def signature(own: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted, non-empty set."""
    bins = (own >> _U(64 - 8)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    occupied = bins[first]
    sig = np.zeros(BINS, np.uint64)
    sig[occupied] = own[first]
    if len(occupied) == BINS:
        return sig
    has = np.zeros(BINS, bool)
    has[occupied] = True
    empty = np.flatnonzero(~has)
    if len(occupied) <= 24:
        near = occupied[_PLACE[empty][:, occupied].argmin(axis=1)]
    else:
        near = np.full(len(empty), -1)
        left, t = np.arange(len(empty)), 0
        while len(left):
            cand = _ORDER[empty[left], t]
            ok = has[cand]
            near[left[ok]] = cand[ok]
            left = left[~ok]
            t += 1
    sig[empty] = sig[near]
    return sig


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """Bucket keys [set, band] of signatures [set, bin]."""
    rows = sigs[:, :BANDS * ROWS].reshape(len(sigs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), BANDS)).copy()
    for k in range(ROWS):
        key = blocks.mix64(key * _M + rows[:, :, k])
    return key.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _signed(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (fingerprint of the set), bands."""

    def run(batches):
        for batch in batches:
            for i, j in blocks.row_blocks(batch.column(1)):
                col = batch.column(1).slice(i, j - i)
                sets = list(shingle_sets(col, words))
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                k1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([int(np.bitwise_xor.reduce(blocks.mix64(s ^ _M))) if len(s) else 0 for s in sets],
                              np.uint64).view(np.int64)
                bands: list = [np.zeros(0, np.int64)] * len(sets)
                if len(some):
                    keys = band_keys(np.stack([signature(sets[k]) for k in some]))
                    for k, row in zip(some.tolist(), keys):
                        bands[k] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(k1), pa.array(k2), _lists(bands)],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"])
        blocks.release()

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, k (tells the sets of one id apart), shingles of documents (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for i, j in blocks.row_blocks(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).slice(i, j - i), words)]
                n = pa.array([len(s) for s in sets], pa.int64())
                k = pa.array([int(s.sum()) if len(s) else 0 for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, k, _lists(sets)],
                                                 names=["doc_id", "n", "k", "shingles"])
        blocks.release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, k bigint, shingles array<bigint>")


# ---------------------------------------------------------------- links
def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets reach the similarity."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.col("na") + F.col("nb")).alias("n"))
    return both.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def stars(member: DataFrame) -> DataFrame:
    """bucket, doc_id, hub (the smallest id of the bucket), size, for buckets of
    several documents.  ``member``: doc_id, bands."""
    rows = member.select("doc_id", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("hi"),
                                      F.count(F.lit(1)).alias("size"))
    hubs = graph.own_exchange(hubs.where("hub < hi").select("bucket", "hub", "size"), "bucket")
    return rows.join(hubs, "bucket")


def untested(star: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, label of all documents of buckets in which a document is not linked
    to the hub and a third one is there to be linked with.  Documents of equal
    label are linked already, through the smallest hub of each."""
    label = links.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "doc_id")
    wide = star.where("size > 2")
    linked = links.select(F.col("a").alias("doc_id"), F.col("b").alias("hub"))
    mixed = wide.where("doc_id <> hub").join(linked, ["doc_id", "hub"], "left_anti").select("bucket")
    crowd = wide.join(mixed, "bucket", "left_semi").select("doc_id").distinct()
    return crowd.join(label, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"))


def rest_pairs(sets: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """All pairs (a > b) of different labels that can reach the similarity: a
    prefix-filter join on exact counts.

    A shingle counts only if documents of two labels have it.  Of a set of n, u
    count, in one order of all, the rarest first.  Two sets share at least
    o = ceil(p n / 100) for the larger and ceil(2 p n / (100 + p)) for the smaller,
    so the first two shingles they share are within the first u - o + 2 of both:
    a pair must meet twice there, and the places bound what can still follow.  A set
    with u < o is linked with nothing.  The order decides the cost, never the result."""
    own = sets.join(crowd, "doc_id")
    token = own.select("doc_id", "k", "n", "label", F.explode("shingles").alias("t"))
    shared = token.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    shared = graph.own_exchange(shared.where("lo < hi").select("t", "df"), "t")
    row = token.join(shared, "t").groupBy("doc_id", "k", "n", "label").agg(
        F.sort_array(F.collect_list(F.struct("df", "t"))).alias("u"))
    large, small = F.ceil(F.col("n") * percent / 100), F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    row = row.withColumn("c", F.size("u")).where(F.col("c") >= large)
    row = cut_lineage(row.select("doc_id", "n", "label", "c", (F.col("c") - small + 3).alias("short"),  # one spare for rounding
                                 F.slice(F.transform("u", lambda x: x.t), F.lit(1), (F.col("c") - large + 3).cast("int")).alias("u")))
    left = row.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("c").alias("ux"),
                      F.posexplode(F.slice("u", F.lit(1), F.greatest(F.col("short"), F.lit(0)).cast("int"))).alias("px", "t"))
    right = row.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"), F.col("c").alias("uy"),
                       F.posexplode("u").alias("py", "t"))
    first = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    both = left.join(right, "t").where(
        (F.col("lx") != F.col("ly")) & first & (F.col("nx") * 100 >= F.col("ny") * percent)
        & ((F.least(F.col("ux") - F.col("px"), F.col("uy") - F.col("py")) + 1) * (100 + percent)
           >= (F.col("nx") + F.col("ny")) * percent))
    met = both.groupBy(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    return met.where("m > 1").select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    ship_code(docs.sparkSession)
    signed = cut_lineage(_signed(docs, key, text, words))
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    some = signed.where(~alone)
    fingerprint = ["n_shingles", "k1", "k2"]
    classes = graph.own_exchange(some.groupBy(*fingerprint).agg(F.min("doc_id").alias("rep")), "k1")
    # of n shingles a different set shares at most n of n + 1
    can = (F.col("doc_id") == F.col("rep")) & (F.col("n_shingles") * 100 >= (F.col("n_shingles") + 1) * percent)
    member = cut_lineage(some.join(classes, fingerprint).select("doc_id", "n_shingles", "rep", F.when(can, F.col("bands")).alias("bands")))
    star = cut_lineage(stars(member.where("bands IS NOT NULL")))
    sets = cut_lineage(_sets(own.join(star.select("doc_id"), "doc_id", "left_semi"), words))
    pairs = star.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut_lineage(confirm(pairs, sets, percent))
    crowd = cut_lineage(untested(star, links))
    if not crowd.isEmpty():
        more = confirm(rest_pairs(sets, crowd, percent), sets, percent)
        links = links.unionByName(more)
    # an id with several texts ties their classes
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a > b")
    comp = graph.components(cut_lineage(links.unionByName(twice.select("a", "b"))))
    out = member.select("doc_id", "n_shingles", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(signed.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
                percent: int = 80) -> DataFrame:
    """``docs`` with one document of every component; rows without an id stay.
    Texts alone link, an id does not: where an id has several rows, each row is a
    node of its own, and of a component the row with the smallest (id, digest of
    the text, rest of the row) stays.  Texts without a word: one row of an id."""
    known = F.col(key).isNotNull()
    if docs.where(known).groupBy(key).count().where("count > 1").isEmpty():
        gone = near_duplicates(docs, key, text, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias(key))
        return docs.join(cut_lineage(gone.distinct()), key, "left_anti")
    # the rows are numbered and written, so that a row is the same one in every use
    row = blocks.free_name("__row", docs.columns)
    rows = cut_lineage(docs.where(known).withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(row, text), row, text, words, percent)
    rest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
    order = rows.select(row, F.col(key).cast("bigint").alias("id"), F.struct(
        F.col(key).cast("bigint").alias("id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"),
        rest.alias("rest"), F.col(row).alias("row")).alias("o"), F.col(row).alias("doc_id"))
    both = order.drop(row).join(found, "doc_id")
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("c"),
             F.when(F.col("n_shingles") == 0, F.col("id")).alias("e")]
    kept = cut_lineage(both.groupBy(*group).agg(F.min("o").alias("o")).select(F.col("o.row").alias(row)))
    return rows.join(kept, row, "left_semi").select(*docs.columns).unionByName(docs.where(~known))
