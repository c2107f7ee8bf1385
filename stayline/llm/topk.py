"""Operator 6: exact top-k inner-product search by ball-tree branch and bound.

Candidates are dealt into shards of bounded size by a hash of their row's number.  A shard
builds a ball tree (split along the widest direction, nodes with centre and
radius); for a query q and a node (c, r) no member scores above q.c + |q| r.  A
block of queries walks the tree from the node with the highest bound down,
leaving out the queries whose kth score so far reaches the bound.

The current kth score is shared: every query is first searched in one shard,
the kth score it finds there goes with it to all other shards, and blocks raise
it further as their task goes on.  Only scores that can be among the k best come
back, and a window over each query's few survivors gives the result.

Components are floor(scale * x) integers, so scores are exact in double
arithmetic (the bound has a margin above rounding).  Queries are a stated set
(ids divisible by ``every``) against all rows: groups of at most about
``group_rows`` queries meet shards of about ``shard_rows`` rows, so a task holds a
bounded number of either.

Edge cases: a vector that is null, or holds a null, NaN or infinity, takes no
part; vectors of different length are never compared; an empty vector scores 0
against other empty ones; fewer than k candidates give all; ties go to the
smaller id; null ids take no part; rows with the query's id are its own rows and
no candidates; other repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.ship import ship_code
from stayline.session import cut_lineage

SHARD_ROWS = 8192
BLOCK_ROWS = 512
GROUP_ROWS = 32_768
LEAF = 256


class BallTree:
    """Nodes over rows of ``x`` in tree order: (low, high, centre, radius, children)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        self._grow(x, 0, len(x), leaf)
        self.x = x[self.order]
        self.centre = np.stack([n[2] for n in self.nodes])
        self.radius = np.array([n[3] for n in self.nodes])

    def _grow(self, x: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        rows = x[self.order[lo:hi]]
        c = rows.mean(axis=0)
        d = rows - c
        me = len(self.nodes)
        self.nodes.append((lo, hi, c, float(np.sqrt((d * d).sum(axis=1).max())), ()))
        if hi - lo > leaf:
            far = d[(d * d).sum(axis=1).argmax()]
            side = d @ far
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(side, mid)]
            kids = (self._grow(x, lo, lo + mid, leaf), self._grow(x, lo + mid, hi, leaf))
            self.nodes[me] = (*self.nodes[me][:4], kids)
        return me

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray):
        """Rows (query, id, score) that may be among the k best, given scores
        ``floor`` (in place: raised to the kth score found) that are surely reached."""
        norm = np.sqrt((q * q).sum(axis=1))
        bound = q @ self.centre.T + norm[:, None] * self.radius
        bound += 1e-6 * (1 + np.abs(bound))  # above any rounding
        ids = ids[self.order]
        best_s = np.full((len(q), k), -np.inf)
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, who = stack.pop()
            who = who[bound[who, node] >= floor[who]]
            if not len(who):
                continue
            lo, hi, _, _, kids = self.nodes[node]
            if kids:  # the child with the higher bound is searched first
                a, b = kids
                if (bound[who, a] - bound[who, b]).sum() > 0:
                    a, b = b, a
                stack += [(a, who), (b, who)]
                continue
            s = q[who] @ self.x[lo:hi].T
            s[own[who][:, None] == ids[lo:hi][None, :]] = -np.inf
            alls = np.concatenate([best_s[who], s], axis=1)
            alli = np.concatenate([best_i[who], np.broadcast_to(ids[lo:hi], s.shape)], axis=1)
            pick = np.lexsort((alli, -alls), axis=1)[:, :k] if hi - lo <= 64 else _best(alls, alli, k)
            best_s[who] = np.take_along_axis(alls, pick, 1)
            best_i[who] = np.take_along_axis(alli, pick, 1)
            floor[who] = np.maximum(floor[who], best_s[who, -1])
        keep = np.isfinite(best_s) & (best_s >= floor[:, None])
        r, c = np.nonzero(keep)
        return r, best_i[r, c], best_s[r, c]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best (score falling, id rising) of every row."""
    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(score), k), np.int64)
    for r in range(len(score)):
        c = np.flatnonzero(score[r] >= kth[r])  # ties of the kth included
        out[r] = c[np.lexsort((ids[r, c], -score[r, c]))][:k]
    return out


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64).reshape(len(values), -1)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50,
          scale: int = 256, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    ship_code(vectors.sparkSession)
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(key).cast("bigint").alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))
    # rows are numbered and written: shard, group and query follow from the row, so an
    # id that many rows share, or copies of one row, spread like any others
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    shards = -(-n // shard_rows)
    groups = max(1, -(-asked // group_rows))  # of queries that meet a shard at once
    part = lambda salt, m: F.pmod(F.xxhash64(F.col("row"), F.lit(salt)), F.lit(m)).cast("int")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    cand = rows.select("id", "v", part(1, shards).alias("shard"), every_group.alias("grp"))
    ask = rows.where(F.col("id") % every == 0).select(
        F.col("id").alias("query_id"), F.col("row").alias("dup"), F.col("v").alias("q"), part(2, groups).alias("grp"),
        part(3, shards).alias("home"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One shard (left) against a group of queries, in blocks."""
        out = []
        for dim, own in left.groupby(left["v"].map(len)):
            asked = right[right["q"].map(len) == dim]
            if not len(asked):
                continue
            ids = own["id"].to_numpy(np.int64)
            tree = BallTree(_matrix(own["v"]))
            for lo in range(0, len(asked), BLOCK_ROWS):
                part = asked.iloc[lo:lo + BLOCK_ROWS]
                qid = part["query_id"].to_numpy(np.int64)
                floor = part["floor"].to_numpy(np.float64).copy()
                r, i, s = tree.search(_matrix(part["q"]), qid, ids, k, floor)
                out.append(pd.DataFrame({"query_id": qid[r], "vec_id": i, "score": s.astype(np.int64),
                                         "dup": part["dup"].to_numpy(np.int64)[r]}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score", "dup")})

    schema = "query_id bigint, vec_id bigint, score bigint, dup bigint"
    # a repeated id asks once for each of its rows (``dup``)
    first = ask.withColumn("shard", F.col("home")).withColumn("floor", F.lit(float("-inf")))
    near = cand.groupBy("shard", "grp").cogroup(first.groupBy("shard", "grp")).applyInPandas(search, schema)
    near = cut_lineage(near)
    kth = near.groupBy("query_id", "dup").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    rest = ask.join(kth, ["query_id", "dup"], "left").withColumn(
        "floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard != home")
    far = cand.groupBy("shard", "grp").cogroup(rest.groupBy("shard", "grp")).applyInPandas(search, schema)
    w = Window.partitionBy("query_id", "dup").orderBy(F.col("score").desc(), "vec_id")
    both = near.unionByName(far).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
