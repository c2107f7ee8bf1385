"""Operator 10: quality classifier - hashed word n-grams, logistic regression
trained with follow-the-regularised-leader (FTRL-proximal) updates.

Words are runs of letters-or-digits and runs of other printable bytes; a word's
shape (case, digits, symbol, the same as the word before) counts as a word too.
Features are single words, word pairs, shapes, shape pairs and shape triples,
hashed into 2**``BITS`` weights; a text's value of a feature is its share of the
text's n-grams, so the score is a sparse dot product of whole texts.

Learning uses a bounded sample: the ``sample`` labelled rows with the smallest
keyed digest of their id, of at most ``SAMPLE_BYTES`` bytes, one text of each id.  Only their ids are broadcast to find the texts (a
proven size), the updates run in one task in digest order, and the weights have
a fixed size.  Scoring runs where the text is read; no shuffle.

Edge cases: a null or empty text has no features and is scored by the bias; a
null label is not learned from; without any label every score is 0.5; texts of
any length are scored whole; repeated rows and empty tables are ordinary; input
columns whose names clash with the added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.llm.ship import ship_code
from stayline.llm import blocks

BITS = 18
SAMPLE = 6_000
SAMPLE_BYTES = 65_536
SCALE = 8.0
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.002, 0.5, 3
_U = np.uint64

WORD = blocks.byte_set([(48, 57), (65, 90), (97, 122), (128, 255)])
SYMBOL = blocks.byte_set([(33, 47), (58, 64), (91, 96), (123, 126)])
_UPPER = blocks.byte_set([(65, 90)])
_DIGIT = blocks.byte_set([(48, 57)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight index, row) of every n-gram of the rows."""
    a = blocks.word_spans(data, offsets, WORD)
    b = blocks.word_spans(data, offsets, SYMBOL)
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    starts, ends, row = (np.concatenate(x)[order] for x in zip(a, b))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = blocks.span_hashes(data, starts, ends)
    cum_up = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int32)])
    cum_dig = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    n = ends - starts
    upper, digit = cum_up[ends] - cum_up[starts], cum_dig[ends] - cum_dig[starts]
    symbol = SYMBOL[data[starts]]
    first_upper = _UPPER[data[starts]]
    shape = np.select([symbol, digit > 0, (upper == n) & (n > 1), first_upper], [1, 2, 3, 4], 5).astype(np.uint64)
    shape = np.where(symbol, shape * _U(16) + np.minimum(n, 5).astype(np.uint64), shape)

    def back(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return x[:-k], row[k:] == row[:-k]

    prev = np.zeros(len(word), np.uint64)
    prev[1:] = np.where(row[1:] == row[:-1], word[:-1], _U(0))
    prev2 = np.zeros(len(word), np.uint64)
    prev2[2:] = np.where(row[2:] == row[:-2], word[:-2], _U(0))
    again = ((word == prev) | (word == prev2)) & ~symbol
    shape = blocks.mix64(shape + _U(1000) * again.astype(np.uint64) + _U(77))
    idx, of = [word, shape], [row, row]
    mult = _U(0x9E3779B97F4A7C15)
    for x, salt in ((word, _U(3)), (shape, _U(5))):
        left, same = back(x, 1)
        pair = blocks.mix64(left * mult + x[1:] + salt)
        idx.append(pair[same])
        of.append(row[1:][same])
        if x is shape and len(x) > 2:
            left2, same2 = back(x, 2)
            triple = blocks.mix64((left2 * mult + x[1:-1]) * mult + x[2:] + _U(7))
            idx.append(triple[same2])
            of.append(row[2:][same2])
    return (np.concatenate(idx) >> _U(64 - BITS)).astype(np.int64), np.concatenate(of)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates in the order of ``rows``: (indices,
    values, label).  The last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0,
                        -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for idx, val, y in rows:
            i, x = np.append(idx, size - 1), np.append(val, 1.0)
            w = weight(i)
            g = (_sigmoid(w @ x) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(size))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled rows of ``docs``, of at
    most ``sample_bytes`` bytes each."""
    ship_code(docs.sparkSession)
    pick = (labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"),
                          F.md5(F.concat(F.lit("quality-sample:"), F.col(key).cast("string"))).alias("_h"))
            .where(F.col("_k").isNotNull() & F.col("_y").isNotNull()).orderBy("_h", "_k", "_y").limit(sample))
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(pick), "_k")
    rows = rows.where(F.coalesce(F.octet_length("_t"), F.lit(0)) <= sample_bytes)
    # one text of a picked id, chosen before the shuffle: an id that many rows share is learned from once
    rows = rows.groupBy("_k", "_y", "_h").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t"))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, t, y in zip(pdf["_h"], pdf["_t"], pdf["_y"]):
                raw = (t or "").encode()
                idx, _ = features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                uniq, cnt = np.unique(idx, return_counts=True)
                val = cnt * (SCALE / max(1, len(idx)))
                out.append((h, uniq.astype(np.int32).tobytes(), val.astype(np.float32).tobytes(), int(y > 0)))
            yield pd.DataFrame(out, columns=["h", "i", "v", "y"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "y", "i"])
        got = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), y)
               for i, v, y in zip(pdf["i"], pdf["v"], pdf["y"])]
        return pd.DataFrame({"w": [ftrl(got).astype(np.float32).tobytes()]})

    made = (rows.mapInPandas(sparse, "h string, i binary, v binary, y int")
            .withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "w binary").collect())
    return np.frombuffer(bytes(made[0].w), np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Adds ``score``, the probability of label 1."""
    ship_code(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != "score"]
    take = list(dict.fromkeys([f.name for f in keep] + [text]))
    schema = T.StructType(keep + [T.StructField("score", T.DoubleType())])
    shipped = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        for batch in batches:
            column = batch.column(take.index(text))
            for i, j in blocks.row_blocks(column, 1 << 21):
                data, offsets = blocks.flat_utf8(column.slice(i, j - i))
                idx, row = features(data, offsets)
                n = np.bincount(row, minlength=j - i)
                dot = np.bincount(row, weights=w.take(idx), minlength=j - i)
                out = _sigmoid(float(w[-1]) + SCALE * dot / np.maximum(n, 1))
                part = batch.slice(i, j - i)
                cols = [part.column(k) for k, name in enumerate(take) if name != "score"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(out, pa.float64())],
                                                 names=[f.name for f in schema.fields])

    return df.select(*[df[f"`{n}`"] for n in take]).mapInArrow(run, schema)


def training_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels of the training folds: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0)
