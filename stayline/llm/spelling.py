"""Operator 11: spelling variants by reduced-alphabet generation.

1. Vocabulary: maximal letter runs of whole texts, counted; a run whose keyed hash
   is divisible by ``typo_every`` loses one code point (the planted slips).
2. Every letter is hashed to one of ``SYMBOLS`` symbols.  Words of an equal
   reduced word are a class; an edit of a word is at most the same edit of its
   reduced word (a replaced letter may keep its symbol).
3. The full one-edit neighbourhood of every distinct reduced word - itself, all
   deletions, replacements and insertions over the reduced alphabet - is generated
   as 64-bit hashes that follow from prefix and suffix sums, so a word of length
   L costs L x (2 x SYMBOLS - 1) numbers and no strings, however long it is.
4. The neighbourhoods are joined with the reduced vocabulary, classes with their
   words, and every candidate is verified on the original strings (edit
   distance exactly 1).  A hash can only add candidates, never lose one.  Before
   the shuffle a bitmap of fixed size (2**SEEN_BITS bits, 16 MB) drops most keys
   that no reduced word has; when the vocabulary outgrows it, it drops fewer.
5. A word's form is its near word of largest count, if that is at least twice its
   own; roots follow by pointer doubling: counts double along a chain, so it
   has at most log2(largest count) links and that many, halved each time, rounds.

Scale: occurrences are combined map-side; only the vocabulary is shuffled
afterwards.  Joins are ordinary joins on the reduced word, whose hot keys are
split; a word's near words are reduced to a count and a best one before their
shuffle and never gathered.

Edge cases: null and empty texts have no runs; a null doc_id is written as the
empty string in the hash; very long runs are words like any other; repeated rows
count each; an empty table gives no words; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm import blocks, graph
from stayline.llm.ship import ship_code
from stayline.session import cut_lineage

SYMBOLS = 8
SEEN_BITS = 27
_GAP = r"[^A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))
_U = np.uint64
_B = 0x9E3779B97F4A7C15
_BASE, _BACK = _U(_B), _U(pow(_B, -1, 1 << 64))


def _lower(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", typo_every: int = 97, min_length: int = 5,
               min_count: int = 3) -> DataFrame:
    """word, n; written once."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.split(text, _GAP)).alias("w"))
    runs = runs.where(F.char_length("w") >= min_length).select("id", _lower(F.col("w")).alias("w"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")))
    at = (F.col("h") % F.char_length("w")).cast("int")
    slip = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    words = runs.select(F.when(F.col("h") % typo_every == 0, slip).otherwise(F.col("w")).alias("word"))
    words = words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(words.where(F.col("n") >= min_count))


# ---------------------------------------------------------------- neighbourhoods
def symbol_of(letters: str, symbols: int = SYMBOLS) -> str:
    """The symbol of each letter: a digit or lower-case letter."""
    code = np.array([ord(c) for c in letters], np.uint64)
    return "".join(f"{int(x):x}" for x in blocks.mix64(code * _U(0xD6E8FEB86659FD93)) % _U(symbols))


def _key(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    return blocks.mix64(value + blocks.mix64(length.astype(np.uint64))).view(np.int64)


def _powers(top: int) -> np.ndarray:
    power = np.full(top, _BASE, np.uint64)
    power[0] = 1
    return np.multiply.accumulate(power)


def own_keys(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Key of each reduced word."""
    begin = np.cumsum(lengths) - lengths
    rel = np.arange(len(flat)) - np.repeat(begin, lengths)
    term = (flat.astype(np.uint64) + _U(1)) * _powers(int(lengths.max(initial=0)) + 2)[rel]
    total = np.concatenate([[_U(0)], np.cumsum(term, dtype=np.uint64)])
    return _key(total[begin + lengths] - total[begin], lengths)


def neighbourhood(flat: np.ndarray, lengths: np.ndarray, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own key of each reduced word; keys of all words one edit or none away;
    the word each belongs to).  ``flat``: symbols (from 0) of all words."""
    words = len(lengths)
    word = np.repeat(np.arange(words), lengths)
    begin = np.cumsum(lengths) - lengths
    rel = np.arange(len(flat)) - begin[word]
    power = _powers(int(lengths.max(initial=0)) + 2)
    x = flat.astype(np.uint64) + _U(1)
    term = x * power[rel]
    total = np.concatenate([[_U(0)], np.cumsum(term, dtype=np.uint64)])
    before = total[:-1] - total[begin][word]
    whole = total[begin + lengths] - total[begin]
    after = whole[word] - before  # with the letter itself
    n = lengths[word]
    own = _key(whole, lengths)
    keys, of = [own], [np.arange(words)]
    last = np.ones(len(flat), bool)  # of a run of one symbol only the last is deleted
    last[:-1] = (flat[1:] != flat[:-1]) | (word[1:] != word[:-1])
    keys.append(_key(before + (after - term) * _BACK, n - 1)[last])
    of.append(word[last])
    for d in range(1, symbols):
        other = (flat.astype(np.uint64) + _U(d)) % _U(symbols) + _U(1)
        keys.append(_key(whole[word] + (other - x) * power[rel], n))
        of.append(word)
        # put before the letter (a symbol equal to it gives what stands behind it gives)
        keys.append(_key(before + other * power[rel] + after * _BASE, n + 1))
        of.append(word)
    for c in range(symbols):
        keys.append(_key(whole + _U(c + 1) * power[lengths], lengths + 1))
        of.append(np.arange(words))
    return own, np.concatenate(keys), np.concatenate(of)


def _keyed(reduced: DataFrame, symbols: int) -> DataFrame:
    """``reduced`` and its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks.row_blocks(batch.column(0)):
                part = batch.column(0).slice(i, j - i)
                flat, lengths = _symbols(part)
                yield pa.RecordBatch.from_arrays([part, pa.array(own_keys(flat, lengths))], names=["reduced", "key"])
        blocks.release()

    return reduced.select("reduced").mapInArrow(run, "reduced string, key bigint")


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = blocks.flat_utf8(column)
    return np.where(data < 58, data - 48, data - 87).astype(np.int64), np.diff(offsets)


def _seen_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with those of the keys set: of fixed size."""
    cell = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    parts = keys.select(cell.alias("c")).groupBy(F.shiftright("c", 15).alias("b")).agg(
        F.bitmap_construct_agg(F.col("c") % 32768).alias("m"))
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in parts.collect():
        out[r.b] = np.frombuffer(bytes(r.m), np.uint8)
    return out.reshape(-1)


def _generate(classes: DataFrame, symbols: int, seen) -> DataFrame:
    """(key of the reduced word, key in its neighbourhood), without keys that no
    reduced word can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = seen.value
        low = _U(8 * len(bitmap) - 1)
        for batch in batches:
            for i, j in blocks.row_blocks(batch.column(0), 1 << 14):
                own, keys, of = neighbourhood(*_symbols(batch.column(0).slice(i, j - i)), symbols)
                c = (keys.view(np.uint64) & low).astype(np.int64)
                hit = (bitmap[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(own[of[hit]]), pa.array(keys[hit])], names=["src", "key"])
        blocks.release()

    return classes.select("reduced").mapInArrow(run, "src bigint, key bigint")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, bits: int = SEEN_BITS) -> DataFrame:
    """word, near, near_n: every ordered pair of words exactly one edit apart."""
    spark = words.sparkSession
    ship_code(spark)
    own = words.select("word", "n", F.translate("word", LETTERS, symbol_of(LETTERS, symbols)).alias("reduced"))
    classes = cut_lineage(_keyed(own.select("reduced").distinct(), symbols))
    own = cut_lineage(own.join(classes, "reduced").select("word", "n", "key"))
    seen = spark.sparkContext.broadcast(_seen_bits(classes, bits))
    around = _generate(classes, symbols, seen).join(classes.select("key"), "key", "left_semi").distinct()
    left = own.select("word", F.col("key").alias("src")).join(graph.own_exchange(around, "src"), "src").select("word", "key")
    right = own.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    pairs = graph.own_exchange(left, "key").join(graph.own_exchange(right, "key"), "key")
    return pairs.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).select(
        "word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the links (word, form): pointer doubling."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"),
                                                                  F.col("far").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", typo_every: int = 97, min_length: int = 5,
             min_count: int = 3, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = vocabulary(docs, key, text, typo_every, min_length, min_count)
    best = near_pairs(words, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    own = words.join(best, "word", "left")
    is_form = -F.col("b.m") >= 2 * F.col("n")
    own = cut_lineage(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                 F.when(is_form, F.col("b.w")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n")))
    end = roots(own.where("form IS NOT NULL"))
    return own.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                                                "form_n")
