"""Operator 5: language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of its labelled text
recognises exactly the substrings of that text.  A document is parsed greedily
into longest matches (phrases) with each automaton; with c phrases over n
symbols and a sample of N symbols the cross-parsing entropy is c * log2(N) / n,
and the language with the smallest one wins.

Symbols are lower-cased letters; every run of other characters is one blank.
Texts are parsed whole, in pieces of ``PIECE`` symbols (a phrase ends at a
piece's end, for each language alike), all pieces of a block side by side.

Fitting: per language the ``sample_docs`` distinct training texts with the
smallest keyed digest of their id, of each the ``sample_chars`` characters from
its first letter on - the bound of what is learned from.  Texts whose stretches
have the same symbols count once, texts without a letter never.  The automata are built in tasks, one per language, and
their tables (about 16 bytes a transition, at most three transitions a
symbol) are shipped as one broadcast.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties
between languages go to the smaller name; with nothing to learn from every text
is ``und``; a very long text is many pieces; null ids are never learned from;
repeated rows and empty tables are ordinary.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.llm.ship import ship_code
from stayline.llm import blocks
from stayline.llm.vocab import LETTER, char_classes
from stayline.session import cut_lineage

PIECE = 256
SAMPLE_DOCS = 24
SAMPLE_CHARS = 4_000
UND = "und"
MIN_PHRASE = 1.5


# ---------------------------------------------------------------- symbols
def letters(text: str) -> list[str]:
    """The text's symbols: lower-cased letters, one blank for other runs."""
    cls = char_classes()
    out = "".join(c if cls[ord(c)] == LETTER else " " for c in text.lower())
    return list(" ".join(out.split()))


# ---------------------------------------------------------------- automaton
def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def packed(nxt: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, int]:
    """Row-displacement table: entry ``base + symbol`` holds (base, next base);
    a state is named by its base, which is its own.  Returns (table, start)."""
    size = 3 * sum(map(len, nxt)) + len(nxt) + alphabet
    used = bytearray(size + alphabet)
    taken = bytearray(size)
    base = [0] * len(nxt)
    b = 0
    for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):  # the widest rows first
        syms = list(nxt[s])
        while taken[b] or any(used[b + c] for c in syms):
            b = (b + 1) % size
        base[s] = b
        taken[b] = 1
        for c in syms:
            used[b + c] = 1
        b = (b + 7919) % size
    table = np.full(size + alphabet, -1, np.int64)
    for s, row in enumerate(nxt):
        for c, to in row.items():
            table[base[s] + c] = base[s] << 32 | base[to]
    return table, base[0]


class Parser:
    """Phrase counts of symbol sequences under one language's automaton."""

    def __init__(self, lang: str, symbols: list[str]):
        self.lang, self.size = lang, len(symbols)
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted(set(symbols)))}  # 0: unknown
        self.width = len(self.alphabet) + 1
        self.table, self.start = packed(suffix_automaton([self.alphabet[c] for c in symbols]), self.width)


    def phrases(self, sym: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``sym`` [step, lane], lanes in order of falling length."""
        lanes = sym.shape[1]
        state = np.full(lanes, self.start, np.int64)
        count = np.zeros(lanes, np.int64)
        running = np.searchsorted(-length, -np.arange(sym.shape[0]), "left")
        start_row = np.array([self.table[self.start + c] for c in range(self.width)], np.int64)
        after_start = np.where(start_row >> 32 == self.start, start_row & 0xFFFFFFFF, -1)
        after_start[0] = -1
        for t in range(sym.shape[0]):
            m = int(running[t])
            if not m:
                break
            q, c = state[:m], sym[t, :m]
            v = self.table.take(q + c)
            to = v & 0xFFFFFFFF
            miss = np.flatnonzero((v >> 32 != q) | (c == 0))
            if len(miss):
                again = after_start.take(c[miss])
                none = again < 0  # a symbol the sample lacks is a phrase of its own
                count[miss] += (q[miss] != self.start).astype(np.int64) + none
                to[miss] = np.where(none, self.start, again)
            state[:m] = to
        return count + (state != self.start)


def fit(train: DataFrame, text: str, lang: str, key: str, sample_docs: int = SAMPLE_DOCS,
        sample_chars: int = SAMPLE_CHARS) -> list[Parser]:
    """One parser per language from a bounded sample of labelled texts."""
    ship_code(train.sparkSession)
    raw = F.col(text)
    begin = F.length(F.regexp_extract(raw, r"^\P{L}*+", 0)) + 1
    own = train.select(F.col(lang).alias("lang"), F.substring(raw, begin, F.lit(sample_chars)).alias("text"),
                       F.md5(F.concat(F.lit("lang-sample:"), F.col(key).cast("string"))).alias("pick"))
    own = own.where(F.col("lang").isNotNull() & F.col("pick").isNotNull() & (F.length("text") > 0))
    own = own.withColumn("same", F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\P{L}+", " "))))
    # distinct texts are picked by their hashes alone; at most sample_docs rows a language are broadcast
    first = Window.partitionBy("lang").orderBy("pick", "same")
    picks = own.groupBy("lang", "same").agg(F.min("pick").alias("pick"))
    picks = cut_lineage(picks.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample_docs).drop("_n"))
    own = own.join(F.broadcast(picks), ["lang", "same", "pick"]).groupBy("lang", "same", "pick").agg(
        F.min("text").alias("text"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pick", "text"])
        symbols: list[str] = []
        for x in pdf["text"]:
            symbols += letters(x) + [" "]
        made = [pickle.dumps(Parser(pdf["lang"].iloc[0], symbols))] if any(c != " " for c in symbols) else []
        return pd.DataFrame({"parser": pd.Series(made, dtype=object)})

    rows = own.groupBy("lang").applyInPandas(build, "parser binary").collect()
    return sorted((pickle.loads(bytes(r.parser)) for r in rows), key=lambda p: p.lang)


class Alphabet:
    """One numbering of all languages' symbols, and each language's own."""

    def __init__(self, parsers: list[Parser]):
        both = sorted({c for p in parsers for c in p.alphabet})
        self.of_code = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(both):
            self.of_code[ord(c)] = k + 1
        self.own = [np.array([0, *(p.alphabet.get(c, 0) for c in both)], np.int32) for p in parsers]


def _symbol_blocks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts' symbols (blank 32) and symbols per text."""
    joined = "\0".join([*texts, ""])
    low = joined.lower()
    code = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    if len(low) != len(joined):  # lower-casing may lengthen a text
        lengths = np.fromiter((len(x.lower()) for x in texts), np.int64, len(texts))
    else:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    is_letter = char_classes().take(code) == LETTER
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others after a letter is the blank
    keep[ends] = False
    row = np.repeat(np.arange(len(texts)), lengths + 1)[keep]
    return np.where(is_letter, code, 32)[keep], np.bincount(row, minlength=len(texts))


def entropies(parsers: list[Parser], symbols: Alphabet, texts: list[str]) -> np.ndarray:
    """Cross-parsing entropy [text, language]; inf for a text without letters."""
    code, n = _symbol_blocks(texts)
    out = np.full((len(texts), len(parsers)), np.inf)
    if not len(code) or not parsers:
        return out
    pieces = -(-n // PIECE)
    text_of = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(n) - n, pieces) + nth * PIECE
    length = np.minimum(PIECE, n[text_of] - nth * PIECE)
    order = np.argsort(-length, kind="stable")
    begin, length, text_of = begin[order], length[order], text_of[order]
    sym = np.append(symbols.of_code.take(code), np.zeros(PIECE, np.uint16))
    grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(sym, int(length[0]))[begin].T)
    for k, p in enumerate(parsers):
        c = np.bincount(text_of, weights=p.phrases(symbols.own[k].take(grid), length), minlength=len(texts))
        out[:, k] = np.where(n > 0, c * np.log2(max(p.size, 2)) / np.maximum(n, 1), np.inf)
    return out


def predict(df: DataFrame, text: str, parsers: list[Parser]) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (how far the winner's entropy is below the
    runner-up's, 0 to 1; 1 with a single language) and ``accepted``: the text has
    letters and the winner's phrases are ``MIN_PHRASE`` symbols long on average, which
    a text in no learned script or language does not reach."""
    ship_code(df.sparkSession)
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "accepted": T.BooleanType()}
    keep = [f for f in df.schema.fields if f.name not in added]
    take = list(dict.fromkeys([f.name for f in keep] + [text]))
    schema = T.StructType(keep + [T.StructField(n, t) for n, t in added.items()])
    shipped = df.sparkSession.sparkContext.broadcast(parsers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        symbols = Alphabet(own)
        names = np.array([p.lang for p in own] + [UND], object)
        most = np.array([np.log2(max(p.size, 2)) / MIN_PHRASE for p in own] + [-1.0])
        for batch in batches:
            column = batch.column(take.index(text))
            for i, j in blocks.row_blocks(column, 1 << 20):
                h = entropies(own, symbols, [x or "" for x in column.slice(i, j - i).to_pylist()])
                und = ~np.isfinite(h).any(axis=1) if h.shape[1] else np.ones(j - i, bool)
                if h.shape[1]:
                    best = np.where(und, len(own), h.argmin(axis=1))
                    low = np.sort(h, axis=1)[:, :2]
                    first = np.where(und, 0, low[:, 0])
                    score = np.ones(j - i) if h.shape[1] == 1 else 1 - np.divide(
                        first, low[:, 1], out=np.ones(j - i), where=~und & (low[:, 1] > 0))
                else:
                    best, score, first = np.zeros(j - i, np.int64), np.zeros(j - i), np.zeros(j - i)
                score = np.where(und, 0.0, np.clip(score, 0, 1))
                part = batch.slice(i, j - i)
                cols = [part.column(k) for k, n in enumerate(take) if n not in added]
                cols += [pa.array(names[best], pa.string()), pa.array(score, pa.float64()),
                         pa.array(first <= most[best], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])
        blocks.release()

    return df.select(*[df[f"`{n}`"] for n in take]).mapInArrow(run, schema)


def training_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the training folds: crc32 of the id as text, modulo 4, is not 2."""
    return df.where(F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2)
