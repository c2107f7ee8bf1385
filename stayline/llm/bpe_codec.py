"""Operator 2: byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a task are worked on in chunks of rows.  A chunk's distinct pieces
(words as the split pattern cuts them) form the corpus; an inverted index from
token pair (kept by the rank of its merge) to word positions applies every merge
in rank order to all words at once and re-indexes only the neighbours it
touched.  Occurrences of a piece then take the ids of their distinct piece.

No shuffle: a text is encoded where it is read, and a chunk is bounded in bytes.

Edge cases: a null or empty text has no ids (empty array) and decodes to empty
bytes; one text longer than the chunk bound is a chunk of its own; repeated rows
give repeated results; an empty table gives no rows; input columns whose names
clash with the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stayline.llm import blocks, pretoken
from stayline.llm.vocab import broadcast_file, tiktoken_ranks

CORPUS_BYTES = 4 << 20
_NONE = np.int32(2**31 - 1)


def distinct_spans(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each distinct span, the distinct span of each
    occurrence).  Keys of up to 7 bytes are the bytes; longer spans of an equal
    key are compared byte by byte with the first one."""
    inverse, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)  # the last written is the first occurrence
    other = first[inverse]
    check = np.flatnonzero((hi - lo > 7) & (other != np.arange(len(lo))))
    size = np.cumsum(hi[check] - lo[check])
    wrong, i = [], 0
    while i < len(check):  # a bounded number of bytes at a time
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + blocks.BLOCK_BYTES, "right")))
        a = check[i:j]
        b, n = other[a], hi[a] - lo[a]
        same = n == hi[b] - lo[b]
        a, b, n = a[same], b[same], n[same]
        wrong += check[i:j][~same].tolist()
        if len(a):
            differ = data[blocks.ragged(lo[a], n)] != data[blocks.ragged(lo[b], n)]
            wrong += a[np.logical_or.reduceat(differ, np.cumsum(n) - n)].tolist()
        i = j
    if wrong:  # another word under the same key: told apart by its bytes
        raw, own = data.tobytes(), {}
        first = first.tolist()
        for k in wrong:
            word = raw[lo[k]:hi[k]]
            if word not in own:
                own[word] = len(first)
                first.append(k)
            inverse[k] = own[word]
        first = np.array(first)
    return first, inverse


class PairTable:
    """Rank of the token that two adjacent tokens make, by binary search."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, vals = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**63 - 1))
        self.vals = np.append(np.array(vals, np.int32)[order], _NONE)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, k)
        return np.where(self.keys[at] == k, self.vals[at], _NONE)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, raw: bytes):
        self.ranks = tiktoken_ranks(raw)
        self.pairs = PairTable(self.ranks)
        size = max(self.ranks.values()) + 1
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = {r: t for t, r in self.ranks.items()}
        self.token_len = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        digits = [f"{i},".encode() for i in range(size)]
        self.digit_len = np.array([len(x) for x in digits], np.int64)
        self.digit_at = np.concatenate([[0], np.cumsum(self.digit_len)])
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)

    # ------------------------------------------------------------ encoding
    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids per word)."""
        n_words = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n_words)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        total = len(sym)
        if not total:
            return sym, lengths
        at = np.arange(total)
        last = np.zeros(total, bool)
        last[np.cumsum(lengths) - 1] = True
        first = np.zeros(total, bool)
        first[np.cumsum(lengths) - lengths] = True
        nxt = np.where(last, -1, at + 1)
        prv = np.where(first, -1, at - 1)
        rank = np.full(total, _NONE, np.int32)  # of the pair that begins here
        rank[~last] = self.pairs(sym[:-1][~last[:-1]], sym[1:][~last[:-1]])
        # inverted index: rank -> positions; first from one sort, then per touch
        have = np.flatnonzero(rank != _NONE)
        have = have[np.argsort(rank[have], kind="stable")]
        keys, cuts = np.unique(rank[have], return_index=True)
        cuts = np.append(cuts, len(have))
        start = {int(k): (int(cuts[i]), int(cuts[i + 1])) for i, k in enumerate(keys)}
        later: dict[int, list[int]] = {}
        queue = keys.tolist()  # sorted, hence a heap
        queued = set(queue)
        alive = np.ones(total, bool)
        while queue:
            r = heapq.heappop(queue)
            queued.discard(r)
            lo, hi = start.pop(r, (0, 0))
            p = have[lo:hi]
            more = later.pop(r, None)
            if more is not None:
                p = np.concatenate([p, np.array(more, np.int64)])
                p.sort()
                if len(p) > 1:
                    fresh = np.empty(len(p), bool)
                    fresh[0] = True
                    np.not_equal(p[1:], p[:-1], out=fresh[1:])
                    p = p[fresh]
            p = p[rank[p] == r]
            if not len(p):
                continue
            q = nxt[p]
            if len(p) > 1:
                chained = q[:-1] == p[1:]
                if chained.any():  # "aaa": leftmost first, every second of a run
                    idx = np.arange(len(p))
                    run_start = np.concatenate([[True], ~chained])
                    take = (idx - np.maximum.accumulate(np.where(run_start, idx, 0))) % 2 == 0
                    p, q = p[take], q[take]
            after = nxt[q]
            sym[p] = r
            nxt[p] = after
            alive[q] = False
            rank[q] = _NONE
            inner = after >= 0
            prv[after[inner]] = p[inner]
            before = prv[p]
            touched = np.concatenate([p, before[before >= 0]])
            right = nxt[touched]
            open_ = right >= 0
            rank[touched[~open_]] = _NONE
            touched, right = touched[open_], right[open_]
            if not len(touched):
                continue
            new = self.pairs(sym[touched], sym[right])
            rank[touched] = new
            keep = new != _NONE
            for k, pos in zip(new[keep].tolist(), touched[keep].tolist()):
                if k in later:
                    later[k].append(pos)
                else:
                    later[k] = [pos]
                    if k not in queued:
                        queued.add(k)
                        heapq.heappush(queue, k)
        counts = np.add.reduceat(alive.astype(np.int64), np.cumsum(lengths) - lengths)
        return sym[alive], counts

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte spans of the pieces, their texts' indices and 64-bit keys."""
        parts, at_byte, i = [], 0, 0
        while i < len(texts):  # small blocks stay in the processor's cache
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 19):
                size += len(texts[j])
                j += 1
            lo, hi, text_of = pretoken.pieces(texts[i:j])
            data = np.frombuffer("".join(texts[i:j]).encode(), np.uint8)
            parts.append((lo + at_byte, hi + at_byte, text_of + i, blocks.word_keys(data, lo, hi)))
            at_byte += len(data)
            i = j
        empty = np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*parts))) if parts else (empty, empty, empty, empty)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        raw = "".join(texts).encode()
        lo, hi, text_of, keys = self._pieces(texts)
        if not len(lo):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first, inverse = distinct_spans(np.frombuffer(raw, np.uint8), lo, hi, keys)
        words = [raw[a:b] for a, b in zip(lo[first].tolist(), hi[first].tolist())]
        # a piece that is a token as a whole is not merged
        whole = [self.ranks.get(w, -1) for w in words]
        rest = [k for k, r in enumerate(whole) if r < 0]
        ids, counts = self.replay([words[k] for k in rest])
        whole = np.array(whole, np.int64)
        flat = np.concatenate([ids.astype(np.int64), whole[whole >= 0]])
        n_ids = np.ones(len(words), np.int64)
        begin = np.zeros(len(words), np.int64)
        n_ids[rest] = counts
        begin[rest] = np.cumsum(counts) - counts
        begin[whole >= 0] = len(ids) + np.arange(int((whole >= 0).sum()))
        n = n_ids[inverse]
        out = flat[blocks.ragged(begin[inverse], n)].astype(np.int32)
        return out, np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)

    # ------------------------------------------------------------ decoding
    def decode(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of ids, one after another."""
        return self.token_bytes[blocks.ragged(self.token_at[ids], self.token_len[ids])]

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """The ids as decimal numbers, a comma after each."""
        return self.digit_bytes[blocks.ragged(self.digit_at[ids], self.digit_len[ids])]


_CODECS: dict[int, Codec] = {}


def codec(raw: bytes) -> Codec:
    """The codec of a rank file, built once a process."""
    key = hash(raw)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def _digests(c: Codec, ids: np.ndarray, counts: np.ndarray) -> tuple[list[str], list[str]]:
    """sha256 of the comma-joined ids and of the decoded bytes, per text."""
    id_hex, text_hex = [], []
    ends = np.cumsum(counts)
    for k0 in range(0, len(counts), 512):  # bounds the expanded digits
        part = counts[k0:k0 + 512]
        own = ids[ends[k0] - counts[k0]:ends[k0 + len(part) - 1]]
        cut = np.cumsum(part)
        for table, length, out, drop in ((c.decimals, c.digit_len, id_hex, 1), (c.decode, c.token_len, text_hex, 0)):
            data = memoryview(np.ascontiguousarray(table(own)))
            at = np.concatenate([[0], np.cumsum(length[own])])
            hi = at[cut]
            lo = np.concatenate([[0], hi[:-1]])
            out += [hashlib.sha256(data[a:max(a, b - drop)]).hexdigest() for a, b in zip(lo.tolist(), hi.tolist())]
    return id_hex, text_hex


def encode_decode(df: DataFrame, text: str, rank_file: str, *, with_ids: bool = True,
                  with_digests: bool = False) -> DataFrame:
    """Adds ``n_tokens``; with_ids: ``token_ids array<int>`` and ``decoded``
    (the text decoded from them); with_digests: ``ids_sha256`` and
    ``decoded_sha256``.  Bytes that are no UTF-8 cannot occur in a Spark string."""
    shipped = broadcast_file(df.sparkSession, rank_file)
    added = [("n_tokens", T.LongType())]
    if with_ids:
        added += [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    if with_digests:
        added += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    names = {n for n, _ in added}
    carried = [f for f in df.schema.fields if f.name not in names]
    source = next(f.name for f in df.schema.fields if f.name == text)
    take = list(dict.fromkeys([f.name for f in carried] + [source]))
    schema = T.StructType(carried + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value)
        for batch in batches:
            column = batch.column(take.index(source))
            for i, j in blocks.row_blocks(column, CORPUS_BYTES):
                texts = [x or "" for x in column.slice(i, j - i).to_pylist()]
                ids, counts = c.encode(texts)
                new: list[pa.Array] = [pa.array(counts, pa.int64())]
                if with_ids:
                    offs = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    new.append(pa.ListArray.from_arrays(offs, pa.array(ids, pa.int32())))
                    at = np.concatenate([[0], np.cumsum(c.token_len[ids])])[np.concatenate([[0], np.cumsum(counts)])]
                    data = c.decode(ids).tobytes()
                    new.append(pa.array([data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
                                        pa.string()))
                if with_digests:
                    id_hex, text_hex = _digests(c, ids, counts)
                    new += [pa.array(id_hex, pa.string()), pa.array(text_hex, pa.string())]
                part = batch.slice(i, j - i)
                cols = [part.column(k) for k, n in enumerate(take) if n not in names]
                yield pa.RecordBatch.from_arrays(cols + new, names=[f.name for f in schema.fields])
                del texts, ids, counts, new, part, cols
        blocks.release()

    return df.select(*[df[f"`{n}`"] for n in take]).mapInArrow(run, schema)
