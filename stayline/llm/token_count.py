"""Operator 8: token counts by finite-state transducers.

Two deterministic transducers run over a text.  The first (``pretoken``) splits
it into pieces: chunk state maps, composed by a parallel prefix scan, give every
chunk its entry state.  The second counts byte-level BPE tokens inside a piece.
Its state after a prefix is what later bytes can still change: the longest
suffix that begins some token, and for every position of that suffix the last
token of the encoding up to there and how many tokens have come since.  A
transition on a byte is annotated with the change of the token count (it is
negative when a longer token takes the place of several), so a text's count is
the sum of its annotations.  A token may follow another only if no merge crosses
their border first, which follows from the ranks at which the tokens at the
border come to be and vanish.

Transitions are compiled when first needed and kept in a hash table of bounded
size per process (it is emptied when full); all lanes of a block advance
together, one byte a step.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a very long text or
piece is one lane and finished byte by byte; special strings of the vocabulary
inside a text count as one token each and split it, as the library does by
default; repeated rows and empty tables are ordinary; input columns whose names
clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stayline.llm import blocks, pretoken
from stayline.llm.vocab import broadcast_file, json_merges

LANE_BYTES = 256
MAX_STATES = 400_000
_INF = 1 << 40
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """Counts BPE tokens; states and transitions are compiled on demand."""

    def __init__(self, raw: bytes):
        self.vocab, self.merges, self.special = json_merges(raw)
        self.made = {a + b: (r, a, b) for (a, b), r in sorted(self.merges.items(), key=lambda x: -x[1])}
        self.prefixes = {t[:k] for t in self.vocab for k in range(1, len(t) + 1)}
        self._edges: dict[tuple[bytes, int], list] = {}
        self.reset()

    def reset(self) -> None:
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        root = (b"", (b"",), (0,))
        self.ids = {root: 0}
        self.states = [root]
        self.slow: dict[int, tuple[int, int]] = {}
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.size, self.shift = size, np.uint64(64 - size.bit_length() + 1)
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.delta = np.zeros(size, np.int16)

    # ------------------------------------------------------------ compiling
    def edges(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """Tokens that stand at a border of ``token`` while it is put together:
        (token, rank at which it is there, rank at which it is merged away)."""
        key = (token, side)
        out = self._edges.get(key)
        if out is None:
            out, t, dies = [], token, _INF
            while True:
                rank, a, b = self.made.get(t, (-1, b"", b""))
                out.append((t, rank, dies))
                if rank < 0:
                    break
                t, dies = (b, rank) if side else (a, rank)
            self._edges[key] = out
        return out

    def can_follow(self, a: bytes, b: bytes) -> bool:
        """Is [a, b] the encoding of a + b?  (The leftmost of equal ranks goes first.)"""
        known = self.fits.get((a, b))
        if known is None:
            known = True
            for x, born_x, dies_x in self.edges(a, 1):
                for y, born_y, dies_y in self.edges(b, 0):
                    r = self.merges.get((x, y))
                    if r is not None and r > born_x and r > born_y and r < dies_x and r <= dies_y:
                        known = False
                        break
                if not known:
                    break
            self.fits[a, b] = known
        return known

    def _step(self, state, byte: int):
        suffix, lasts, since = state
        x = suffix + bytes([byte])
        for o in range(len(x)):
            t = x[o:]
            if t in self.vocab and (not lasts[o] or self.can_follow(lasts[o], t)):
                break
        else:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        delta = 1 - since[o]
        o2 = 0
        while x[o2:] not in self.prefixes:
            o2 += 1
        return (x[o2:], (*lasts[o2:], t), (*[s + delta for s in since[o2:]], 0)), delta

    def compile(self, key: int) -> tuple[int, int]:
        got = self.slow.get(key)
        if got is None:
            state, delta = self._step(self.states[key >> 8], key & 255)
            to = self.ids.get(state)
            if to is None:
                to = self.ids[state] = len(self.states)
                self.states.append(state)
            got = self.slow[key] = (to, delta)
        return got

    def _insert(self, new: np.ndarray) -> None:
        got = [self.compile(k) for k in new.tolist()]
        if len(self.slow) * 2 > self.size:
            self._table(self.size * 2)
            new = np.fromiter(self.slow, np.int64, len(self.slow))
            got = list(self.slow.values())
        at = self._home(new)
        to = np.array([g[0] for g in got], np.int32)
        delta = np.array([g[1] for g in got], np.int16)
        left = np.arange(len(new))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = new[left[free]]  # of several the last one stays
            mine = self.keys[at[left]] == new[left]
            done = left[mine]
            self.next[at[done]], self.delta[at[done]] = to[done], delta[done]
            left = left[~mine]
            at[left] = (at[left] + 1) & (self.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the transitions ``state << 8 | byte``."""
        while True:
            at = self._home(keys)
            have = self.keys[at]
            miss = None
            open_ = np.flatnonzero(have != keys)
            while len(open_):
                empty = have[open_] < 0
                if empty.any():
                    part = keys[open_[empty]]
                    miss = part if miss is None else np.concatenate([miss, part])
                    open_ = open_[~empty]
                at[open_] = (at[open_] + 1) & (self.size - 1)
                have[open_] = self.keys[at[open_]]
                open_ = open_[have[open_] != keys[open_]]
            if miss is None:
                return at
            self._insert(np.unique(miss))

    # ------------------------------------------------------------ running
    def annotate(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Annotation of every byte; ``begins``: positions where pieces begin."""
        if len(self.states) > MAX_STATES:
            self.reset()
        out = np.zeros(len(data), np.int16)
        if not len(data):
            return out
        at_begin = np.zeros(len(data), bool)
        at_begin[begins] = True
        # lanes: runs of whole pieces of about LANE_BYTES
        pick = np.searchsorted(begins, np.arange(0, len(data), LANE_BYTES))
        lane = np.unique(begins[pick[pick < len(begins)]])
        stop = np.append(lane[1:], len(data))
        order = np.argsort(lane - stop, kind="stable")
        lane, length = lane[order], (stop - lane)[order]
        running = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # lanes longer than t
        state = np.zeros(len(lane), np.int64)
        t = 0
        while t < len(running) and (m := int(running[t])) >= 16:
            pos = lane[:m] + t
            key = np.where(at_begin[pos], 0, state[:m]) << 8 | data[pos]
            slot = self.follow(key)
            state[:m] = self.next[slot]
            out[pos] = self.delta[slot]
            t += 1
        for k in range(int(running[t]) if t < len(running) else 0):  # few long lanes are left
            q = int(state[k])
            for p in range(int(lane[k]) + t, int(lane[k] + length[k])):
                q, out[p] = self.compile((0 if at_begin[p] else q) << 8 | int(data[p]))
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        own, parts, extra = np.arange(len(texts)), texts, np.zeros(len(texts), np.int64)
        for s in self.special:
            if any(s in x for x in parts):
                cut = [x.split(s) for x in parts]
                n = np.array([len(c) for c in cut], np.int64)
                extra += np.bincount(own, weights=n - 1, minlength=len(texts)).astype(np.int64)
                own, parts = np.repeat(own, n), [y for c in cut for y in c]
        lo, hi, part_of = pretoken.pieces(parts)
        data = np.frombuffer("".join(parts).encode(), np.uint8)
        total = np.concatenate([[0], np.cumsum(self.annotate(data, lo), dtype=np.int64)])
        n = total[hi] - total[lo]
        return extra + np.bincount(own[part_of], weights=n, minlength=len(texts)).astype(np.int64)


_READY: dict[int, Transducer] = {}


def transducer(raw: bytes) -> Transducer:
    """The transducer of a tokenizer file, kept for the life of a process."""
    key = hash(raw)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Transducer(raw)
    return _READY[key]


def count_tokens(df: DataFrame, text: str, tokenizer_file: str) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8) and ``n_tokens`` of ``text``; no shuffle."""
    shipped = broadcast_file(df.sparkSession, tokenizer_file)
    added = ["n_bytes", "n_tokens"]
    keep = [f for f in df.schema.fields if f.name not in added]
    take = list(dict.fromkeys([f.name for f in keep] + [text]))
    schema = T.StructType(keep + [T.StructField(n, T.LongType()) for n in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr = transducer(shipped.value)
        for batch in batches:
            column = batch.column(take.index(text))
            for i, j in blocks.row_blocks(column, 1 << 22):
                part = batch.slice(i, j - i)
                texts = [x or "" for x in column.slice(i, j - i).to_pylist()]
                _, offsets = blocks.flat_utf8(column.slice(i, j - i))
                cols = [part.column(k) for k, n in enumerate(take) if n not in added]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(np.diff(offsets), pa.int64()), pa.array(tr.count(texts), pa.int64())],
                    names=[f.name for f in schema.fields])
        blocks.release()

    return df.select(*[df[f"`{n}`"] for n in take]).mapInArrow(run, schema)
