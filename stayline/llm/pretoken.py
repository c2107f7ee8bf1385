"""The split pattern of byte-level BPE as a finite-state transducer.

``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``

Input symbols are character classes with the pattern's look-ahead folded in
(is the next character white space; does a contraction follow an apostrophe).
The deterministic transducer has nine states; a transition emits 1 when the
character begins a new piece.  Text is cut into chunks of equal length; each
chunk gives a map from every entry state to its exit state, the maps are
composed by a parallel prefix scan (doubling), which yields the entry state of
every chunk, and the chunks then emit side by side.
"""

from __future__ import annotations

import numpy as np

from stayline.llm.vocab import LETTER, NUMBER, OTHER, SPACE, WHITE, char_classes

CHUNK = 128
# input symbols
S_LET, S_NUM, S_OTH, S_APOS2, S_APOS3, S_SPLAST, S_WLAST, S_WMID, S_EOT = range(9)
N_SYM = 9
# states: what the previous character was
Q_START, Q_LET, Q_NUM, Q_OTH, Q_JOIN, Q_WHITE, Q_C2, Q_C1, Q_DONE = range(9)
N_Q = 9


def _compile() -> tuple[np.ndarray, np.ndarray]:
    nxt = np.zeros((N_Q, N_SYM), np.uint8)
    emit = np.zeros((N_Q, N_SYM), np.uint8)
    same = {S_LET: Q_LET, S_NUM: Q_NUM, S_OTH: Q_OTH}
    for q in range(N_Q):
        for s, to in same.items():
            nxt[q, s], emit[q, s] = to, int(q not in (to, Q_JOIN))
        for s, to in ((S_APOS2, Q_C1), (S_APOS3, Q_C2)):
            inside = q in (Q_OTH, Q_JOIN)  # " ?[^\s\p{L}\p{N}]+" took the apostrophe
            nxt[q, s], emit[q, s] = (Q_OTH, int(q not in (Q_OTH, Q_JOIN))) if inside else (to, 1)
        # white space: a run of several gives up its last character to what follows
        nxt[q, S_SPLAST], emit[q, S_SPLAST] = Q_JOIN, 1
        nxt[q, S_WLAST], emit[q, S_WLAST] = Q_START, 1
        nxt[q, S_WMID], emit[q, S_WMID] = Q_WHITE, int(q != Q_WHITE)
        nxt[q, S_EOT], emit[q, S_EOT] = Q_START, 1
    for s in range(N_SYM):  # letters inside a contraction
        nxt[Q_C2, s], emit[Q_C2, s] = Q_C1, 0
        nxt[Q_C1, s], emit[Q_C1, s] = Q_DONE, 0
    return nxt, emit


NEXT, EMIT = _compile()


def symbols(code: np.ndarray, end_of_text: np.ndarray) -> np.ndarray:
    """Input symbols of a run of code points; ``end_of_text`` marks separators
    (one after every text)."""
    n = len(code)
    cls = char_classes()[code]
    sym = np.empty(n, np.uint8)
    sym[cls == LETTER] = S_LET
    sym[cls == NUMBER] = S_NUM
    sym[cls == OTHER] = S_OTH
    white = (cls == SPACE) | (cls == WHITE)
    solid = ~white & ~end_of_text
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = solid[1:]
    sym[white] = S_WMID
    sym[(cls == SPACE) & next_solid] = S_SPLAST
    sym[(cls == WHITE) & next_solid] = S_WLAST
    apos = np.flatnonzero(code == 39)
    if len(apos):
        pad = np.append(np.where(end_of_text, 0, code), [0, 0, 0]).astype(np.int64)
        c1, c2 = pad[apos + 1], pad[apos + 2]
        two = np.isin(c1, [ord(c) for c in "stmd"])
        three = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        sym[apos[two]] = S_APOS2
        sym[apos[three]] = S_APOS3
    sym[end_of_text] = S_EOT
    return sym


def _scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of chunk state maps [chunk, state]."""
    step = 1
    while step < len(maps):
        base = np.arange(step, len(maps), dtype=np.int32)[:, None] * np.int32(N_Q)
        maps = np.concatenate([maps[:step], maps.ravel().take(base + maps[:-step])])
        step *= 2
    return maps


def piece_starts(code: np.ndarray, end_of_text: np.ndarray) -> np.ndarray:
    """Boolean: does a piece (or a separator) begin at this character?"""
    n = len(code)
    if not n:
        return np.zeros(0, bool)
    lanes = -(-n // CHUNK)
    sym = np.full(lanes * CHUNK, S_EOT, np.uint8)
    sym[:n] = symbols(code, end_of_text)
    by_step = np.ascontiguousarray(sym.reshape(lanes, CHUNK).T)
    flat_next, flat_emit = NEXT.ravel(), EMIT.ravel()
    state = np.tile(np.arange(N_Q, dtype=np.uint8), (lanes, 1))
    for t in range(CHUNK):
        state = flat_next.take(state * np.uint8(N_SYM) + by_step[t][:, None])
    total = _scan(state)
    q = np.concatenate([[Q_START], total[:-1, Q_START]]).astype(np.uint8)
    out = np.empty((CHUNK, lanes), np.uint8)
    for t in range(CHUNK):
        key = q * np.uint8(N_SYM) + by_step[t]
        out[t] = flat_emit.take(key)
        q = flat_next.take(key)
    return np.ascontiguousarray(out.T).ravel()[:n].astype(bool)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a zero after each; and the separators' marks."""
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.zeros(len(code), bool)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends[np.cumsum(lengths + 1) - 1] = True
    return code, ends


def utf8_lengths(code: np.ndarray) -> np.ndarray:
    return (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000) + 1


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 byte spans of the pieces of the joined texts, and each piece's text."""
    code, ends = code_points(texts)
    at = np.flatnonzero(piece_starts(code, ends))
    if code.size and int(code.max()) < 0x80:
        sep_at = np.flatnonzero(ends)
        lo = at - np.searchsorted(sep_at, at, "left")
        total = len(code) - len(sep_at)
    else:
        width = utf8_lengths(code)
        width[ends] = 0
        byte_at = np.concatenate([[0], np.cumsum(width)])
        lo, total = byte_at[at], int(byte_at[-1])
    hi = np.append(lo[1:], total)
    sep = ends[at]
    text_of = np.cumsum(sep) - sep
    return lo[~sep], hi[~sep], text_of[~sep]
