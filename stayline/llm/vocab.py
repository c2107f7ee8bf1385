"""Byte-level BPE vocabulary files, read on the driver and shipped as one
broadcast of fixed size (the file's bytes); tasks parse them once a process."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

from stayline.llm.ship import ship_code

#: GPT-2 style split: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)


def broadcast_file(spark: SparkSession, path: str):
    """The bytes of a vocabulary file as a broadcast variable."""
    ship_code(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point for the split pattern."""
    import regex
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for cls, pat in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pat, text):
            for lo, hi in _code_ranges(m.start(), m.end()):
                out[lo:hi] = cls
    out[32] = SPACE
    return out


def _code_ranges(lo: int, hi: int):
    gap = 0xE000 - 0xD800  # surrogates are not in the scanned text
    if lo < 0xD800:
        yield lo, min(hi, 0xD800)
    if hi > 0xD800:
        yield max(lo, 0xD800) + gap, hi + gap


def tiktoken_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from code point 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def json_merges(raw: bytes) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], list[str]]:
    """(vocabulary, merge ranks, strings of added tokens) of a tokenizer file."""
    j = json.loads(raw)
    back = byte_letters()

    def as_bytes(s: str) -> bytes:
        return bytes(back[c] for c in s)

    special = {t["content"] for t in j.get("added_tokens", [])}
    vocab = {as_bytes(k): v for k, v in j["model"]["vocab"].items() if k not in special}
    merges = {}
    for r, m in enumerate(j["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[as_bytes(a), as_bytes(b)] = r
    return vocab, merges, sorted(special, key=lambda s: (-len(s), s))
