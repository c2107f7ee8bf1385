"""Operators 2, 5, 8, 10: against the libraries, brute force and held-out labels."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stayline.llm import bpe_codec, catalog, lang_id, pretoken, quality, token_count
from stayline.llm.vocab import tiktoken_ranks

SF = "/root/testdata/sf0.001"
ODD = ["", "a", "aaaa", "a" * 3001, " " * 37 + "x", "x   ", "it's we'll 'sfoo''s !'s  's", "\n \t a\n\nb", "漢字 é 😀!?",
       "-" * 301, "=" * 77 + " " * 200, "tail \x1c\x85  z"]


def _texts(n=400, seed=3):
    rng = random.Random(seed)
    pick = list(" \n\t'stmdrevlla A9é　ß漢😀!?_\x1c\x85")
    out = ODD + ["".join(rng.choices(pick, k=rng.randint(0, 60))) for _ in range(n)]
    return out + ["".join(rng.choices("ethian ", k=80)) for _ in range(50)]


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe_codec.Codec(f.read())


def _library(codec):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_codec_equals_library(codec):
    texts, lib = _texts(), _library(codec)
    ids, n = codec.encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == lib.encode_ordinary(t), repr(t)
    assert codec.decode(ids).tobytes() == "".join(texts).encode()
    assert codec.encode([]) [0].tolist() == []


def test_codec_rows(spark, docs, codec):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_codec.encode_decode(docs, "text", path, with_digests=True)
    assert out.columns.count("n_tokens") == 1  # the clashing column is replaced
    lib = _library(codec)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = lib.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe_codec.encode_decode(docs.limit(0), "text", path).count() == 0


def test_split_chunks_do_not_matter():
    import regex
    for t in _texts(200, 5):
        want = [m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)]
        code, ends = pretoken.code_points([t])
        got = np.flatnonzero(pretoken.piece_starts(code, ends)).tolist()
        assert got == [*want, len(t)], repr(t)


def test_token_counts_equal_library(spark, docs):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        tr = token_count.Transducer(f.read())
    texts = _texts() + ["x<|endoftext|>y z<|endoftext|>", "<|endoftext|>"]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert tr.count(texts).tolist() == want
    tr.reset()  # compiled again after the table was emptied
    assert tr.count(texts[::-1]).tolist() == want[::-1]
    for r in token_count.count_tokens(docs, "text", path).collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode())
    assert token_count.count_tokens(docs.limit(0), "text", path).count() == 0


def _phrases(sample: str, text: str) -> int:
    """Greedy longest matches, by substring search."""
    n = 0
    for p in range(0, len(text), lang_id.PIECE):
        rest = text[p:p + lang_id.PIECE]
        while rest:
            k = 1
            while k < len(rest) and rest[:k + 1] in sample:
                k += 1
            n, rest = n + 1, rest[k:]
    return n


def test_cross_parsing_equals_substring_search():
    rng = random.Random(1)
    samples = {l: "".join(rng.choices(a, k=1500)) for l, a in (("x", "abc de"), ("y", "abf de"))}
    parsers = [lang_id.Parser(l, lang_id.letters(s)) for l, s in samples.items()]
    texts = ["".join(rng.choices("abcdef g", k=rng.randint(1, 700))) for _ in range(40)] + ["", "!!", "zzz", "AbC, de"]
    got = lang_id.entropies(parsers, lang_id.Alphabet(parsers), texts)
    for t, row in zip(texts, got):
        sym = lang_id.letters(t)
        # the array form keeps one blank at the end of a text that ends in others
        low = "".join(c if c.isalpha() else " " for c in t.lower())
        plain = " ".join(low.split()) + (" " if low and low[-1] == " " and low.strip() else "")
        if low.startswith(" "):
            plain = plain.lstrip()
        for p, h in zip(parsers, row):
            if not sym:
                assert h == math.inf
                continue
            s = "".join(lang_id.letters(samples[p.lang]))
            assert h == pytest.approx(_phrases(s, plain) * math.log2(len(s)) / len(plain)), repr(t)


def test_language_rows(spark, docs):
    parsers = lang_id.fit(docs, "text", "lang", "doc_id")
    out = {r.doc_id: r for r in lang_id.predict(docs, "text", parsers).collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[5].lang_pred == "und"
    assert not out[4].accepted and out[4].score == 0.0
    assert out[8].lang_pred == "de" and 0 < out[8].score <= 1 and out[8].accepted
    none = lang_id.predict(docs, "text", []).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]
    assert lang_id.fit(docs.limit(0), "text", "lang", "doc_id") == []


def test_long_and_repeated_texts_are_learned_from(spark):
    """A language with long texts only, and one of copies and texts without letters."""
    rows = [(k, "123 " * 1500 + "долгая книга о большой реке " * 300, "ru") for k in range(3)]
    rows += [(10 + k, "the same line again", "en") for k in range(400)] + [(500 + k, "12 34 !!", "en") for k in range(400)]
    rows += [(1000 + k, f"quick brown foxes {'abcdefghij'[k]}", "en") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    parsers = {p.lang: p for p in lang_id.fit(docs, "text", "lang", "doc_id")}
    assert sorted(parsers) == ["en", "ru"]
    # ten distinct texts of 19 symbols and a blank, and one copy of the line
    assert parsers["en"].size == 11 * 20 and parsers["ru"].size <= lang_id.SAMPLE_CHARS + 1
    got = {r.doc_id: r for r in lang_id.predict(docs, "text", list(parsers.values())).collect()}
    assert got[0].lang_pred == "ru" and got[0].accepted


def test_language_held_out_accuracy(spark):
    out = catalog.op5_lang_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").where("lang IS NOT NULL")
    acc = out.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert acc > 0.98


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = catalog.op10_quality(spark, sf)
    got = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    rows = out.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (9, None), (None, 1)], "doc_id bigint, quality int")
    w = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, w).collect()}
    assert got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_ftrl_separates():
    a, b = np.array([1]), np.array([2])
    w = quality.ftrl([(a, np.array([4.0]), 1), (b, np.array([4.0]), 0)] * 50)
    assert w[1] > 0 > w[2]
    assert len(tiktoken_ranks(b"YQ== 0\nYg== 1\n")) == 2
