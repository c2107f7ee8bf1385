"""Operators 11, 12, 13 and word keys: against brute force and the library, with edge rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, compare
from stayline.llm import blocks, bpe_codec, divergence, id_store, near_dup, spelling

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- word keys
def _thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t[:n]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_regular_words_do_not_collide(n):
    a = _thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = bpe_codec.Codec(f.read())
    ids, counts = codec.encode([a, b])
    assert codec.decode(ids[:counts[0]]).tobytes().decode() == a and codec.decode(ids[counts[0]:]).tobytes().decode() == b
    sets = list(near_dup.shingle_sets(pa.array(["w x y " + a, "w x y " + b]), 4))
    assert not np.array_equal(*sets)


def test_words_of_one_key_are_told_apart(monkeypatch):
    real = blocks.word_keys
    monkeypatch.setattr(blocks, "word_keys", lambda d, s, e: np.where(e - s > 7, np.uint64(1 << 63), real(d, s, e)))
    text = " alphabetical zygomorphic alphabetical characteristically it zygomorphic"
    data = np.frombuffer(text.encode(), np.uint8)
    lo = np.array([m.start() for m in re.finditer(" ", text)])
    hi = np.append(lo[1:], len(data))
    first, of = bpe_codec.distinct_spans(data, lo, hi, blocks.word_keys(data, lo, hi))
    words = [text[a:b] for a, b in zip(lo, hi)]
    assert [words[first[k]] for k in of] == words and len(first) == 4


def test_long_words_have_keys_of_their_own():
    rng = random.Random(0)
    words = list({"".join(rng.choices("abé", k=rng.randint(1, 40))) for _ in range(2000)}) + ["x" * (blocks.BLOCK_BYTES + k) for k in (5, 6)]
    raw = [w.encode() for w in words]
    hi = np.cumsum([len(w) for w in raw])
    keys = blocks.word_keys(np.frombuffer(b"".join(raw), np.uint8), hi - [len(w) for w in raw], hi)
    assert len(set(keys.tolist())) == len(words)


# ---------------------------------------------------------------- 11
def _edits_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1:] == b[k + 1:]
    return a[k:] == b[k + 1:] if len(a) < len(b) else a[k + 1:] == b[k:]


def _variants(rows, every=97, least=5, times=3):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= times}
    near = {w: [v for v in n if _edits_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def _check_variants(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int").repartition(3)
    want = _variants([r[:2] for r in rows], **{k: v for k, v in options.items() if k == "every"})
    got = spelling.variants(docs, typo_every=options.get("every", 97), symbols=options.get("symbols", 8))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == want
    return want


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants_equal_brute_force(spark, symbols):
    rng = random.Random(symbols)
    base = ["".join(rng.choices("abcdeÀéÿ×", k=rng.randint(5, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 4, 8, 20, 60])
        for _ in range(6):
            k, v = rng.randrange(len(w)), rng.choice("abcé")
            words += [rng.choice([w[:k] + w[k + 1:], w[:k] + v + w[k:], w[:k] + v + w[k + 1:], w + v])] * rng.randint(1, 9)
    rng.shuffle(words)
    rows = [(i // 2 if i else None, " ".join(words[i::50]), "x", 1) for i in range(50)] * 2
    long = "q" * 30_000
    rows += [(77, f"{long} {long}s {long}", "", 0), (78, f"{long} {long}s {long}s", "", 0), (79, None, "", 0), (80, "", "", 0),
             (81, "1 2 3, _?", "", 0), (82, "ABCde-abcDEİabcde \U0001F600abcdÉ abcdé", "", 0)]
    want = _check_variants(spark, rows, every=7, symbols=symbols)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] not in (v[0], w) for w, v in want.items())


def test_chains_of_forms_end_at_their_root(spark):
    words = [("abcdefghij"[:k] + "z" * (10 - k), 3 * 2 ** k) for k in range(11)]  # each one letter from the next
    rows = [(1, " ".join(w for w, n in words for _ in range(n)), "", 0)]
    want = _check_variants(spark, rows, every=10**9)
    assert {v[1] for v in want.values()} == {"abcdefghij"}


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(docs).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "once upon times")], "doc_id bigint, text string")).count() == 0


def test_neighbourhood_is_whole():
    """Keys of all strings one edit away over the alphabet, and no others."""
    s = 3
    for word in ("0", "00", "0120", "2210012"):
        flat = np.array([int(c) for c in word])
        own, keys, _ = spelling.neighbourhood(flat, np.array([len(word)]), s)
        edits = {word} | {word[:i] + word[i + 1:] for i in range(len(word))}
        edits |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in "012"}
        edits |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "012"}
        want = set()
        for e in edits:
            want.add(int(spelling.own_keys(np.array([int(c) for c in e], np.int64), np.array([len(e)]))[0]))
        assert set(keys.tolist()) == want and len(keys) == len(want) and own[0] in want


# ---------------------------------------------------------------- 12
def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 1000, 20_000):
        keys = np.unique(rng.integers(-2**62, 2**62, n)) if n != 1000 else np.arange(1000)
        slots = id_store.slots_of(keys, id_store.perfect_hash(keys), len(keys))
        assert sorted(slots.tolist()) == list(range(len(keys)))
    assert len(id_store.perfect_hash(np.zeros(0, np.int64))) == 0


ID_ROWS = [(5, "Hello world, it's   me\n\n"), (-3, None), (9, ""), (2, "x<|endoftext|>y # ## 漢字 é 😀"), (5, "another text of id 5"),
           (5, "another text of id 5"), (None, "no id"), (2**62, "ab " * 5000), (7, "word " * 20_000), (8, "a" * 3000)]


@pytest.mark.parametrize("wide", [False, True])
def test_ids_are_written_and_read_back(spark, tmp_path, monkeypatch, wide):
    from tokenizers import Tokenizer
    if wide:
        monkeypatch.setattr(id_store, "_largest_id", lambda raw, end: 1 << 17)
    lib = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame([(k, t, 1, 1) for k, t in ID_ROWS], "doc_id bigint, text string, start int, shard int").repartition(4)
    folder = id_store.write(docs, JSON, f"file://{tmp_path}/ids", shard_bytes=4000)
    rows = sorted(id_store.documents(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert len(rows) == len(ID_ROWS) and len({r.shard for r in rows}) > 3
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))  # null keys first
    want, start = defaultdict(list), 0
    for k, t in ID_ROWS:
        want[k].append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.ids in want[r.doc_id]
        start += r.n_tokens
    assert sorted(map(tuple, (r.ids for r in rows))) == sorted(tuple(x) for v in want.values() for x in v)
    reader = id_store.Reader(folder, cached=2)
    for k in want:
        if k is not None:
            assert sorted(x.tolist() for x in reader.get(k)) == sorted(want[k])
    assert all(reader.get(k) == [] for k in (0, 6, -4, 2**62 + 1, 1))


def test_empty_id_store(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    folder = id_store.write(docs, JSON, f"{tmp_path}/none")
    assert id_store.documents(spark, folder).count() == 0 and id_store.Reader(folder).get(1) == []


def test_encoder_equals_library(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(id_store, "CACHED", 50)  # beyond it pieces are encoded again
    lib = Tokenizer.from_file(JSON)
    with open(JSON, "rb") as f:
        own = id_store.Encoder(f.read())
    rng = random.Random(2)
    pick = list(" \n\t'stmdrevlla A9é　ß漢😀!?_\x1c\x85")
    texts = ["".join(rng.choices(pick, k=rng.randint(0, 60))) for _ in range(400)] + ["<|endoftext|>", "a<|endoftext|> b", ""]
    for part in (texts, texts[:7], []):
        ids, counts = own(part)
        at = np.concatenate([[0], np.cumsum(counts)])
        for k, t in enumerate(part):
            assert ids[at[k]:at[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_id_query_equals_library(spark):
    from tokenizers import Tokenizer
    lib, start = Tokenizer.from_file(JSON), 0
    got = {r.doc_id: r for r in E.queries()["op12_id_store"](spark, SF).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for k, t in docs:
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


# ---------------------------------------------------------------- 13
def _audit(rows, least, top):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        g = (lang or "", source or "")
        groups.add(g)
        count[g].update(terms)
        seen[g[0]].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, d in seen[lang].items() if d >= least]
        v = len(kept)

        def share(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * v) for t in kept}

        p = share(count[lang, source])
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(count[g])
        q = share(whole)
        pairs = [(s, sum(abs(p[t] - x) for t, x in share(count[lang, s]).items())) for la, s in groups if la == lang and s != source]
        terms = [(t, p[t] - q[t]) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, x, f, k + 1) for k, (x, f) in enumerate(items[:most])]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{'abcdefgh'[k % 8] * (k // 8 + 1)}" for k in range(60)] + ["Ünder", "ünder", "漢字", "Z", "\U0001F600x"]
    rows = []
    for k in range(300):
        lang, source = rng.choice(["de", "en", None, "kurz"]), rng.choice(["s1", "s2", "Ä", None, "hot", "hot", "hot"])
        few = 2 if lang == "kurz" else rng.randint(0, 40)
        rows.append((" ".join(rng.choices(words[:10 if source == "hot" else 65], k=few)), lang, source))
    rows += [(None, "en", "silent"), ("", "alone", "one"), ("12 34", "alone", "two"), (rows[0][0], rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, rank int, item string")
    for least, top in ((8, 5), (2, 50)):
        got = divergence.audit(docs.repartition(5), least=least, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in got.collect()) == _audit(rows, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_ties_fill_the_ranks_in_byte_order(spark):
    """Many terms of one value: the cell is cut inside, in UTF-8 order."""
    terms = [f"t{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(" ".join(terms), "en", "one")] * 3 + [("other " * 200, "en", "two")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.audit(docs, least=1, top=50).where("part = 'term' AND source = 'one'").orderBy("rank").collect()
    assert [r.item for r in got] == sorted(terms)[:50] and [r["rank"] for r in got] == list(range(1, 51))


@pytest.mark.parametrize("name", ["op11_spelling", "op13_divergence"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(E.queries()[name](spark, SF).toPandas(), con.execute(E.oracle_sql()[name]).df()) == "OK"
