"""Queries of the numbered operators: thin callers with production parameters
over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import (bpe_codec, decontam, divergence, id_store, lang_id, near_dup, pii, quality, sharding, spelling,
                          token_count, topk, url_rules)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


ORACLE["op1_near_dup"] = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
     FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k + 1, k + 4), ' ') AS x
       FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 4, 0))) AS k FROM d WHERE len(w) > 0) AS u),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents
      UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_codec.encode_decode(docs, "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                  with_ids=False, with_digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


@query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of the text's bytes, by the table of the reflected polynomial.
_CRC_SQL = """
t AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
        lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) AS q(n)) AS z)"""

ORACLE["op4_sharding"] = f"""
WITH {_CRC_SQL},
b AS (SELECT doc_id, source, text, hex(encode(text)) AS hx FROM documents),
x AS (SELECT doc_id, source, CAST(coalesce(len(hx) // 2, 0) + 1 AS BIGINT) AS size,
             CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295,
               list_transform(range(len(hx) // 2), lambda i: CAST('0x' || hx[2 * i + 1:2 * i + 2] AS BIGINT))),
               lambda a, c: xor(a // 256, tab[xor(a % 256, c) + 1]))) END AS text_crc32 FROM b, t),
y AS (SELECT *, md5('shard-shuffle:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':'
                    || coalesce(CAST(text_crc32 AS VARCHAR), '')) AS h FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) AS r,
             count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM y),
g AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source NULLS FIRST, h,
                                   doc_id NULLS FIRST, size, text_crc32) - 1 AS g FROM k)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * 16 // total AS INTEGER) AS shard,
       CAST(g - ((g * 16 // total) * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM g
"""


@query
def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    parsers = lang_id.fit(lang_id.training_rows(docs), "text", "lang", "doc_id")
    out = lang_id.predict(docs.select("doc_id", "text"), "text", parsers)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


ORACLE["op6_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) AS r
WHERE rn <= 5
"""


@query
def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    return out.drop("th")


_WORDS_SQL = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
ORACLE["op7_decontam"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k + 1, k + 10), ' ') AS x, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS k FROM i WHERE len(w) > 0) AS e),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, w, unnest(generate_series(0, len(w) - 1)) AS p FROM d WHERE len(w) > 0),
cand AS (SELECT rid, p, n, array_to_string(list_slice(w, p + 1, p + n), ' ') AS x FROM pos, sizes WHERE p + n <= len(w)),
hit AS (SELECT DISTINCT c.rid, c.p, c.n, win.item_id FROM cand c JOIN win USING (n, x)),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM hit) AS c
        GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) AS u GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_count.count_tokens(docs, "text", public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


#: For the queries on test tables alone: a key that is known keeps nothing secret.
TEST_KEY = "corpus-2024"


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, "text", TEST_KEY).select("doc_id", "text", "n_replaced")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    out = quality.score(docs, weights)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), typo_every=97, min_length=5, min_count=3)


ORACLE["op11_spelling"] = f"""
WITH RECURSIVE {_CRC_SQL},
r AS (SELECT doc_id, translate(unnest(string_split_regex(coalesce(text, ''), '[^A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
u AS (SELECT w, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS hx, count(*) AS c
      FROM r WHERE length(w) >= 5 GROUP BY doc_id, w),
x AS (SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2),
             lambda i: CAST('0x' || hx[2 * i + 1:2 * i + 2] AS BIGINT))),
             lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1]))) AS h FROM u, t),
y AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM x),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM y WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
del AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS s
        FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS p FROM v) AS e),
near AS (SELECT a.word, b.word AS o, b.n FROM del a JOIN del b ON a.s = b.s AND a.p = b.p AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON a.s = b.word
         UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, first(o ORDER BY n DESC, o) AS o, max(n) AS bn FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * v.n THEN o END AS form,
             CASE WHEN bn >= 2 * v.n THEN bn END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at
          WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN ends USING (word)
"""


@query
def op12_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = id_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return id_store.documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


ORACLE["op13_divergence"] = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
           FROM documents),
o AS (SELECT lang, source, rid, unnest(w) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS cl FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
lv AS (SELECT lang, count(*) AS v, sum(cl) AS nl FROM keep GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o GROUP BY lang, source, term),
gt AS (SELECT g.lang, g.source, k.term, k.cl, coalesce(c.c, 0) AS c
       FROM g JOIN keep k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gn AS (SELECT lang, source, sum(c) AS n FROM gt GROUP BY lang, source),
s AS (SELECT gt.*, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (cl + 5)) // (nl + 5 * v)::HUGEINT AS q
      FROM gt JOIN gn USING (lang, source) JOIN lv USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
       FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) AS u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
