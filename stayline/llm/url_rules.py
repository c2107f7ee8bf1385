"""Operator 3: URL filters by given rules and mined association rules.  [native]

Given rules (host, path, verdict) come first: a rule fits its host and all
subdomains if the url's path starts with the rule's path; the longest fitting
rule decides.  Every other url is judged by association rules: Spark's FP-growth
mines combinations of URL tokens that go with bad labels.  A rule
{tokens} -> bad is kept if it holds for ``least`` bad urls - the same count at any
table size -, its confidence reaches both ``confidence`` and the middle between
the bad share and 1 (a bound that any bad share leaves reachable), and no subset
of its tokens is already kept with as high a confidence.  Tokens on fewer bad
urls are dropped before the search; a token that is never on a good url is a rule
by itself, cannot be improved by others, and is left out of the combinations.  Tokens
on exactly the same labelled urls (the host, its labels, its words) are one item for
the search - their combinations have equal counts, and would multiply the itemsets by
powers of two -, and any of them stands for it in a url: the result is that of a search
of all.  Rules are found through an inverted index: each is filed under the tokens of
its rarest item, a url looks its own tokens up there and the whole antecedent is then
verified.

The number of rules is measured: they are broadcast when at most ``SMALL`` rows,
otherwise joined by token.

Labels: a page is labelled through the document its path names (its last
number); bad is quality 0 or toxic 1.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
token and verdict ``allow``; repeated urls and rows are judged each; without
labels nothing is mined and the rest is allowed; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL = 100_000
BAD = "label=bad"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host, its labels, words of the path, names of the query."""
    labels = F.transform(F.split(host, r"[.]"), lambda x: F.concat(F.lit("h:"), x))
    inside = F.transform(F.split(host, r"[.\-_]"), lambda x: F.concat(F.lit("w:"), x))
    parts = F.transform(F.split(F.translate(path, UPPER, LOWER), r"[/._\-]|[0-9]+"),
                        lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), r"&"),
                        lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    both = F.concat(F.array(F.concat(F.lit("host:"), host)), labels, inside, parts, query)
    return F.array_distinct(F.filter(both, lambda x: ~x.rlike(r"^(host|h|w|p|q):$")))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def mine(tokens: DataFrame, confidence: float, least: int) -> DataFrame:
    """Pruned rules (antecedent, options, confidence, support, lift) from rows
    (tokens array<string>, bad boolean).  A rule holds for at least ``least`` bad rows;
    ``options``: per item of the antecedent, the tokens that stand for it."""
    tokens = cut_lineage(tokens.withColumn("_row", F.monotonically_increasing_id()))
    n, n_bad = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0))).first()
    share = n_bad / max(n, 1)
    confidence = max(confidence, (1 + share) / 2)
    single = tokens.select("_row", "bad", F.explode("tokens").alias("t"))
    often = single.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("b"),
                                    F.bit_xor(F.xxhash64("_row")).alias("x"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("y"))
    often = cut_lineage(often.where(F.col("b") >= least))
    alone = often.where("b = n").select(F.array("t").alias("antecedent"), F.lit(1.0).alias("confidence"),
                                        (F.col("b") / F.lit(max(n, 1))).alias("support"),
                                        F.lit(1 / max(share, 1e-300)).alias("lift"))
    # tokens on the same rows are one item, named by the smallest
    mixed = often.where("b < n")
    item = mixed.groupBy("n", "b", "x", "y").agg(F.min("t").alias("item"), F.sort_array(F.collect_list("t")).alias("same"))
    item = cut_lineage(item.select("item", F.explode("same").alias("t"), "same"))
    # written baskets of the items that can still combine
    held = single.join(item.where("t = item").select("t"), "t").groupBy("_row", "bad").agg(F.collect_list("t").alias("items"))
    baskets = cut_lineage(held.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD)))
                                      .otherwise(F.col("items")).alias("items")))
    m = baskets.count()
    # FPGrowth counts up from ceil(minSupport * rows): half a row below, so that rounding loses none
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least - 0.5, 0.5) / max(m, 1)),
                     minConfidence=min(1.0, confidence) - 1e-9,
                     numPartitions=int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence",
                         (F.col("support") * (m / max(n, 1))).alias("support"),
                         (F.col("confidence") / F.lit(max(share, 1e-300))).alias("lift")).unionByName(alone)
    rules = cut_lineage(rules.withColumn("rule_id", F.md5(F.concat_ws("\n", "antecedent"))))
    rules = rules.join(_redundant(rules), "rule_id", "left_anti")
    # the tokens that stand for each item of the antecedent
    part = rules.select("rule_id", F.explode("antecedent").alias("item")).join(
        item.where("t = item").select("item", "same"), "item", "left")
    part = part.groupBy("rule_id").agg(F.collect_list(F.coalesce("same", F.array("item"))).alias("options"))
    return cut_lineage(rules.join(part, "rule_id"))


WIDE = 12  # items of an antecedent whose subsets are listed


def _redundant(rules: DataFrame) -> DataFrame:
    """rule_id of the rules that hold a shorter one as sure as themselves.  Subsets
    are met by their digest; rules of more than ``WIDE`` items through shared tokens."""
    size = F.size("antecedent")
    mask = F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(antecedent)) - 2")))
    subset = rules.where((size > 1) & (size <= WIDE)).select("rule_id", "confidence", "antecedent", mask.alias("mask"))
    subset = subset.select("rule_id", "confidence", F.md5(F.concat_ws("\n", F.expr(
        "filter(antecedent, (x, i) -> shiftright(mask, i) & 1 = 1)"))).alias("inner_id"))
    inner = rules.select(F.col("rule_id").alias("inner_id"), F.col("confidence").alias("ic"))
    worse = subset.join(inner, "inner_id").where("ic >= confidence").select("rule_id")
    own = rules.where(size > WIDE).select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("t"))
    short = rules.select(F.col("antecedent").alias("inner"), F.col("confidence").alias("ic"), F.col("antecedent")[0].alias("t"))
    wide = own.join(short, "t").where((F.size("inner") < size) & (F.col("ic") >= F.col("confidence"))
                                      & (F.size(F.array_except("inner", "antecedent")) == 0)).select("rule_id")
    return worse.unionByName(wide).distinct()


def match(urls: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """Highest confidence of a mined rule that fits, per ``key``; ``urls`` has
    ``tokens``.  Inverted index on the tokens of each rule's rarest item."""
    n_rules = rules.count()
    asked = urls.select(*key, "tokens", F.explode("tokens").alias("t"))
    small = (lambda d: F.broadcast(d)) if n_rules <= SMALL else (lambda d: d)
    item = rules.select("rule_id", F.posexplode("options").alias("i", "o")).select("rule_id", "i", F.explode("o").alias("t"))
    seen = asked.select("t").join(small(item.select("t").distinct()), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    often = item.join(seen, "t").groupBy("rule_id", "i").agg(F.sum("n").alias("n"))
    # an item that no url has cannot be met, nor can its rule
    rare = often.groupBy("rule_id").agg(F.min_by("i", F.struct("n", "i")).alias("i"), F.count(F.lit(1)).alias("k"))
    filed = rules.select("rule_id", "options", "confidence").join(rare, "rule_id").where("k = size(options)")
    filed = filed.select("options", "confidence", F.explode(F.col("options")[F.col("i")]).alias("t"))
    hits = asked.join(small(filed), "t").where(F.forall("options", lambda o: F.arrays_overlap(o, F.col("tokens"))))
    return hits.groupBy(*key).agg(F.max("confidence").alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], *, key: str = "page_id",
          url: str = "url", confidence: float = 0.6, least: int = 20) -> DataFrame:
    """page key, host, path, rule, verdict, mined (confidence of the best mined
    rule where no given rule fits, else null)."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict)
    # what one url gets, every copy of it gets: distinct urls are mined and matched
    urls = rows.where("host != ''").select("url", "host", "path", "rule").distinct()
    urls = urls.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    bad = labels.select(F.col("doc_id").cast("string").alias("named"),
                        ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("bad IS NOT NULL")
    bad = bad.groupBy("named").agg(F.max("bad").alias("bad"))
    named = urls.withColumn("named", F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1))
    mined = mine(named.join(bad, "named").select("tokens", "bad"), confidence, least)
    best = match(urls.where("rule IS NULL").select("url", "tokens"), mined, ["url"])
    # written first: a join of two plain exchanges splits a url that many rows share
    out = rows.join(cut_lineage(best), "url", "left")
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("given", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
                      .alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"))
