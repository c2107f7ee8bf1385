"""Operator 9: personal data by surrogate generation.  [native]

Detected entities (e-mail addresses, phone numbers, IP addresses, card numbers,
social security numbers, IBANs, secrets, names after a title) are replaced by keyed
surrogates of the same type and format: digits stay digits, letters keep case and
script, punctuation stays, IPv4 octets stay octets, a card number that passes the
Luhn check and an IBAN that passes modulo 97 pass it again, a name keeps the gender
of its title (a neutral title takes that of another title of the name in the row).

1. Mentions are found with one pattern; texts without any are left as they are
   and never shuffled.
2. A mention's canonical form (no case, for numbers no punctuation) names its
   entity, so all mentions of an entity get one surrogate (coreference), each in
   its own format.  Names go word by word: `Mr John Smith` and `Mr Smith` keep their
   surname in common, and words of a name found with a title are replaced wherever
   they stand in the row.
3. Surrogates come from a keyed digest of (type, entity, attempt).  Collision
   check: of the entities of a type with one surrogate the smallest keeps it, and
   none may equal an entity that occurs; the others try again, round by round,
   until all are distinct.  If a format's space is used up (``ATTEMPTS`` rounds)
   the surrogate is lengthened by digest digits.
4. The text is cut at its mentions and put together with the surrogates, so a
   surrogate never falls into another mention.

Scale: mentions are extracted once and written with their row; a mention that a
third of all texts hold is reduced to one row before the shuffle; the dictionary is
joined by mention (skewed keys are split); only texts with a mention are shuffled.

Edge cases: a null or empty text stays; repeated rows get equal results; very
long texts are scanned whole; the same entity in any row, of any format, gets
the same surrogate; extra columns pass through, also with clashing names (the
text column alone is replaced); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm import blocks
from stayline.session import cut_lineage

ATTEMPTS = 40

# Titles and the gender they carry (fixed values).
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sir", "г-н", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "г-жа", "госпожа"]
NEUTRAL = ["Dr", "Prof", "Doctor", "Professor", "Docteur", "Doktor", "Профессор", "Доктор"]
# Syllables of surrogate names by script (fixed values).
LATIN = ["al", "ber", "car", "den", "el", "far", "gar", "hol", "im", "jor", "kel", "lan", "mor", "nor", "os", "per"]
CYRILLIC = ["ан", "бор", "вал", "гор", "дар", "ев", "жен", "зор", "ил", "кар", "лев", "мир", "нат", "ол", "пет", "ром"]

EMAIL = r"[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,24}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
_GROUP = r"[0-9A-Fa-f]{1,4}"  # of IPv6; a short form needs a digit, so that no name like Add::face is one
IPV6 = (rf"(?:{_GROUP}:){{7}}{_GROUP}(?![\p{{L}}\p{{N}}:])"
        rf"|(?=[0-9A-Fa-f:]*[0-9]){_GROUP}(?::{_GROUP}){{0,5}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?(?![\p{{L}}\p{{N}}:])")
CARD = r"[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9])|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5}(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
PHONE = (r"(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])"
         r"|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])"
         r"|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])"
         r"|0[1-9](?:[ .\-][0-9]{2}){4}(?![0-9])"  # 01 23 45 67 89
         r"|0[1-9][0-9]{1,3}[ /\-][0-9]{3,4}[ \-][0-9]{3,4}(?![0-9])"  # 020 7946 0958
         r"|0[1-9][0-9]{1,3}[ /\-][0-9]{5,8}(?![0-9])"  # 030 1234567
         r"|[6-9][0-9]{2}(?: [0-9]{2}){3}(?![0-9])"  # 612 34 56 78
         r"|[2-9][0-9]{2}-[0-9]{4}(?![0-9\-])")  # 555-0199
SECRET = r"(?:sk|pk|ghp|xox[abp])[_\-][A-Za-z0-9_\-]{16,}+|AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|[0-9a-fA-F]{32,128}+(?![0-9A-Za-z])"
_TITLE = r"(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.?"
NAME = _TITLE + rf"(?: {_TITLE})* (?!{_TITLE} )\p{{Lu}}[\p{{L}}'\-]+(?: (?!{_TITLE} )\p{{Lu}}[\p{{L}}'\-]+)?"
TYPES = [("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ip", IPV4), ("ip6", IPV6), ("card", CARD), ("ssn", SSN),
         ("phone", PHONE), ("name", NAME)]
ANY = r"(?<![\p{L}\p{N}_.])(?:" + "|".join(p for _, p in TYPES) + ")"
#: Every mention has one of these, which rules most texts' words out at once.
HINT = r"[0-9@]|AKIA|(?:sk|pk|ghp|xox[abp])[_\-]|(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? \p{Lu}"
#: Between a letter and something else: the words of a text and what is between them.
EDGE = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"


def type_of(mention: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(TYPES[:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def title_of(mention: Column) -> Column:
    return F.regexp_extract(mention, f"^(?:{_TITLE} )+", 0)


def words_of(mention: Column) -> Column:
    """The words of a name without its titles."""
    return F.split(F.regexp_replace(mention, f"^(?:{_TITLE} )+", ""), " ")


def canonical(kind: Column, word: Column) -> Column:
    """The entity's form: of numbers the letters and digits alone; all without case."""
    bare = F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))
    return F.when(kind.isin("name", "email", "ip", "ip6", "secret"), F.lower(word)).otherwise(bare)


def gender_of(mention: Column) -> Column:
    """m, f or n by the titles of a name."""
    titles = F.split(F.regexp_replace(title_of(mention), r"\.", ""), " ")
    return (F.when(F.arrays_overlap(titles, F.array(*map(F.lit, FEMALE))), "f")
            .when(F.arrays_overlap(titles, F.array(*map(F.lit, MALE))), "m").otherwise("n"))


# ---------------------------------------------------------------- surrogates
def _digest(key: str, *parts: Column) -> Column:
    """192 hex digits of a keyed digest."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(n)), *parts), 256) for n in range(3)])


def _draw(digest: Column, i: Column, below: int) -> Column:
    """A number below ``below`` from the i-th place of the digest."""
    piece = F.substring(digest, F.pmod(i * 4, F.lit(188)) + 1, F.lit(4))
    return F.pmod(F.conv(piece, 16, 10).cast("int"), F.lit(below))


def _char(c: Column, i: Column, digest: Column, hexa: Column) -> Column:
    """A character of the same sort; of a hexadecimal form a to f stay among them."""
    letters, cyr = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("абвгдежзиклмнопрстуфхцчшэюя")
    lead = (c != "0") & (i == 0)
    digit = F.when(lead, _draw(digest, i, 9) + 1).otherwise(_draw(digest, i, 10)).cast("string")
    return (F.when(c.rlike("^[0-9]$"), digit)
            .when(c.rlike("^[\\p{IsCyrillic}]$"), F.substring(cyr, _draw(digest, i, 27) + 1, F.lit(1)))
            .when(hexa & c.rlike("^[a-f]$"), F.substring(letters, _draw(digest, i, 6) + 1, F.lit(1)))
            .when(c.rlike("^\\p{L}$"), F.substring(letters, _draw(digest, i, 26) + 1, F.lit(1))).otherwise(c))


def _ip(entity: Column, digest: Column) -> Column:
    parts = F.split(entity, r"\.")
    return F.array_join(F.transform(parts, lambda p, i: F.when(
        F.length(p) == 3, F.lit(100) + _draw(digest, i, 156)).when(
        F.length(p) == 2, F.lit(10) + _draw(digest, i, 90)).otherwise(_draw(digest, i, 10)).cast("string")), ".")


def _luhn(number: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    twice = lambda c: c.try_cast("int") * 2
    value = F.transform(F.reverse(F.split(number, "")), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
        twice(c) - F.when(twice(c) > 9, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10


def _mod97(number: Column) -> Column:
    """Remainder of an IBAN, its first four characters moved to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(F.upper(turned), ""), F.lit(0), lambda a, c: F.pmod(
        F.when(c.rlike("^[0-9]$"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def _name(entity: Column, gender: Column, digest: Column) -> Column:
    """A word of a name."""
    cyrillic = entity.rlike("\\p{IsCyrillic}")

    def pick(k):
        at = _draw(digest, F.lit(k), 16) + 1
        return F.when(cyrillic, F.element_at(F.array(*map(F.lit, CYRILLIC)), at)).otherwise(
            F.element_at(F.array(*map(F.lit, LATIN)), at))

    end = F.when(cyrillic, F.when(gender == "f", "ова").when(gender == "m", "ов").otherwise("ко")).otherwise(
        F.when(gender == "f", "a").when(gender == "m", "o").otherwise("e"))
    return F.concat(pick(0), pick(1), pick(2), end)


def with_surrogate(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate`` to kind, entity, gender, attempt.  Step by step, so that
    no expression is written into another more than once."""
    kind, entity, d, made = (F.col(c) for c in ("kind", "entity", "d", "made"))
    x = rows.withColumn("d", _digest(key, kind, entity, F.col("gender"), F.col("attempt").cast("string")))
    x = x.withColumn("hexa", kind.isin("secret", "ip6")).withColumn("kept", F.when(  # first and last character that change
        kind == "card", F.array(F.lit(1), F.length(entity))).when(kind == "iban", F.array(F.lit(2), F.length(entity))).when(
        kind == "email", F.array(F.lit(0), F.length(entity) - F.length(F.substring_index(entity, ".", -1)))).otherwise(
        F.array(F.lit(0), F.length(entity))))
    formatted = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(
        (i < F.col("kept")[0]) | (i >= F.col("kept")[1]), c).otherwise(_char(c, i, d, F.col("hexa")))), "")
    x = x.withColumn("made", F.when(kind == "ip", _ip(entity, d)).when(
        kind == "name", _name(entity, F.col("gender"), d)).otherwise(formatted))
    # check digits: right where they were right, wrong where they were wrong
    body = F.when(kind == "card", F.substring(made, F.lit(1), F.length(made) - 1)).when(
        kind == "iban", F.substring(made, F.lit(5), F.length(made)))
    x = x.withColumn("body", body)
    x = x.withColumn("sum", F.when(kind == "card", F.pmod(F.lit(10) - _luhn(F.concat("body", F.lit("0"))), F.lit(10))).when(
        kind == "iban", F.lit(98) - _mod97(F.concat(F.substring(made, F.lit(1), F.lit(2)), F.lit("00"), "body"))))
    x = x.withColumn("valid", F.when(kind == "card", _luhn(entity) == 0).when(kind == "iban", _mod97(entity) == 1))
    off = F.when(kind == "card", F.pmod(F.col("sum") + 1 + _draw(d, F.lit(40), 9), F.lit(10))).otherwise(
        F.pmod(F.col("sum") + _draw(d, F.lit(40), 90), F.lit(96)) + 2)
    x = x.withColumn("check", F.when(F.col("valid"), F.col("sum")).otherwise(off))
    # an IBAN's wrong digits may not be the right ones by chance
    x = x.withColumn("check", F.when((kind == "iban") & ~F.col("valid") & (F.col("check") == F.col("sum")),
                                     F.pmod(F.col("check"), F.lit(97)) + 1).otherwise(F.col("check")))
    x = x.withColumn("made", F.when(kind == "card", F.concat("body", F.col("check").cast("string"))).when(
        kind == "iban", F.concat(F.substring(made, F.lit(1), F.lit(2)), F.lpad(F.col("check").cast("string"), 2, "0"), "body"))
        .otherwise(made))
    return x.withColumn("surrogate", F.when(F.col("attempt") < ATTEMPTS, made).otherwise(F.concat(
        made, F.substring(d, 1, 12)))).select(*rows.columns, "surrogate")


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, gender, surrogate: distinct within a kind and unlike every
    entity of that kind.  ``entities``: kind, entity, gender, distinct."""
    own = entities.select("kind", F.col("entity").alias("surrogate")).distinct()
    now = cut_lineage(entities.select("kind", "entity", "gender", F.lit(0).alias("attempt"),
                                      F.lit(False).alias("settled")))
    while True:
        made = with_surrogate(now, key)
        first = Window.partitionBy("kind", "surrogate").orderBy(F.col("settled").desc(), "entity", "gender")
        made = made.withColumn("n", F.row_number().over(first))
        made = made.join(own.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left")
        ok = (F.col("n") == 1) & F.col("real").isNull()
        made = cut_lineage(made.select("kind", "entity", "gender", "attempt", "surrogate", ok.alias("settled")))
        if made.where(~F.col("settled")).isEmpty():
            return made.select("kind", "entity", "gender", "surrogate")
        now = made.select("kind", "entity", "gender", (F.col("attempt") + F.when(F.col("settled"), 0).otherwise(1))
                          .alias("attempt"), "settled")


def _cased(mention: Column, made: Column) -> Column:
    """``made`` (lower case, one character for each of the mention's letters and
    digits, or for each of its characters) in the mention's format."""
    chars = F.split(mention, "")
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))
    bare = F.regexp_replace(made, r"[^\p{L}\p{N}]", "")

    def step(acc, c):
        solid = c.rlike("^[\\p{L}\\p{N}]$")
        x = F.substring(bare, acc["i"] + 1, F.lit(1))
        x = F.when(c.rlike("^\\p{Lu}$"), F.upper(x)).otherwise(x)
        return F.struct((acc["i"] + solid.cast("int")).alias("i"),
                        F.concat(acc["s"], F.when(solid, x).otherwise(c)).alias("s"))

    # digits that lengthen the surrogate follow at the end
    return F.aggregate(chars, start, step, lambda acc: F.concat(
        acc["s"], F.substring(bare, acc["i"] + 1, F.length(bare))))


def _written(kind: Column, word: Column, made: Column) -> Column:
    """The surrogate in the format of the word that it replaces."""
    name = F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(made)).otherwise(F.initcap(made))
    return F.when(kind == "name", name).otherwise(_cased(word, made))


# ---------------------------------------------------------------- operator
def mentions(text: Column) -> Column:
    """All mentions of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def described(each: DataFrame, row: str) -> DataFrame:
    """Rows (row, mention) with kind and gender; a name under a neutral title takes
    the gender that another mention of its last word has in the row."""
    x = each.withColumn("kind", type_of(F.col("mention")))
    x = x.withColumn("gender", F.when(F.col("kind") == "name", gender_of(F.col("mention"))).otherwise(""))
    x = cut_lineage(x.withColumn("last", F.when(F.col("kind") == "name", F.element_at(words_of(F.col("mention")), -1))))
    known = x.where("gender IN ('m', 'f')").groupBy(row, "last").agg(F.min("gender").alias("other"))
    neutral = x.where("gender = 'n'").join(known, [row, "last"], "left").withColumn("gender", F.coalesce("other", "gender"))
    out = [row, "mention", "kind", "gender"]
    return x.where("gender <> 'n'").select(*out).unionByName(neutral.select(*out))


def replacements(seen: DataFrame, key: str) -> DataFrame:
    """mention, kind, gender (distinct rows) with ``replacement`` and ``words``
    (word, written surrogate of each word of a name)."""
    part = seen.select("mention", "kind", "gender", F.posexplode(
        F.when(F.col("kind") == "name", words_of(F.col("mention"))).otherwise(F.array("mention"))).alias("pos", "word"))
    part = cut_lineage(part.withColumn("entity", canonical(F.col("kind"), F.col("word"))))
    made = dictionary(part.select("kind", "entity", "gender").distinct(), key)
    part = part.join(made, ["kind", "entity", "gender"]).withColumn("new", _written(F.col("kind"), F.col("word"), F.col("surrogate")))
    out = part.groupBy("mention", "kind", "gender").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "new"))).alias("w"))
    title = F.when(F.col("kind") == "name", title_of(F.col("mention"))).otherwise("")
    words = F.when(F.col("kind") == "name", F.transform("w", lambda x: F.struct(x.word.alias("word"), x.new.alias("new"))))
    return out.select("mention", "kind", "gender", F.concat(title, F.array_join(F.col("w.new"), " ")).alias("replacement"),
                      words.alias("words"))


def replace_pii(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced, and ``n_replaced``.  ``key`` makes
    the surrogates; whoever has it can test guesses, so it is kept secret."""
    keep = [c for c in docs.columns if c != "n_replaced"]
    row, found, table, names, parts = (blocks.free_name(n, [*docs.columns, "mention", "kind", "gender", "last", "other"])
                                       for n in ("row", "found", "table", "names", "parts"))
    col, m = F.col(f"`{text}`"), F.col(found)
    marked = docs.select(*[F.col(f"`{c}`") for c in keep])
    has = F.coalesce(col.rlike(HINT) & col.rlike(ANY), F.lit(False))
    plain = marked.where(~has).withColumn("n_replaced", F.lit(0).cast("bigint"))
    # rows with a mention are written with their mentions; each gets an own number
    some = cut_lineage(marked.where(has).withColumn(found, mentions(col)).withColumn(row, F.monotonically_increasing_id()))
    each = cut_lineage(described(some.select(row, F.explode(F.array_distinct(m)).alias("mention")), row))
    made = cut_lineage(replacements(each.select("mention", "kind", "gender").distinct(), key))
    named = each.join(made, ["mention", "kind", "gender"])
    maps = named.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias(table))
    # a word that two people of a row share stands for the first of them
    words = named.where("kind = 'name'").select(row, F.explode("words").alias("w")).groupBy(row, "w.word").agg(F.min("w.new").alias("new"))
    words = words.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("word", "new"))).alias(names))
    both = some.join(maps, row).join(words, row, "left")
    known = F.col(names)
    # what stands between the mentions, in words; those of found names are replaced too
    both = both.withColumn(parts, F.transform(F.split(col, ANY, -1), lambda p: F.when(
        known.isNotNull(), F.split(p, EDGE, -1)).otherwise(F.array(p))))
    between = F.transform(F.col(parts), lambda p: F.array_join(F.transform(p, lambda w: F.coalesce(known[w], w)), ""))
    again = F.aggregate(F.col(parts), F.lit(0).cast("bigint"), lambda a, p: a + F.when(known.isNotNull(), F.size(
        F.filter(p, lambda w: known[w].isNotNull()))).otherwise(0))
    both = both.withColumn("n_replaced", F.size(m).cast("bigint") + again).withColumn(parts, between)
    woven = F.array_join(F.transform(m, lambda x, i: F.concat(F.get(F.col(parts), i), F.coalesce(F.col(table)[x], x))), "")
    both = both.withColumn(text, F.concat(woven, F.element_at(F.col(parts), -1)))
    return plain.unionByName(both.select(*[F.col(f"`{c}`") for c in keep], "n_replaced"))
