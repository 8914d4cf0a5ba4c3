"""One consistent form for text that looks the same.

``canonical_text`` rewrites texts so that two come out equal exactly when a reader
cannot tell them apart:

1. *Forms* of one character are unified: full-width forms, ligatures, accents
   composed or combining, kinds of space, kinds of hyphen of one length, small
   Roman numerals and the micro sign; characters without width are dropped,
   except the joiner inside an emoji sequence, which is visible.
2. *Repair*, script-aware: a token with letters of more than one script has its
   look-alikes substituted by those of its dominant script (the one with most
   letters that have no twin elsewhere, then with most letters), provided that the
   result stands in the corpus vocabulary; else the next script is tried, else the token
   stays. Tokens of one script are never touched. The vocabulary is every word
   that some text of the corpus has in one script.
3. *Classes.* What still looks the same (names no other text has, words that are
   look-alikes from end to end) is told by the skeleton of a text, in which every
   look-alike is its Latin twin. The texts of one skeleton take the form of one of
   them: the one free of other alphabets if there is any, else the one with the fewest
   mixed tokens, then the most frequent, then the least. So no token is ever given a spelling that the corpus doesn't have.

Kept apart, because a reader can tell them apart: raised and lowered digits,
different accents, dashes of other lengths, quotation marks, letter case, digits,
line breaks, numbers of spaces.

Defined results: null stays null, an empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import materialize

# Letters of other alphabets that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝѡӏҮүԌ", "ABESIJKMHOPCTYXaeopcyxsijhdqwwlYyG", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True))
ARMENIAN = dict(zip("օսոհցՕՍՏ", "ounhgOUS", strict=True))
# Characters that are a form of one or more others.
FORMS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
    "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅺ": "xi", "ⅻ": "xii",
    "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII",
    "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "µ": "μ",
    chr(0x2010): "-", chr(0x2011): "-", "ɑ": "a", "ɡ": "g",
}
# Without width. The two joiners matter inside emoji sequences only.
WIDTHLESS = "".join(
    chr(c)
    for span in (
        (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F),
        (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB),
    )
    for c in range(span[0], span[1] + 1)
)

TO_LATIN = {**CYRILLIC, **GREEK, **ARMENIAN}
_LATIN = str.maketrans(TO_LATIN)
TWINS = frozenset(TO_LATIN.values())
SCRIPTS = {"c": CYRILLIC, "g": GREEK, "a": ARMENIAN}
FROM_LATIN = {k: {v: f for f, v in reversed(list(m.items()))} for k, m in SCRIPTS.items()}


def _forms() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(a): b for a, b in FORMS.items()}
    for c in range(0xFF01, 0xFFEF):  # full-width and half-width forms
        wide = unicodedata.normalize("NFKC", chr(c))
        if wide != chr(c):
            table[c] = wide
    for c in range(0x80, 0x3001):
        if unicodedata.category(chr(c)) == "Zs":
            table[c] = " "
    for c in WIDTHLESS:
        table[ord(c)] = None
    return table


_TABLE = _forms()
_JOINER, _KEEP = chr(0x200D), chr(0xE000)  # the second stands for a visible joiner while the others are dropped
_EMOJI = f"[{chr(0x2600)}-{chr(0x27BF)}{chr(0x1F000)}-{chr(0x1FAFF)}]"
_JOINED = re.compile(f"({_EMOJI}[{chr(0xFE0F)}{chr(0x1F3FB)}-{chr(0x1F3FF)}]*){_JOINER}(?={_EMOJI})")
_TOKEN = re.compile(rf"[^\W\d_]+(?:[{chr(0x300)}-{chr(0x36F)}]+[^\W\d_]*)*")
_FOREIGN = re.compile(f"[{chr(0x370)}-{chr(0x58F)}{chr(0x1F00)}-{chr(0x1FFF)}]")


_OTHER = re.compile("[" + "".join(map(re.escape, map(chr, _TABLE))) + "]")


def unify_forms(text: str) -> str:
    """Step 1: one code point sequence for every form of the same characters."""
    if text.isascii():
        return text
    if _JOINER in text:
        text = _JOINED.sub(r"\1" + _KEEP, text)
    text = unicodedata.normalize("NFC", text)
    text, n = _OTHER.subn(lambda m: _TABLE[ord(m.group())] or "", text)
    if n:
        # dropping a character between a letter and its accent can make them compose
        text = unicodedata.normalize("NFC", text)
    return text.replace(_KEEP, _JOINER)


def _script(c: str) -> str:
    """l, c, g, a for a letter of Latin, Cyrillic, Greek or Armenian; else empty."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "l"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "g"
    if 0x400 <= o < 0x530:
        return "c"
    if 0x530 <= o < 0x590:
        return "a"
    return ""


def _base(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0]


def _distinctive(token: str) -> dict[str, int]:
    """Letters without a twin in another script, counted by script."""
    counts: dict[str, int] = {}
    for c in token:
        b = _base(c)
        if b not in TO_LATIN and b not in TWINS and (s := _script(b)):
            counts[s] = counts.get(s, 0) + 1
    return counts


@lru_cache(maxsize=1 << 16)
def _latin(token: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(_LATIN))


def skeleton(text: str) -> str:
    """A unified text with every look-alike as its Latin twin."""
    return _TOKEN.sub(lambda m: t if (t := m.group()).isascii() else _latin(t), text)


def _reading(token: str, script: str) -> str:
    """The token with its look-alikes in one script; those without a letter there stay Latin."""
    latin = _latin(token)
    if script == "l" or script not in SCRIPTS:
        return latin
    back = FROM_LATIN[script]
    return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in unicodedata.normalize("NFD", latin)))


def _scripts(token: str) -> dict[str, int]:
    """The letters of a token by script."""
    counts: dict[str, int] = {}
    for c in token:
        if x := _script(_base(c)):
            counts[x] = counts.get(x, 0) + 1
    return counts


@lru_cache(maxsize=1 << 16)
def token_readings(token: str) -> tuple[str, ...]:
    """The readings of a mixed-script token, that of its dominant script first; none for any other token."""
    if token.isascii():
        return ()
    letters = _scripts(token)
    if len(letters) < 2:
        return ()
    own = _distinctive(token)
    order = sorted(letters, key=lambda s: (-own.get(s, 0), -letters[s], "lcga".index(s)))
    return tuple(dict.fromkeys(_reading(token, s) for s in order))


def wanted_words(text: str) -> list[str]:
    """The words, in lower case, that the vocabulary is asked for before a unified text is repaired."""
    if not _FOREIGN.search(text):
        return []
    return sorted({r.lower() for t in set(_TOKEN.findall(text)) for r in token_readings(t)})


def repair_text(text: str, known: set[str] | frozenset[str]) -> str:
    """Step 2 on a unified text; ``known``: the wanted words that stand in the corpus vocabulary."""
    if not known or not _FOREIGN.search(text):
        return text
    return _TOKEN.sub(lambda m: next((r for r in token_readings(m.group()) if r.lower() in known), m.group()), text)


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text)


_KIND = T.StructType([
    T.StructField("look", T.BinaryType()),  # hash of the skeleton
    T.StructField("form", T.BinaryType()),  # hash of the unified text
    T.StructField("body", T.StringType()),  # the unified text if it has letters of another alphabet
    T.StructField("wanted", T.ArrayType(T.StringType())),
])


@F.pandas_udf(_KIND)
def _kind_udf(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        u = unify_forms(t)
        form = _digest(u)
        rows.append((_digest(skeleton(u)), form, u, wanted_words(u)) if _FOREIGN.search(u) else (form, form, None, []))
    return pd.DataFrame(rows, columns=_KIND.names)


@F.pandas_udf(T.StringType())
def unify_forms_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unify_forms(t))


@F.pandas_udf(T.StructType([T.StructField("unified", T.StringType()), T.StructField("form", T.BinaryType())]))
def _unified_udf(texts: pd.Series) -> pd.DataFrame:
    unified = [unify_forms(t) for t in texts]
    return pd.DataFrame({"unified": unified, "form": [_digest(u) for u in unified]})


_REPAIRED = T.StructType([T.StructField("repaired", T.StringType()), T.StructField("plain", T.StringType()), T.StructField("mixed", T.IntegerType())])


@F.pandas_udf(_REPAIRED)
def _repair_udf(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
    """The repaired text, its skeleton, and how many of its tokens are still of more than one script."""
    repaired = [repair_text(t, frozenset(k if k is not None else ())) for t, k in zip(texts, known, strict=True)]
    mixed = [sum(bool(token_readings(x)) for x in _TOKEN.findall(r)) for r in repaired]
    return pd.DataFrame({"repaired": repaired, "plain": [skeleton(r) for r in repaired], "mixed": mixed})


#: Letters of other alphabets, and two signs that become one.
_MAY_BE_FOREIGN = "[\\u0370-\\u058f\\u1f00-\\u1fff\\u00b5\\u2126]"
_ONE_SCRIPT = r"^(\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+|\p{IsArmenian}+)$"


def vocabulary(texts: DataFrame) -> DataFrame:
    """(token): every word, in lower case, that a row of ``texts`` (column text) has in letters of one script."""
    words = F.split(F.lower("text"), r"[^\p{L}\p{M}]+")
    return texts.select(F.explode(words).alias("token")).distinct().where(F.col("token").rlike(_ONE_SCRIPT))


def _doubtful_forms(texts: DataFrame) -> DataFrame:
    """(form, canonical) of the unified texts with letters of another alphabet."""
    kinds = texts.select(_kind_udf("text").alias("k")).select("k.*").groupBy("look", "form").agg(
        F.count("*").alias("n"), F.first("body").alias("body"), F.first("wanted").alias("wanted")
    )
    kinds = materialize(kinds)  # hashes, and the texts with other letters; read three times below
    doubtful = kinds.where("body is not null")
    asked = doubtful.select("form", F.explode("wanted").alias("token"))
    known = asked.select("token").distinct().join(vocabulary(texts), "token", "left_semi")
    found = asked.join(known, "token").groupBy("form").agg(F.collect_set("token").alias("known"))
    repaired = doubtful.join(found, "form", "left").select("look", "form", "n", _repair_udf("body", "known").alias("r"))
    repaired = materialize(repaired.select("look", "form", "n", "r.*"))  # texts with other letters only; read three times below
    # the form that a class takes: free of other alphabets, else with the fewest mixed tokens, the most frequent, the least
    free = kinds.where("body is null").select("look", F.lit(True).alias("free")).unionByName(
        repaired.where(~F.col("repaired").rlike(_MAY_BE_FOREIGN)).select("look", F.lit(True).alias("free"))
    ).distinct()
    each = repaired.groupBy("look", "repaired", "mixed").agg(F.sum("n").alias("n"))
    best = each.groupBy("look").agg(F.min_by("repaired", F.struct("mixed", (-F.col("n")).alias("n"), "repaired")).alias("best"))
    taken = repaired.join(free, "look", "left").join(best, "look", "left")
    return taken.select("form", F.when(F.col("free"), F.col("plain")).otherwise(F.col("best")).alias("canonical"))


def canonical_text(docs: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """``docs`` with the column ``out``: the consistent form of ``text``.

    Texts without a letter of another alphabet (nearly all) end after step 1, without a shuffle.
    The words that the others ask for are looked up in the vocabulary of the whole corpus with one
    shuffled semi-join on the word; nothing is broadcast.
    """
    forms = _doubtful_forms(docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")))
    forms = forms.select(F.col("form").alias("_lookalike_form"), F.col("canonical").alias("_lookalike_text"))
    other = F.coalesce(F.col(text).rlike(_MAY_BE_FOREIGN), F.lit(False))
    plain = docs.where(~other).withColumn(out, unify_forms_udf(F.col(text)))
    rest = docs.where(other).withColumn("_lookalike", _unified_udf(F.col(text)))
    rest = rest.join(forms, F.col("_lookalike.form") == F.col("_lookalike_form"), "left")
    rest = rest.withColumn(out, F.coalesce("_lookalike_text", "_lookalike.unified")).drop("_lookalike", "_lookalike_form", "_lookalike_text")
    return plain.unionByName(rest.select(*plain.columns))


COPIES = 10_000  # of one text, from which they are spread over several keys


def same_looking_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: texts that look the same and differ in a code point.

    Pairs are built between *different* texts of one canonical form (few), then
    spread over the documents that hold them, salted where a text has many copies;
    equal copies are never paired.
    """
    forms = canonical_text(docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
    keyed = forms.select(
        "doc_id", F.xxhash64("canonical").alias("c1"), F.md5("canonical").alias("c2"), F.sha2("text", 256).alias("raw")
    ).distinct()
    keyed = materialize(keyed)  # hashes only; every later use would else repair the texts again
    texts = keyed.select("c1", "c2", "raw").distinct()
    several = texts.groupBy("c1", "c2").count().where("count > 1").select("c1", "c2")
    members = keyed.join(several, ["c1", "c2"], "left_semi")
    copies = members.groupBy("c1", "c2", "raw").agg(F.ceil(F.count("*") / COPIES).alias("salts"))
    x, y = (copies.select("c1", "c2", F.col("raw").alias(f"raw_{s}"), F.col("salts").alias(f"salts_{s}")) for s in "ab")
    pairs = x.join(y, ["c1", "c2"]).where("raw_a < raw_b")
    for s in "ab":
        pairs = pairs.withColumn(f"salt_{s}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"salts_{s}") - 1)))
    holders = members.join(copies, ["c1", "c2", "raw"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    for s in "ab":
        pairs = pairs.join(holders.select("c1", "c2", F.col("raw").alias(f"raw_{s}"), F.col("salt").alias(f"salt_{s}"), F.col("doc_id").alias(s)), ["c1", "c2", f"raw_{s}", f"salt_{s}"])
    return pairs.where("a != b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()
