"""One consistent form for text that looks the same.

Method: a longest-match transducer over grapheme clusters, compiled to one pattern, with a precomputed mapping. The
mapping joins, by rule from the Unicode data, width forms, kinds of blank, ligatures and presentation forms, ways to
write an accent or a syllable, and, from a fixed list, letters of another script with the same glyph. At each place the
pattern takes the longest of: a sequence of joined pictures, which stays as it is; the parts of a syllable; a character
with its combining marks, invisible characters between them skipped; a run of single characters that change. What it
takes is looked up as a whole; clusters that the precomputed mapping lacks are made by the same rules, once. Building
the mapping checks that no character has two targets and that every target maps to itself, so the form is stable.

`skeleton` is the form for comparisons: look-alikes become Latin wherever they stand. `canonical` is the form for
reading and training: the same, but words of a Cyrillic or Greek text get their script's letters back. It is computed
from the skeleton, so equal skeletons have equal canonical texts.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.operators import skew
from textloom.session import cut, ship

# Letters of other scripts that share their glyph with a Latin letter, and that Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԁԛԝӏү"
CYRILLIC_AS = "ABESIJKMHOPCTYXYQWaeopcyxsijhdqwly"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ"
GREEK_AS = "ABEZHIKMNOPTYXoj"
OTHER = "օոցɡ" + "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ" + "ꓮꓐꓚꓓꓰꓝꓖꓧꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"
OTHER_AS = "ongg" + "ABCDEGHJKLMPSTVWZ" + "ABCDEFGHJKLMNOPRSTUVWXYZ"
# Characters that show nothing.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e" + "".join(map(chr, (*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF)))
# Hyphens that differ from the ASCII one only in line breaking.
HYPHENS = "\u2010\u2011"
#: Compatibility tags of the Unicode data that name a width, a blank or a joined or positional form, not another sign.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Ranges in which `<compat>` names a ligature or a letter-like numeral.
LIGATURES = ((0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3), (0x0587, 0x0587), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB4F, 0xFB4F), (0x2F00, 0x2FD5))


def _same_look(c: str) -> str:
    """What `c` shows, by the rules; `c` itself if no rule has it."""
    if unicodedata.category(c) == "Zs":
        return " "
    tag, _, codes = unicodedata.decomposition(c).partition(" ")
    if tag in SAME_LOOK or tag == "<compat>" and any(a <= ord(c) <= b for a, b in LIGATURES):
        return "".join(chr(int(x, 16)) for x in codes.split())
    return c


@lru_cache(maxsize=1)
def mapping() -> dict[int, str]:
    """Code point -> canonical string of every character that changes, checked for conflicts."""
    fixed: dict[str, str] = dict.fromkeys(INVISIBLE, "")
    for letters, targets in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (OTHER, OTHER_AS), (HYPHENS, "--")):
        if len(letters) != len(targets):
            raise ValueError(f"{letters} and {targets} differ in length")
        for a, b in zip(letters, targets):
            if fixed.setdefault(a, b) != b:
                raise ValueError(f"two targets for {a!r}")
    fixed |= {chr(c): "" for r in (range(0xFE00, 0xFE10), range(0xE0100, 0xE01F0), range(0xE0000, 0xE0080)) for c in r}
    table: dict[int, str] = {}
    for code in (*range(0x80, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        c = chr(code)
        if c not in fixed and not unicodedata.decomposition(c) and unicodedata.category(c) != "Zs":
            continue
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x3400 <= code <= 0x9FFF:
            continue
        text, before = c, None
        while text != before:
            before = text
            text = unicodedata.normalize("NFC", "".join(fixed[x] if x in fixed else _same_look(x) for x in unicodedata.normalize("NFD", text)))
        if text != c:
            table[code] = text
    for code, text in table.items():
        if any(ord(x) in table for x in text):
            raise ValueError(f"the target of {chr(code)!r} is mapped itself")
    return table


_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x0300, 0x034E), (0x0350, 0x036F), (0x0483, 0x0487), (0x0591, 0x05BD), (0x05BF, 0x05BF), (0x05C1, 0x05C2), (0x05C4, 0x05C5), (0x064B, 0x065F), (0x0653, 0x0655), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE20, 0xFE2F), (0xFF9E, 0xFF9F)))
_UNSEEN = re.escape(INVISIBLE)
#: Pictures that a zero-width joiner joins to another picture.
_PICTURE = "[\U0001f300-\U0001faff\u2600-\u27bf\u2b00-\u2bff\u2190-\u21ff][\ufe0f\U0001f3fb-\U0001f3ff]*"
_PICTURES = f"{_PICTURE}(?:\u200d{_PICTURE})+"
_SYLLABLE = f"(?:[\u1100-\u1112][{_UNSEEN}]*[\u1161-\u1175]|[\uac00-\ud7a3])[{_UNSEEN}]*[\u11a8-\u11c2]|[\u1100-\u1112][{_UNSEEN}]*[\u1161-\u1175]"
_MARKED = f"[^{_MARKS}](?:[{_UNSEEN}]*[{_MARKS}])+"


@lru_cache(maxsize=1)
def transducer() -> re.Pattern:
    """The compiled pattern: longer keys before shorter ones, the single characters of the mapping last, in runs."""
    codes, ranges = sorted(mapping()), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    single = "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in ranges)
    # A run stops before a character that has marks of its own, or is joined to something: that is a longer key.
    return re.compile(f"{_PICTURES}|{_SYLLABLE}|{_MARKED}|(?:[{single}](?![{_UNSEEN}]*[{_MARKS}]))+", re.S)


_JOINED = re.compile(_PICTURES)


@lru_cache(maxsize=262144)
def _form(key: str) -> str:
    """The target of one key of the transducer."""
    if "\u200d" in key and _JOINED.fullmatch(key):
        return key.replace("\ufe0f", "")
    plain = key.translate(mapping())
    if len(key) == 1:
        return plain
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", key).translate(mapping())).translate(mapping())


def skeleton(text: str | None) -> str | None:
    """The comparison form of one text: null for null. Blanks at the end don't show and are dropped; the number of other blanks stays."""
    if text is None or text.isascii():
        return text and text.rstrip(" ")
    return transducer().sub(lambda m: _form(m.group()), text).rstrip(" ")


_WORD = re.compile(r"[^\W\d_]+")
_BACK = {"cyrillic": str.maketrans(CYRILLIC_AS[:15] + "aeopcyxsij", CYRILLIC[:15] + "аеорсухѕіј"), "greek": str.maketrans(GREEK_AS, GREEK)}
_LATIN_ALSO = {"cyrillic": set(CYRILLIC_AS), "greek": set(GREEK_AS)}


def _script(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ԯ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin" if c < "ɐ" else ""


def canonical(text: str | None) -> str | None:
    """The reading form of one text. A word with letters that only Cyrillic (Greek) has and no letter that only Latin has
    gets Cyrillic (Greek) letters back; so does a word of shared letters only in a text with more such words than Latin ones."""
    text = skeleton(text)
    if not text or text.isascii() or not any("Ͱ" <= c <= "ԯ" or "ἀ" <= c <= "῿" for c in text):
        return text
    seen: dict[str, set[str]] = {}
    votes = {"cyrillic": 0, "greek": 0, "latin": 0}
    for w in set(_WORD.findall(text)):
        scripts = {_script(c) for c in w if not c.isascii()} & {"cyrillic", "greek"}
        if len(scripts) == 1 and {c for c in w if _script(c) == "latin"} <= _LATIN_ALSO[s := next(iter(scripts))]:
            seen[w] = {s}
        else:
            seen[w] = {s for s in ("cyrillic", "greek") if not scripts and set(w) <= _LATIN_ALSO[s]} | {"latin"}
        if len(seen[w]) == 1:
            votes[next(iter(seen[w]))] += 1
    lead = max(votes, key=lambda s: (votes[s], s == "latin"))

    def render(m: re.Match) -> str:
        own = seen[m.group()]
        s = next(iter(own)) if len(own) == 1 else lead if lead in own else "latin"
        return m.group() if s == "latin" else m.group().translate(_BACK[s])

    return _WORD.sub(render, text)


def _skeletons(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


def _canonicals(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def skeleton_column(text: Column) -> Column:
    return F.pandas_udf(_skeletons, StringType())(text)


def canonical_column(text: Column) -> Column:
    return F.pandas_udf(_canonicals, StringType())(text)


#: Characters of different texts, or rows, up to which a table of them is broadcast.
BROADCAST_CHARS = 16_000_000


def _looking_alike(df: DataFrame, row_id: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """`__t, __f` of the different texts whose form several texts have; `__id, __t, __f` of their rows; whether the first is small.

    The first table is kept, so forms are made once.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(row_id).alias("__id"), F.col(text).alias("__t")).where(F.col("__t").isNotNull())
    texts = rows.select("__t").distinct().withColumn("__f", skeleton_column(F.col("__t"))).where(F.col("__f") != "")
    formed = cut(texts.select("__t", F.xxhash64("__f").alias("__f")))
    mixed = formed.groupBy("__f").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("__f")
    variants = cut(formed.join(mixed, "__f").withColumn("__f", skeleton_column(F.col("__t"))))
    small = (variants.agg(F.sum(F.length("__t") + 40)).first()[0] or 0) <= BROADCAST_CHARS
    members = rows.join(F.broadcast(variants) if small else variants, "__t")
    return variants, members, small


def same_look_classes(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """`row_id, class_id, n_links`: one row for each row whose text another, different text looks the same as.

    The class is named by its least id; `n_links` is the number of rows of the class with another text. Null and empty
    texts are in no class; copies of one text alone are none.
    """
    _, members, _ = _looking_alike(df, row_id, text)
    counted = members.groupBy("__f", "__t").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("low"))
    classes = counted.groupBy("__f").agg(F.sum("n").alias("total"), F.min("low").alias("class_id"), F.count(F.lit(1)).alias("k")).where("k > 1")
    per_text = cut(counted.join(classes, "__f").select("__t", "class_id", (F.col("total") - F.col("n")).alias("n_links")))
    joined = skew.fragment_replicate_join(members.select("__id", "__t"), per_text, "__t", row_id="__id")
    return joined.select(F.col("__id").alias(row_id), "class_id", "n_links")


def same_look_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """`id_a, id_b` (a < b): rows whose texts differ in their characters but have one comparison form.

    Only forms with at least two different texts go on; different texts are paired, not rows, so copies of one text
    are never compared with each other. A text with many rows is split over the tasks in both joins, so no task writes
    all its pairs. Null and empty texts, and equal texts, give no pair.
    """
    variants, members, small = _looking_alike(df, row_id, text)
    a, b = (variants.select("__f", F.col("__t").alias(f"__t{x}")) for x in "ab")
    pairs = cut(a.join(b, "__f").where(F.col("__ta") < F.col("__tb")).select("__ta", "__tb"))
    rows = [members.select(F.col("__t").alias(f"__t{x}"), F.col("__id").alias(f"__{x}")) for x in "ab"]
    first = skew.fragment_replicate_join(rows[0], pairs, "__ta", row_id="__a").select("__a", "__tb")
    found = skew.fragment_replicate_join(first, rows[1], "__tb", row_id="__a")
    return found.select(F.least("__a", "__b").alias("id_a"), F.greatest("__a", "__b").alias("id_b"))
