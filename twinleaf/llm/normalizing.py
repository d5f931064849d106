"""Problem 3: one consistent form for texts that look the same.

A text is scanned for unstable segments with the normalization quick check: every character that may combine with its
neighbours, is not composed, or has another form of the same print. Only those segments, each with the stable character
before it as boundary context, are brought into the consistent form and spliced back into the unchanged rest.

The consistent form: canonically composed (NFC); width, font and presentation variants and ligatures as the ordinary
letters; every kind of blank as a space; invisible characters removed; letters of other alphabets that print as a
Latin letter replaced by it. Letter case, accents, punctuation, raised figures and digits of other scripts stay as they
are.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters and marks that print as a Latin letter or an ASCII mark, by script; each line the letters, then
# what they print as.
_ALIKE = (
    # Cyrillic
    ("А В Е І Ј К М Н О Р С Ѕ Т У Х Ү Ԛ Ԝ Ԁ Ӏ", "A B E I J K M H O P C S T Y X Y Q W D I"),
    ("а с ԁ е һ і ј ӏ о р ԛ ѕ ѵ ԝ х у ү", "a c d e h i j l o p q s v w x y y"),
    # Greek
    ("Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ Ϲ Ϳ", "A B E Z H I K M N O P T Y X C J"),
    ("ο ν ϲ ϳ ι ρ", "o v c j i p"),
    # Coptic
    ("Ⲃ Ⲏ Ⲓ Ⲕ Ⲙ Ⲛ Ⲟ Ⲣ Ⲥ Ⲧ Ⲩ Ⲭ ⲟ ⲣ ⲥ", "B H I K M N O P C T Y X o p c"),
    # Armenian
    ("օ ս հ ո Տ Օ", "o u h n S O"),
    # Cherokee
    ("Ꭰ Ꭱ Ꭲ Ꭺ Ꭻ Ꭼ Ꮃ Ꮇ Ꮋ Ꮐ Ꮓ Ꮟ Ꮪ Ꮩ Ꮮ Ꮯ Ꮲ Ꮶ Ᏼ Ꮷ", "D R T A J E W M H G Z b S V L C P K B d"),
    # Lisu
    ("ꓐ ꓑ ꓓ ꓔ ꓖ ꓗ ꓙ ꓚ ꓜ ꓝ ꓟ ꓠ ꓡ ꓢ ꓣ ꓦ ꓧ ꓪ ꓫ ꓬ ꓮ ꓰ ꓲ ꓳ ꓴ", "B P D T G K J C Z F M N L S R V H W X Y A E I O U"),
    # Small capitals and other Latin letters
    ("ᴄ ᴏ ᴠ ᴡ ᴢ ꜱ ᴜ ɑ ɡ ı", "c o v w z s u a g i"),
    # Marks
    ("‐ ‑ ﹣ ‧", "- - - ·"),
)
LOOK_ALIKES = {a: b for left, right in _ALIKE for a, b in zip(left.split(), right.split(), strict=True)}

# Format characters that print something.
_PRINTED_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
# Letters and marks that print nothing.
_UNPRINTED = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
JOINERS = "‌‍"
_SELECTORS = (range(0xFE00, 0xFE10), range(0xE0100, 0xE01F0))
_VARIANTS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
_RADICALS = range(0x2E80, 0x2FE0)
_ROMAN = range(0x2160, 0x2180)


def _is_invisible(c: str) -> bool:
    if c in _UNPRINTED or any(ord(c) in r for r in _SELECTORS):
        return True
    return unicodedata.category(c) == "Cf" and c not in _PRINTED_FORMATS and c not in JOINERS


def _is_variant(c: str) -> bool:
    """Whether ``c`` prints as the characters of its compatibility decomposition: width, font, place, ligature."""
    tag, _, target = unicodedata.decomposition(c).partition(" ")
    if tag in _VARIANTS:
        return True
    if tag != "<compat>":
        return False
    letters = [chr(int(x, 16)) for x in target.split()]
    ligature = len(letters) > 1 and c.isalpha() and all(x.isalpha() for x in letters)
    return ligature or ord(c) in _RADICALS or ord(c) in _ROMAN


def _ranges(points: Iterable[int]) -> str:
    """The code points as the inside of a character class."""
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _tables() -> tuple[str, str, str, str]:
    """Character classes read off the Unicode database: unstable, invisible, variant and blank characters.

    Unstable are those that are no starters, that the quick check doesn't answer with yes - they compose with what stands
    before them, or are not composed themselves - and those that have another form of the same print.
    """
    unstable: set[int] = set()
    invisible: set[int] = set()
    variants: set[int] = set()
    blanks: set[int] = set()
    unstable.update(range(0x1161, 0x1176), range(0x11A8, 0x11C3))  # Hangul vowels and finals compose by rule
    for p in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)):
        c = chr(p)
        decomposition = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            unstable.add(p)
        if decomposition and not decomposition.startswith("<"):
            parts = [int(x, 16) for x in decomposition.split()]
            if unicodedata.normalize("NFC", c) != c:
                unstable.add(p)
            elif len(parts) == 2:
                unstable.add(parts[1])
            if unicodedata.normalize("NFD", c)[0] in LOOK_ALIKES:
                unstable.add(p)
        if _is_invisible(c):
            invisible.add(p)
        elif _is_variant(c):
            variants.add(p)
        elif unicodedata.category(c) == "Zs":
            blanks.add(p)
    unstable |= invisible | variants | blanks | set(map(ord, LOOK_ALIKES)) | set(map(ord, JOINERS))
    return _ranges(unstable), _ranges(invisible), _ranges(variants), _ranges(blanks)


UNSTABLE, INVISIBLE, VARIANTS, BLANKS = _tables()
#: Quick check: a run of characters that may change. All those beyond the basic plane are looked at.
_RUN = re.compile(f"[{UNSTABLE}\\U00010000-\\U0010ffff]+")
_LOOK = str.maketrans(LOOK_ALIKES)
_DROP = re.compile(f"[{INVISIBLE}]")
_BLANK = re.compile(f"[{BLANKS}]")
_JOINING = "؀-߿ࡠ-ࣿऀ-෿"
# A joiner shows between letters of a joining script or after a sign that suppresses a vowel.
_JOINER = re.compile(f"(?<![{_JOINING}])[{JOINERS}]+|[{JOINERS}]+(?![{_JOINING}])")
_VARIANT = re.compile(f"[{VARIANTS}]+")


def _canonical(segment: str) -> str:
    out = _DROP.sub("", segment)
    out = _JOINER.sub("", out)
    out = _VARIANT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), out)
    out = _BLANK.sub(" ", out)
    # Letters are compared without their marks, so an accented look-alike meets the accented letter.
    out = unicodedata.normalize("NFD", out).translate(_LOOK)
    return unicodedata.normalize("NFC", out)


_remembered = functools.lru_cache(maxsize=1 << 16)(_canonical)


def consistent(text: str | None) -> str | None:
    """The consistent form of ``text``; null stays null. Applying it twice changes nothing more.

    A joiner at the end of a segment is judged by the stable character behind it, which is why that is seen too.
    The forms of short segments are remembered.
    """
    if text is None or text.isascii():
        return text
    pieces, done = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        if start > done:
            start -= 1
            if start > done:
                pieces.append(text[done:start])
        if text[end - 1] in JOINERS and end < len(text):
            pieces.append(_canonical(text[start : end + 1])[:-1])
        elif end - start < 16:
            pieces.append(_remembered(text[start:end]))
        else:
            pieces.append(_canonical(text[start:end]))
        done = end
    pieces.append(text[done:])
    return "".join(pieces)


@F.pandas_udf(T.StringType())
def _consistent_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(consistent, na_action="ignore")


def consistent_form(text: Column | str) -> Column:
    """Column form of :func:`consistent`."""
    return _consistent_udf(F.col(text) if isinstance(text, str) else text)


def comparable(text: Column) -> Column:
    """Lower case, runs of white space as one space, without marks at the ends: equal for loosely equal texts."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), F.lit(" .,!?;:"))


def normalized_matches(matches: DataFrame) -> DataFrame:
    """``matches`` (``match_id``, ``sent1.text``, ``sent2.text``, flags) with both texts in the consistent form.

    One row per ``match_id``; rows sent twice count once. Columns: ``match_id``, ``text1``, ``text2``,
    ``exact_match``, ``normalized_match`` (right flags), ``stored_exact``, ``stored_normalized``. Where a text is null
    both flags are false. Empty texts equal each other. Columns beyond those named are ignored.
    """
    rows = matches.select(
        "match_id",
        F.col("sent1.text").alias("raw1"),
        F.col("sent2.text").alias("raw2"),
        F.col("exact_match").alias("stored_exact"),
        F.col("normalized_match").alias("stored_normalized"),
    ).dropDuplicates(["match_id"])
    stable = "^[\\x00-\\x7f]*$"
    ascii_only = F.coalesce(F.col("raw1").rlike(stable), F.lit(True)) & F.coalesce(F.col("raw2").rlike(stable), F.lit(True))
    quick = rows.where(ascii_only).withColumns({"text1": F.col("raw1"), "text2": F.col("raw2")})
    slow = rows.where(~ascii_only).withColumns({"text1": consistent_form("raw1"), "text2": consistent_form("raw2")})
    both = quick.unionByName(slow)
    return both.select(
        "match_id",
        "text1",
        "text2",
        F.coalesce(F.col("text1") == F.col("text2"), F.lit(False)).alias("exact_match"),
        F.coalesce(comparable(F.col("text1")) == comparable(F.col("text2")), F.lit(False)).alias("normalized_match"),
        "stored_exact",
        "stored_normalized",
    )
