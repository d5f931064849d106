"""Text functions as column expressions. No Python code runs per row.

White space is the Unicode kind, written out as one class that both regular-expression engines in use read alike; word
characters are letters, numbers and the underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinleaf.config import DEFAULTS, Settings

#: White space inside a bracketed class.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EDGES = rf"^[{WS}]+|[{WS}]+$"
WORD = r"[\p{L}\p{N}_]+"
ENDS = " .,!?;:"

# Fixed values, compared output: character pairs that recognizers take for one another in the order in which they are
# reported, classes, severities, verdicts and suggestion texts.
OCR_PAIRS = (("l", "1"), ("O", "0"), ("S", "5"), ("I", "1"), ("Z", "2"), ("B", "8"))
CLASSES = ("exact_match", "minor_difference", "rewording", "significant")
SEVERITIES = {"exact_match": "none", "minor_difference": "low", "rewording": "medium", "significant": "high"}
#: Verdict steps: least percentage, status, message, colour.
VERDICTS = (
    (98, "identical", "Documents are virtually identical", "green"),
    (90, "very_similar", "Documents are very similar with minor differences", "green"),
    (75, "similar", "Documents are similar but have notable differences", "yellow"),
    (50, "different", "Documents have significant differences", "orange"),
    (None, "very_different", "Documents are substantially different", "red"),
)
#: Suggestion for a sentence of one document only, by side.
ONLY_TEXTS = (
    "This sentence appears in document 1 but not in document 2",
    "This sentence appears in document 2 but not in document 1",
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def clean_text(text: Column) -> Column:
    """Runs of spaces and of blank lines shortened, page-number lines and form feeds taken out, ends stripped; in this order."""
    out = F.regexp_replace(text, " +", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"\n\p{Nd}+\n", "\n")
    return strip(F.regexp_replace(out, r"\f", "\n\n"))


def ocr_quality(text: Column) -> Column:
    """1 for clean text down to 0, by odd characters, single characters, and digits beside letters; 0 for empty and null text."""
    odd = F.regexp_count(text, F.lit(rf"""[^\p{{L}}\p{{N}}_{WS}.,!?;:\-'"()]"""))
    single = F.regexp_count(text, F.lit(rf"[{WS}][\p{{L}}\p{{N}}_][{WS}]"))
    mixed = F.regexp_count(text, F.lit(r"\p{Nd}[a-zA-Z]|[a-zA-Z]\p{Nd}"))
    share = (odd + single + mixed).cast("double") / F.length(text).cast("double")
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - share * 10.0))


def is_image(ext: Column) -> Column:
    return F.lower(ext).isin(".png", ".jpg", ".jpeg")


def suffix(name: Column) -> Column:
    """The lower-case file suffix with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def normalize_sentence(text: Column) -> Column:
    """Lower case, white space as single spaces, without marks at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{WS}]+", " "), F.lit(ENDS))


def split_long(text: Column, limit: int = DEFAULTS.max_sentence_length) -> Column:
    """Parts at semicolons if all are shorter than ``limit``, else at colons, else slices of ``limit`` characters."""

    def parts(mark: str) -> Column:
        return F.filter(F.transform(F.split(text, mark), strip), lambda x: x != "")

    def short(mark: str) -> Column:
        return F.contains(text, F.lit(mark)) & F.forall(parts(mark), lambda x: F.length(x) < limit)

    slices = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(limit)), lambda o: F.substring(text, o + 1, F.lit(limit))
    )
    return F.when(short(";"), parts(";")).when(short(":"), parts(":")).otherwise(slices)


def preview(text: Column, limit: int = DEFAULTS.preview_length) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """The words of a text, lower case, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 where a side has none or is null."""
    x, y = F.coalesce(F.array_distinct(tokens(a)), F.array()), F.coalesce(F.array_distinct(tokens(b)), F.array())
    both = F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y)).cast("double")
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both)


def classify(exact: Column, normalized: Column, similarity: Column, cfg: Settings = DEFAULTS) -> Column:
    return (
        F.when(exact, CLASSES[0])
        .when(normalized, CLASSES[1])
        .when(similarity > cfg.minor_above, CLASSES[1])
        .when(similarity > cfg.rewording_above, CLASSES[2])
        .otherwise(CLASSES[3])
    )


def severity(kind: Column) -> Column:
    out = F
    for k, v in SEVERITIES.items():
        out = out.when(kind == k, v)
    return out.otherwise("medium")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{WS}]+"), lambda x: x != ""))


def suggestions(a: Column, b: Column) -> Column:
    """What may have caused the difference between two texts, in fixed order."""
    rows = []
    for x, y in OCR_PAIRS:
        for p, q in ((x, y), (y, x)):
            rows.append(F.when(F.contains(a, F.lit(p)) & F.contains(b, F.lit(q)), F.lit(f"Possible OCR error: '{p}' → '{q}'")))
    apart = F.abs(F.length(a) - F.length(b))
    rows.append(F.when(apart > 10, F.concat(F.lit("Length difference: "), apart.cast("string"), F.lit(" characters"))))
    m, n = word_count(a), word_count(b)
    words = F.concat(F.lit("Word count difference: "), m.cast("string"), F.lit(" vs "), n.cast("string"), F.lit(" words"))
    rows.append(F.when(F.abs(m - n) > 3, words))
    return F.array_compact(F.array(*rows))


def verdict(overall: Column, matched: Column) -> dict[str, Column]:
    """Status, message, colour and confidence for an overall percentage."""
    out = {}
    for name, at in (("status", 1), ("message", 2), ("color", 3)):
        c = F
        for step in VERDICTS[:-1]:
            c = c.when(overall >= step[0], step[at])
        out[name] = c.otherwise(VERDICTS[-1][at])
    out["confidence"] = F.when(matched > 5, "high").otherwise("medium")
    return out


def label(kind: Column) -> Column:
    """A kind as words with capitals, for display."""
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def escape_html(text: Column) -> Column:
    out = text
    for c, r in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(r))
    return out
