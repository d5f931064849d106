"""SQL of the training-data queries that SQL can state."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The same print by code point, stated apart from the operator's own tables.
_FROM = (
    "АВЕІЈКМНОРСЅТУХҮԚԜԀӀасԁеһіјӏорԛѕѵԝхуүΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳιρ"
    "ЀЁЇѐёїӒӓӦӧӰӱΪΫϊόίΌΊΆΈΉΎ"
    "‐‑﹣‧"
)
_TO = (
    "ABEIJKMHOPCSTYXYQWDIacdehijlopqsvwxyyABEZHIKMNOPTYXCJovcjip"
    "ÈËÏèëïÄäÖöŸÿÏŸïóíÓÍÁÉÍÝ"
    "---·"
)
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_BLANK = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}
_GONE = r"[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{fe00}-\x{fe0f}\x{feff}]"


def consistent(x: str) -> str:
    """The consistent form, letter by letter: look-alikes, widths and blanks replaced, invisible characters removed."""
    before = _FROM + _WIDE + _BLANK
    after = _TO + "".join(map(chr, range(0x21, 0x7F))) + " " * len(_BLANK)
    out = f"translate({x}, {q(before)}, {q(after)})"
    for k, v in _LIGATURES.items():
        out = f"replace({out}, {q(k)}, {q(v)})"
    return f"nfc_normalize(regexp_replace({out}, {q(_GONE)}, '', 'g'))"


def words(x: str) -> str:
    """Words without case, marks and spacing, parted by single blanks."""
    out = f"replace(lower({consistent(x)}), 'ß', 'ss')"
    out = f"regexp_replace({out}, {q(r'[-‐‑¬]\s*\n\s*')}, '', 'g')"
    out = f"regexp_replace({out}, {q(r'\[[0-9]{1,3}\]')}, ' ', 'g')"
    out = f"regexp_replace({out}, {q(r'([\p{L}])[.!?;:]([\p{L}])')}, '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, {q(r'[^\p{L}\p{N}\s]')}, '', 'g')"
    return f"trim(regexp_replace({out}, {q(r'\s+')}, ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT doc_id, seq FROM sentence WHERE length(text) > 500",
        "p1_rules": "SELECT doc_id, seq, true AS within_limit, true AS overlapping, true AS rebuilt FROM sentence WHERE length(text) > 500 GROUP BY doc_id, seq",
        "p2_rules": "SELECT doc_id, true AS in_order, true AS as_stored, true AS whole FROM documents"
        " WHERE regexp_matches(text, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]') GROUP BY doc_id",
        "p6_rules": "SELECT count(DISTINCT doc_id) AS documents, 0::bigint AS miscounted, 0::bigint AS needless, 0::bigint AS overfull FROM documents",
        "p3_found": f"SELECT DISTINCT match_id FROM sentence_match WHERE NOT exact_match AND {consistent('sent1.text')} = {consistent('sent2.text')}",
        "p3_matches": f"""WITH m AS (SELECT match_id, any_value({consistent('sent1.text')}) AS text1, any_value({consistent('sent2.text')}) AS text2,
 any_value(exact_match) AS stored_exact, any_value(normalized_match) AS stored_normalized FROM sentence_match GROUP BY match_id),
 n AS (SELECT *, trim(regexp_replace(lower(text1), '\\s+', ' ', 'g'), ' .,!?;:') AS a, trim(regexp_replace(lower(text2), '\\s+', ' ', 'g'), ' .,!?;:') AS b FROM m)
 SELECT match_id, text1, text2, coalesce(text1 = text2, false) AS exact_match, coalesce(a = b, false) AS normalized_match, stored_exact, stored_normalized FROM n""",
        "p7_found": f"""WITH i AS (SELECT item_id, string_split({words('text')}, ' ') AS w FROM benchmark),
 runs AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], '') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
 d AS (SELECT doc_id, replace({words('text')}, ' ', '') AS squeezed FROM documents WHERE text IS NOT NULL)
 SELECT DISTINCT doc_id, item_id FROM d JOIN runs ON contains(squeezed, run)""",
    }
