"""Problem 5: repair of text from scanned pages.

Uploads whose units hold wrapped lines came from scanned pages. Their running headers and page numbers are taken out,
words cut by the end of a line are joined, and misrecognised characters are corrected by a noisy channel: the
probability of character confusions times the likelihood of corpus word pairs, decoded by Viterbi over the candidate
words of each line of text.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinleaf.sources.work import written

# What a recognizer prints for a character, and how likely that is.
CONFUSIONS = {
    "0": ("o",), "1": ("l", "i"), "!": ("i", "l"), "|": ("l", "i"), "@": ("a",), "5": ("s",), "9": ("g",), "+": ("t",),
    "c": ("e",), "b": ("h",), "rn": ("m",), "ri": ("n",), "ii": ("u",), "vv": ("w",), "8": ("b",), "6": ("b", "g"),
    "$": ("s",), "€": ("e",), "£": ("e",), "cl": ("d",), "4": ("a",), "3": ("e",), "2": ("z",), "7": ("t",),
    "e": ("c",), "h": ("b",), "m": ("rn",), "n": ("ri", "u"), "u": ("ii", "n"), "l": ("i",), "i": ("l",),
}
#: Confusions as common as these; the others are rarer by ``RARE``.
COMMON = {"0", "1", "!", "@", "5", "9", "+", "c", "b", "rn", "ri", "ii", "vv"}
SPECKS = "~^|¦`´¨˜°•·_\\<>=*#"
P_CONFUSION, RARE, P_SPECK, P_EDIT, P_SAME = 0.02, 0.02, 0.02, 0.0003, 0.95
#: A printed word that is known itself is questioned if another one is so many times as usual.
KNOWN_RATIO = 20
#: Marks and digits inside letters make no word; log probability of one that stands for itself.
MALFORMED = math.log(1e-7)
_MALFORMED = re.compile(r"[^\W\d_][^\s]*[\d!@+|~^¦$€£]|[\d!@+|~^¦$€£][^\s]*[^\W\d_]")
DIGITS = {"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "B": "8", "Z": "2"}
NUMBER = "<num>"
#: Share of all words from which a word or a pair is sent to every worker, so at most 1 / KEPT of each; the rarer ones are looked
#: up for the text that asks for them.
KEPT = 2e-6
#: A form seen fewer times is no known word: a misread form would vouch for itself.
LEAST = 3
#: Reversed confusions tried at once in one word.
OPS = 3
#: Words of more characters are left as they are.
LONGEST = 40
#: Begins the keys of edits; no skeleton has a blank.
EDITED = " "
#: Words of which a worker remembers what they may stand for, and tokens of which it remembers the counted form.
REMEMBERED = 200_000
#: Words and pairs that a worker counts before it hands the counts over.
COUNTED = 500_000

_LEAD = "([{\"“„«'‘¿¡「『"
_TRAIL = ".,;:?!)]}\"”“»’…」』"
_NUMERIC = re.compile(r"^[§(]?\d[\d.,:/()-]*%?$")
_ASIAN = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")

# Furniture. The forms of page numbers.
_PAGE = (
    r"(?:[-–—\[(]\s*)?\d{1,4}(?:\s*[-–—\])])?"
    r"|(?:page|seite|página|pagina|pág\.|pag\.|p\.|s\.|стр\.|страница|bl\.|folio)\s*\d{1,4}"
    r"(?:\s*(?:of|von|sur|de|di|из|/)\s*\d{1,4})?"
    r"|\d{1,4}\s*/\s*\d{1,4}|第?\s*\d{1,4}\s*[页頁ページ]+"
)
_ROMAN = r"[ivxl]{1,7}"
_PAGE_LINE = re.compile(rf"^\s*(?:(?i:{_PAGE})|{_ROMAN})\s*$")
_PAGE_BESIDE = re.compile(rf"^(?P<head>\S.*?)\s{{2,}}(?:(?i:{_PAGE})|{_ROMAN})\s*$|^\s*(?:(?i:{_PAGE})|{_ROMAN})\s{{2,}}(?P<tail>\S.*)$")
_CUT_MARKS = "-‐‑¬\u00ad"
_FIRST = re.compile(r"^\s*(?P<right>\S+)")


def cut_at_end(line: str) -> tuple[str, str] | None:
    """The part of a word before the mark that cuts it at the end of ``line``, and the mark."""
    line = line.rstrip()
    if not line or line[-1] not in _CUT_MARKS:
        return None
    left = line.rsplit(None, 1)[-1][:-1]
    return (left, line[-1]) if any(c.isalpha() for c in left) else None


def bare_header(line: str) -> str:
    """``line`` without a page number that stands beside its text."""
    m = _PAGE_BESIDE.match(line)
    return (m.group("head") or m.group("tail")).strip() if m else line.strip()


def is_furniture(line: str, repeated: set[str]) -> bool:
    """Whether the whole ``line`` is a page number or a running header; ``repeated`` holds the headers of its upload."""
    if _PAGE_LINE.match(line):
        return True
    return bool(repeated) and bare_header(line) in repeated


def body_of(text: str, repeated: set[str]) -> tuple[str, bool]:
    """``text`` without its furniture lines, and whether there were any."""
    lines = text.split("\n")
    kept = [x for x in lines if not is_furniture(x, repeated)]
    return "\n".join(kept), len(kept) < len(lines)


def core(token: str) -> tuple[str, str, str]:
    """Marks before, the word, and marks after it."""
    a, b = 0, len(token)
    while a < b and token[a] in _LEAD:
        a += 1
    while b > a and token[b - 1] in _TRAIL:
        b -= 1
    return token[:a], token[a:b], token[b:]


def gram(word: str) -> str:
    """The form in which a word is counted."""
    return NUMBER if _NUMERIC.match(word) else word.lower()


def counted_form(token: str) -> str:
    """The form in which a printed token is counted; empty for scripts that don't part words and for bare marks."""
    w = core(token)[1]
    return gram(w) if w and not _ASIAN.search(w) else ""


#: Characters by what the channel may take for each other, in the smallest parts: what is reached by any number of reversed
#: confusions has the same skeleton. ``|`` is a speck or a letter and stays; hyphens go since joins may add them.
_SKELETON = str.maketrans(
    dict.fromkeys((set(SPECKS) - {"|"}) | {"-", "\u00ad"})
    | {c: to for to, of in (("i", "1l!"), ("o", "0"), ("a", "@4"), ("s", "5$"), ("b", "968gh"), ("t", "+7"), ("c", "e€£3"), ("z", "2")) for c in of}
    | {"m": "iii", "n": "ii", "u": "ii", "d": "ci", "w": "vv", "ς": "σ"}
)
_BEFORE_I = re.compile("r+(?=i)")


def skeleton(word: str) -> str:
    """What stays the same of a counted form under all reversed confusions, but for ``|``."""
    return _BEFORE_I.sub(lambda m: "i" * len(m[0]), word.translate(_SKELETON))


@functools.lru_cache(REMEMBERED // 4)
def skeletons(printed: str) -> tuple[str, ...]:
    """The skeletons of what ``printed`` may stand for: no more than ``OPS`` of its ``|`` are specks or letters."""
    bars = [i for i, c in enumerate(printed) if c == "|"] if len(printed) <= LONGEST else []
    out = {skeleton(printed)}
    for k in range(1, min(OPS, len(bars)) + 1):
        for chosen in itertools.combinations(bars, k):
            for put in itertools.product(("", "i"), repeat=k):
                at = dict(zip(chosen, put))
                out.add(skeleton("".join(at.get(i, c) for i, c in enumerate(printed))))
    return tuple(out)


def edit_keys(word: str) -> tuple[str, ...]:
    """Keys of which two words share one if a lost, added or exchanged letter makes one of the other."""
    return tuple({f"{EDITED}{word}", *(f"{EDITED}{word[:k]}{word[k + 1 :]}" for k in range(len(word)))})


def word_keys(word: str) -> tuple[str, ...]:
    """The keys under which a known word is found: by its skeleton, and by edits."""
    edited = len(word) <= 2 * LONGEST and (word.isalpha() or not word.isascii())
    return (skeleton(word), *edit_keys(word)) if edited else (skeleton(word),)


class Channel:
    """The language model and the channel: word and word-pair counts, and candidates for a printed word.

    ``words`` and ``pairs`` are the usual ones. ``take`` adds the rarer ones that the text at hand asked for.
    """

    def __init__(self, total: int, words: dict[str, int], pairs: dict[str, int]):
        self.total = max(total, 1)
        self.words, self.pairs = words, pairs
        self.unknown = 0.02 / self.total
        #: What was found for a word; words repeat, and what they may stand for does not depend on their place.
        self._found: dict[str, dict[str, float]] = {}
        #: Candidates of printed words that depend on no rarer word and no place, and printed words that ask for none.
        self._fixed: dict[str, list[tuple[str, float]]] = {}
        self._silent: set[str] = set()
        self._letters: dict[str, set[str]] | None = None
        #: Rarer words and pairs, and the words by their keys.
        self.rest: dict[str, int] = {}
        self._keyed: dict[str, list[str]] = {}
        self._costs: dict[tuple[str, str, str], float | None] = {}

    def take(self, rest: dict[str, int]) -> None:
        """Counts of rarer words and pairs, in place of those taken before."""
        self.rest, self._keyed = rest, {}
        for w in rest:
            if " " not in w:
                for key in word_keys(w):
                    self._keyed.setdefault(key, []).append(w)

    def count(self, word: str) -> int:
        return self.words.get(word) or self.rest.get(word, 0)

    def pair(self, before: str, word: str) -> int:
        both = f"{before} {word}"
        return self.pairs.get(both) or self.rest.get(both, 0)

    def __getstate__(self) -> tuple:
        return self.total, self.words, self.pairs

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _alphabet(self, word: str) -> set[str]:
        """The letters of known words in the scripts of ``word``."""
        if self._letters is None:
            self._letters = {}
            for c in {c for w in self.words for c in w if c.isalpha()}:
                self._letters.setdefault(unicodedata.name(c, "?").split()[0], set()).add(c)
        return {c for x in {unicodedata.name(c, "?").split()[0] for c in word} for c in self._letters.get(x, ())}

    def likely(self, before: str, word: str) -> float:
        """Log probability of ``word`` after ``before``."""
        one = self.count(word) / self.total or self.unknown
        n = self.count(before)
        if n:
            return math.log(0.7 * self.pair(before, word) / n + 0.3 * one)
        return math.log(one)

    @staticmethod
    @functools.lru_cache(8)  # it is asked for usual and for rarer words in turn
    def _reached(printed: str) -> dict[str, float]:
        """What the channel can turn into ``printed`` by confusions, with the log probability."""
        seen = {printed: 0.0}
        edge = {printed: 0.0}
        for _ in range(OPS):
            grown: dict[str, float] = {}
            for text, cost in edge.items():
                for i in range(len(text)):
                    if text[i] in SPECKS:
                        nxt = text[:i] + text[i + 1 :]
                        p = cost + math.log(P_SPECK)
                        if p > grown.get(nxt, -1e9):
                            grown[nxt] = p
                    for size in (1, 2):
                        part = text[i : i + size]
                        if len(part) < size:
                            continue
                        for true in CONFUSIONS.get(part, ()):
                            common = part in COMMON
                            nxt = text[:i] + true + text[i + size :]
                            p = cost + math.log(P_CONFUSION if common else P_CONFUSION * RARE)
                            if p > grown.get(nxt, -1e9):
                                grown[nxt] = p
            edge = {}
            for nxt, p in grown.items():
                if p > seen.get(nxt, -1e9) and p > math.log(P_CONFUSION) * OPS - 1e-9:
                    seen[nxt] = p
                    edge[nxt] = p
        del seen[printed]
        return seen

    def _reversed(self, printed: str) -> dict[str, float]:
        """Usual words that the channel can turn into ``printed`` by confusions, with the log probability."""
        return {w: p for w, p in self._reached(printed).items() if w in self.words}

    def _edited(self, printed: str) -> dict[str, float]:
        """Usual words one lost, added or exchanged letter away; a word that lost or exchanged one has 5 to 30 letters."""
        out: dict[str, float] = {}
        letters = self._alphabet(printed)
        words = self.words
        if 4 <= len(printed) < 30:
            for k in range(len(printed) + 1):
                a, b = printed[:k], printed[k:]
                out.update((w, math.log(P_EDIT)) for c in letters if (w := a + c + b) in words and w.isalpha())
        for k in range(len(printed)):
            a, b = printed[:k], printed[k + 1 :]
            if a + b in words:
                out[a + b] = math.log(P_EDIT)
            if 5 <= len(printed) <= 30:
                for c in letters:
                    if (w := a + c + b) in words and w.isalpha():
                        out.setdefault(w, math.log(P_EDIT * RARE))
        out.pop(printed, None)
        return out

    def _remembered(self, name: str, printed: str) -> dict[str, float]:
        key = name + printed
        found = self._found.get(key)
        if found is None:
            if len(self._found) >= REMEMBERED:
                self._found.clear()
            found = self._found[key] = self._reversed(printed) if name == "r" else self._edited(printed)
        rarer = self._rarer(name, printed) if self._keyed else None
        return found | rarer if rarer else found

    def _rarer(self, name: str, printed: str) -> dict[str, float]:
        """As ``_reversed`` or ``_edited``, of the rarer words."""
        keys = skeletons(printed) if name == "r" else edit_keys(printed)
        near = {w for key in keys for w in self._keyed.get(key, ())} - {printed}
        if any((name, printed, w) not in self._costs for w in near):
            if len(self._costs) >= REMEMBERED:
                self._costs.clear()
            reached = self._reached(printed) if name == "r" else {w: p for w in near if (p := _edit(printed, w)) is not None}
            self._costs.update(((name, printed, w), reached.get(w)) for w in near)
        return {w: p for w in near if (p := self._costs[name, printed, w]) is not None}

    def candidates(self, word: str, before: str) -> list[tuple[str, float]]:
        """``(counted form, log probability of the channel)`` of what ``word`` may stand for, itself first."""
        found = self._fixed.get(word)
        if found is None:
            low = gram(word)
            found = self._candidates(word, low, before)
            if low == NUMBER or (low in self.words and not _like_number(word) and not _MALFORMED.search(word)):
                if len(self._fixed) >= REMEMBERED:
                    self._fixed.clear()
                self._fixed[word] = found
        return found

    def _candidates(self, word: str, low: str, before: str) -> list[tuple[str, float]]:
        own = [(low, math.log(P_SAME))]
        if low == NUMBER or len(word) > LONGEST or _ASIAN.search(word):
            return own
        count = self.count(low)
        if _like_number(word):
            # A number with a letter for a digit, if numbers are usual here; known codes stay.
            share = self.pair(before, NUMBER) / max(self.count(before), 1)
            code = word[0] in "BZI"  # such as B12, unless numbers are usual here
            if share > 0.05 or not (count or code):
                return [*own, (NUMBER, math.log(P_CONFUSION))]
            return own
        malformed = bool(_MALFORMED.search(word))
        letters = [c for c in word if c.isalpha()]
        if len(letters) < len(word) and len(letters) <= 2 and all(c.isupper() for c in letters):
            return own  # a code such as 3A or B12
        if len(low) < 2 or (count > self.total * 2e-5 * KNOWN_RATIO and not malformed):
            return own
        found = self._remembered("r", low)
        if malformed:
            found = {w: p for w, p in found.items() if not _MALFORMED.search(w)}
            if found:
                own = [(low, MALFORMED)]
        elif count:
            # A known word stands for another one only if that is far more usual.
            found = {w: p for w, p in found.items() if p >= math.log(P_CONFUSION) - 1e-9 and self.count(w) > KNOWN_RATIO * count}
        elif not found and len(low) >= 5 and word.isalpha() and not word[0].isupper():
            found = self._remembered("e", low)
        if word[:1].isupper() and word.isalpha() and not count:
            # An unknown capitalised word is a name unless a usual confusion of a usual word explains it.
            found = {w: p for w, p in found.items() if p >= math.log(P_CONFUSION) * 2 - 1e-9 and self.count(w) / self.total > 2e-5}
        return own + sorted(found.items(), key=lambda x: (-(x[1] + math.log(self.count(x[0]))), x[0]))

    def decode(self, tokens: list[str], before: str = "") -> list[str | None]:
        """For each printed token the counted form it stands for, or None where it stands for itself: Viterbi."""
        cores = [core(t)[1] for t in tokens]
        options: list[list[tuple[str, float]]] = []
        last = before
        for w in cores:
            options.append(self.candidates(w, last) if w else [("", 0.0)])
            last = options[-1][0][0] if w else last
        if all(len(o) == 1 for o in options):
            return [None] * len(tokens)
        score = {before: (0.0, ())}
        for o in options:
            if o[0][0] == "":
                score = {k: (s, (*path, 0)) for k, (s, path) in score.items()}
                continue
            if len(score) == len(o) == 1:  # nothing to choose
                score = {o[0][0]: (s, (*path, 0)) for s, path in score.values()}
                continue
            nxt: dict[str, tuple[float, tuple]] = {}
            for j, (w, p) in enumerate(o):
                s, path = max((s + self.likely(k, w), path) for k, (s, path) in score.items())
                if w not in nxt or s + p > nxt[w][0]:
                    nxt[w] = (s + p, (*path, j))
            score = nxt
        _, path = max(score.values())
        return [options[i][j][0] if j else None for i, j in enumerate(path)]

    def asked_of_word(self, word: str, joined: bool) -> Iterator[str]:
        """Keys of the rarer words that count where ``word`` is printed; of ``joined`` parts, with a hyphen between them or none."""
        if word in self._silent and not joined:
            return
        low = gram(word)
        known = low in self.words
        if _ASIAN.search(word) or (known and not joined and not _MALFORMED.search(word)):
            if not joined:
                if len(self._silent) >= REMEMBERED:
                    self._silent.clear()
                self._silent.add(word)
            return
        yield from skeletons(low)
        if _like_number(word):
            yield skeleton(NUMBER)
        # Edits are tried only where no confusion explains the word.
        if not known and len(low) >= 5 and len(word) <= LONGEST and word.isalpha() and not word[0].isupper() and not self._remembered("r", low):
            yield from edit_keys(low)

    def asked_of_pairs(self, tokens: list[str]) -> Iterator[str]:
        """The pairs that ``decode`` may look at and that are not among the usual ones."""
        last, states = "", [""]
        for w in (core(t)[1] for t in tokens):
            if not w:
                continue
            forms = [form for form, _ in self.candidates(w, last)]
            if w not in self._fixed and _like_number(w):
                forms = [*forms, NUMBER]
                yield f"{last} {NUMBER}"
            if len(states) > 1 or len(forms) > 1:
                for k, form in itertools.product(states, forms):
                    if (both := f"{k} {form}") not in self.pairs and self.count(k) and self.count(form):
                        yield both
            last, states = forms[0], forms


def _like_number(word: str) -> bool:
    """Whether ``word`` has digits, and else only letters that are taken for digits."""
    return any(c.isdigit() for c in word) and all(c.isdigit() or c in DIGITS or c in ".,()/:-" for c in word)


def _edit(printed: str, word: str) -> float | None:
    """The log probability of ``_edited`` that ``printed`` stands for the known ``word``; None if it can't."""
    k = next((i for i, (a, b) in enumerate(zip(printed, word)) if a != b), min(len(printed), len(word)))
    if len(word) == len(printed) - 1:
        return math.log(P_EDIT) if printed[k + 1 :] == word[k:] else None
    added = len(word) == len(printed) + 1
    if not (4 <= len(printed) < 30 if added else 5 <= len(printed) <= 30) or not word.isalpha():
        return None
    if word[k + 1 :] != (printed[k:] if added else printed[k + 1 :]):
        return None
    script = unicodedata.name(word[k], "?").split()[0]
    if script not in {unicodedata.name(c, "?").split()[0] for c in printed}:
        return None
    return math.log(P_EDIT if added else P_EDIT * RARE)


def _restored(printed: str, form: str) -> str:
    """The counted form in the case of the printed word."""
    if form == NUMBER:
        return "".join(DIGITS.get(c, c) for c in printed)
    letters = [c for c in printed if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return form.upper()
    if printed[:1].isupper() or (not printed[:1].isalpha() and printed[1:2].isupper()):
        return form[:1].upper() + form[1:]
    return form


def is_compound(left: str, right: str, mark: str, channel: Channel) -> bool:
    """Whether ``left`` and ``right`` are a compound broken at its own hyphen rather than a word cut in two."""
    if mark not in "-‐‑":
        return False
    a, b = core(left)[1], core(right)[1]
    whole = channel.count((a + b).lower())
    hyphened = channel.count(f"{a}-{b}".lower())
    if whole or hyphened:
        return hyphened > whole
    return a[:1].isupper() and b[:1].isupper()


def tokens_of(body: str, cut_before: str | None, after: str | None, channel: Channel) -> tuple[list[str], bool]:
    """The tokens of one unit with their cut words joined, and whether a word is cut.

    ``cut_before`` is the text before this unit, whose last word may go on here; ``after`` the text that follows.
    """
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return [], False
    tokens: list[str] = []
    hyphen = False
    skip = False
    if cut_before is not None:
        skip = cut_at_end(cut_before) is not None and bool(_FIRST.match(lines[0])) and lines[0].lstrip()[:1].isalnum()
    carry: tuple[str, str] | None = None
    for k, line in enumerate(lines):
        words = line.split()
        if k == 0 and skip:
            words = words[1:]
        if carry is not None and words:
            left, mark = carry
            compound = is_compound(left, words[0], mark, channel)
            hyphen |= not compound
            words = [f"{left}-{words[0]}" if compound else left + words[0], *words[1:]]
            carry = None
        cut = cut_at_end(line)
        if cut and words:
            mark = cut[1]
            # The mark belongs to the last word as it stands after an earlier join.
            left = words[-1].rstrip() if words[-1].rstrip()[-1:] != mark else words[-1].rstrip()[:-1]
            follows = lines[k + 1] if k + 1 < len(lines) else after
            first = _FIRST.match(follows) if follows else None
            if first is None:
                if core(left)[1]:
                    hyphen = True
                tokens += [*words[:-1], left]
                continue
            if first.group("right")[:1].isalnum() or first.group("right")[:1] in "!@+|~^¦":
                tokens += words[:-1]
                if k + 1 < len(lines):
                    carry = (left, mark)
                else:
                    right = first.group("right")
                    if is_compound(left, right, mark, channel):
                        tokens.append(left + "-" + right)
                    else:
                        hyphen = True
                        tokens.append(left + right)
                continue
        tokens += words
    if carry is not None:
        tokens.append(carry[0])
    return [t.replace("\u00ad", "") for t in tokens], hyphen


def possible_words(body: str, after: str | None) -> Iterator[tuple[str, bool]]:
    """All that ``tokens_of`` may look up or return, however it decides, and whether it is joined; joined parts have no hyphen here."""
    lines = [x for x in body.split("\n") if x.strip()]
    left = None
    for k, line in enumerate(lines):
        words = line.split()
        yield from ((core(t.replace("\u00ad", ""))[1], False) for t in words)
        if left is not None:
            yield core(left)[1] + core(words[0])[1], True
            words[0] = left + words[0]
            yield core(words[0].replace("\u00ad", ""))[1], True
        left = None
        cut = cut_at_end(line)
        if cut:
            left = words[-1].removesuffix(cut[1])
            yield core(left.replace("\u00ad", ""))[1], True
    first = _FIRST.match(after) if after else None
    if left is not None and first:
        right = first.group("right")
        yield core(left)[1] + core(right)[1], True
        yield core((left + right).replace("\u00ad", ""))[1], True


def repair(
    body: str, cut_before: str | None, after: str | None, channel: Channel
) -> tuple[str, bool, bool, list[tuple[str, str]]]:
    """The repaired text of one unit, whether a word is cut, whether a character is misread, and the corrections."""
    tokens, hyphen = tokens_of(body, cut_before, after, channel)
    found = channel.decode(tokens)
    fixes, out = [], []
    for t, form in zip(tokens, found):
        if form is None:
            out.append(t)
            continue
        lead, w, trail = core(t)
        new = _restored(w, form)
        fixes.append((w, new))
        out.append(lead + new + trail)
    return " ".join(out), hyphen, bool(fixes), fixes


def _units(sentences: DataFrame) -> DataFrame:
    """Units once each; rows sent twice have the same key and text.

    Only the keys are shuffled to find the rows sent twice; their texts alone are shuffled to keep one of each.
    """
    rows = sentences.select("doc_id", "seq", "text", "start_char", "end_char").where("doc_id is not null and seq is not null and text is not null")
    twice = written(rows.groupBy("doc_id", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "seq"), "twice")
    again = rows.join(twice, ["doc_id", "seq"], "left_semi").dropDuplicates(["doc_id", "seq"])
    return rows.join(twice, ["doc_id", "seq"], "left_anti").unionByName(again)


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words and word pairs of a partition's texts, handed over whenever they become many."""
    numbers: dict[str, int] = {}  # of the counted forms
    forms: dict[str, int] = {}  # of the tokens; -1 for those that are not counted
    words = np.zeros(0, np.int64)
    pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pd.DataFrame:
        names = np.array([*numbers, ""], dtype=object)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        held = np.flatnonzero(words)
        both = [f"{x} {y}" for x, y in zip(names[a], names[b])]
        return pd.DataFrame({"gram": pd.Series([*names[held], *both], dtype=object), "n": np.concatenate([words[held], times]), "size": np.repeat([1, 2], [len(held), len(pairs)])})

    for batch in batches:
        flat: list[int] = []
        for text in batch["text"]:
            for token in text.split():
                k = forms.get(token)
                if k is None:
                    form = counted_form(token)
                    k = numbers.setdefault(form, len(numbers)) if form else -1
                    if len(forms) >= REMEMBERED:
                        forms.clear()
                    forms[token] = k
                if k >= 0:
                    flat.append(k)
            flat.append(-1)
        ids = np.array(flat, dtype=np.int64)
        known = ids[ids >= 0]
        fresh = np.bincount(known, minlength=len(numbers)) if len(numbers) else np.zeros(0, np.int64)
        fresh[: len(words)] += words
        words = fresh
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        new, n = np.unique(ids[:-1][joined] << 32 | ids[1:][joined], return_counts=True)
        all_, back = np.unique(np.concatenate([pairs, new]), return_inverse=True)
        times = np.bincount(back, weights=np.concatenate([times, n]), minlength=len(all_)).astype(np.int64)
        pairs = all_
        if len(pairs) + len(numbers) > COUNTED:
            yield out()
            numbers, forms = {}, {}
            words, pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if numbers:
        yield out()


def counted_grams(units: DataFrame) -> DataFrame:
    """Counts of all words (``size`` 1) and word pairs (2) of the corpus, added up per partition before they are shuffled."""
    counted = units.select("text").mapInPandas(_tallied, "gram string, n long, size int")
    return written(counted.groupBy("size", "gram").agg(F.sum("n").alias("n")), "grams")


def word_counts(units: DataFrame, counted: DataFrame | None = None) -> Channel:
    """The model with the usual words and pairs: those of a share of ``KEPT``, so at most 1 / KEPT of each are brought to the
    driver and sent to the workers. ``rarer`` has the others."""
    counted = counted_grams(units) if counted is None else counted
    total = counted.where("size = 1").agg(F.sum("n")).first()[0] or 0
    kept = counted.where(F.col("n") >= max(LEAST, total * KEPT)).toArrow().to_pydict()
    words = {g: n for g, n, size in zip(kept["gram"], kept["n"], kept["size"]) if size == 1}
    pairs = {g: n for g, n, size in zip(kept["gram"], kept["n"], kept["size"]) if size == 2}
    return Channel(total, words, pairs)


def rarer(units: DataFrame, counted: DataFrame, sent: Broadcast) -> DataFrame | None:
    """``doc_id``, ``home``, ``gram``, ``n``: all known words and pairs below the share of ``KEPT`` that the text of each window of
    ``units`` may look at. None if the corpus has none."""
    total = sent.value.total
    if total * KEPT <= LEAST:
        return None
    known = counted.where((F.col("n") >= LEAST) & (F.col("n") < total * KEPT))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(key, w, n) for w, n in zip(batch["gram"], batch["n"]) for key in word_keys(w)], columns=["key", "gram", "n"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = sent.value
        channel.take({})
        for batch in batches:
            out = {
                (d, h, key)
                for d, h, body, after in zip(batch["doc_id"], batch["home"], batch["body"], batch["following"])
                for w, joined in possible_words(body, after)
                if w
                for key in channel.asked_of_word(w, joined)
            }
            yield pd.DataFrame(list(out), columns=["doc_id", "home", "key"])

    def ask_pairs(r: tuple, channel: Channel) -> list[tuple]:
        asked = channel.asked_of_pairs(tokens_of(r.body, r.previous, r.following, channel)[0])
        return [(r.doc_id, r.home, both) for both in dict.fromkeys(asked)]

    place = "doc_id long, home long"
    asked = units.mapInPandas(ask, f"{place}, key string").distinct()
    by_key = known.where("size = 1").select("gram", "n").mapInPandas(keyed, "key string, gram string, n long")
    words = written(asked.join(by_key, "key").select("doc_id", "home", "gram", "n").distinct(), "rarer_words")
    pairs = over_windows(units, words, sent, ask_pairs, f"{place}, gram string").distinct()
    pairs = pairs.join(known.where("size = 2").select("gram", "n"), "gram")
    return words.unionByName(written(pairs.select("doc_id", "home", "gram", "n"), "rarer_pairs"))


def over_windows(units: DataFrame, rest: DataFrame | None, sent: Broadcast, work: Callable[[tuple, Channel], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``work`` makes of each unit, with the counts of its window in ``rest`` taken into the channel.

    A window's counts stream before its units, so a worker holds those of one window.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    rows = units.withColumn("given", F.lit(False))
    if rest is not None:
        rows = rest.withColumn("given", F.lit(True)).unionByName(rows, allowMissingColumns=True)
        rows = rows.repartition("doc_id", "home").sortWithinPartitions("doc_id", "home", F.desc("given"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = sent.value
        channel.take({})
        window, counts, fresh = None, {}, False
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.doc_id, r.home) != window:
                    window, fresh = (r.doc_id, r.home), bool(counts)
                    counts = {}
                if r.given:
                    counts[r.gram] = int(r.n)
                    fresh = True
                    continue
                if fresh:
                    channel.take(counts)
                    fresh = False
                out += work(r, channel)
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(read, schema)


#: A line break that wraps a line: the next line is no item of a list.
_WRAPPED = r"[^\n]\n(?!\s*\n)(?!\(?[A-Za-z0-9]{1,4}[.)]\s)"
SCANNED_SHARE = 0.25


def scanned_uploads(units: DataFrame) -> DataFrame:
    """Ids of uploads that came from scanned pages: at least a quarter of their units hold a wrapped line."""
    return (
        units.groupBy("doc_id")
        .agg(F.count_if(F.col("text").rlike(_WRAPPED)).alias("w"), F.count(F.lit(1)).alias("n"))
        .where((F.col("w") >= 1) & (F.col("w") >= SCANNED_SHARE * F.col("n")))
        .select("doc_id")
    )


#: A running header has at least so many characters, recurs so often, and where it has few capitals, so often.
HEADER_LENGTH, HEADER_TIMES, HEADER_PLAIN_TIMES = 8, 2, 3
#: Share of the words of a header that begin with a capital.
HEADER_CAPITALS = 0.4
#: Percentile of an upload's line lengths that is taken as the width of its page.
PAGE_WIDTH = 0.9
_HEADER_START = re.compile(r"[^\W_]|\(")
_RUNS_ON = ".!?:;,…。‐¬-\u00ad"


def running_headers(scans: DataFrame) -> DataFrame:
    """``doc_id``, ``head`` and ``seq`` of the units in which a running header of the upload stands.

    A running header recurs as a line of the upload, begins with a capital or a number and doesn't end as text does. It
    either stands alone in a unit or beside a page number, or breaks off short of the page's width - the next word would have had room - where
    it stands between lines, as wrapped text never does.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, q, text in zip(batch["doc_id"], batch["seq"], batch["text"]):
                lines = text.split("\n")
                for k, line in enumerate(lines):
                    head = bare_header(line)
                    if len(head) < HEADER_LENGTH or not _HEADER_START.match(head) or head[0].islower() or head[-1] in _RUNS_ON:
                        continue
                    following = lines[k + 1].split(None, 1) if k + 1 < len(lines) else []
                    room = len(line.rstrip()) + 1 + len(following[0]) if following else None
                    words = re.findall(r"[^\W\d_]+", head)
                    capitals = sum(w[0].isupper() for w in words) / max(len(words), 1)
                    # A page number beside it is as telling as a unit of its own.
                    alone = len(lines) == 1 or head != line.strip()
                    out.append((d, q, head, alone, k + 1 < len(lines), room, capitals))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "head", "alone", "inner", "room", "capitals"]).astype({"room": "Int64"})

    schema = "doc_id long, seq int, head string, alone boolean, inner boolean, room long, capitals double"
    lines = written(scans.select("doc_id", "seq", "text").mapInPandas(read, schema), "lines")
    parts = F.split("text", "\n")
    wrapped = scans.select("doc_id", F.explode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("line"))
    width = wrapped.groupBy("doc_id").agg(F.percentile_approx(F.length(F.rtrim("line")), PAGE_WIDTH).alias("width"))
    short = F.coalesce(F.col("room") <= F.col("width") - 2, F.lit(False))
    rules = (
        lines.join(written(width, "widths"), "doc_id", "left").groupBy("doc_id", "head")
        .agg(
            F.count(F.lit(1)).alias("n"), F.max("alone").alias("alone"), F.count_if("inner").alias("inner"),
            F.count_if(short).alias("short"), F.max("capitals").alias("capitals"),
        )
    )
    titled = (F.col("capitals") >= HEADER_CAPITALS) | ((F.col("n") >= HEADER_PLAIN_TIMES) & (F.col("inner") >= 2))
    kept = rules.where((F.col("n") >= HEADER_TIMES) & (F.col("alone") | ((2 * F.col("short") >= F.col("inner")) & titled)))
    return lines.select("doc_id", "seq", "head").join(kept.select("doc_id", "head"), ["doc_id", "head"])


#: Units of one window, and those beyond its edges that are seen with it. No window holds more of an upload.
BLOCK, EDGE = 4096, 16


def repaired_units(sentences: DataFrame, wanted: Callable[[DataFrame], DataFrame] = lambda ids: ids) -> DataFrame:
    """Every unit of the scanned uploads, repaired; of those only that ``wanted`` keeps of the ids.

    Columns ``doc_id``, ``seq``, ``text`` (repaired; empty where the unit was furniture only), ``start_char``,
    ``end_char``, ``hyphen``, ``misread``, ``furniture`` and ``fixes`` (printed and corrected word). A word cut by the end
    of a unit is put into the unit where it begins. Rows sent twice count once; null texts and keys give no rows. Words
    are counted over all units.
    """
    units = _units(sentences)
    counted = counted_grams(units)
    sent = units.sparkSession.sparkContext.broadcast(word_counts(units, counted))
    scans = written(units.join(written(wanted(scanned_uploads(units)), "scanned"), "doc_id"), "scans")
    in_unit = running_headers(scans).groupBy("doc_id", "seq").agg(F.collect_set("head").alias("heads"))
    marked = scans.join(in_unit, ["doc_id", "seq"], "left")

    parts = T.StructType([T.StructField("body", T.StringType()), T.StructField("furniture", T.BooleanType())])

    @F.pandas_udf(parts)
    def strip(text: pd.Series, heads: pd.Series) -> pd.DataFrame:
        out = [body_of(t, set(h) if h is not None else set()) for t, h in zip(text, heads)]
        return pd.DataFrame(out, columns=["body", "furniture"])

    bodies = marked.select("doc_id", "seq", "start_char", "end_char", strip("text", "heads").alias("p"))
    bodies = bodies.select("doc_id", "seq", "start_char", "end_char", "p.body", "p.furniture")
    home = F.floor(F.col("seq") / BLOCK)
    blocks = F.array_distinct(F.array(home, F.floor((F.col("seq") - EDGE) / BLOCK), F.floor((F.col("seq") + EDGE) / BLOCK)))
    placed = bodies.withColumn("home", home).withColumn("block", F.explode(blocks))
    own = F.when(F.trim("body") != "", F.col("body"))
    order = Window.partitionBy("doc_id", "block").orderBy("seq")
    beside = (
        placed.withColumn("previous", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("following", F.first(own, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
        .where("home = block")
    )
    schema = (
        "doc_id long, seq int, text string, start_char int, end_char int, hyphen boolean, misread boolean, "
        "furniture boolean, fixes array<string>"
    )

    def mend(r: tuple, channel: Channel) -> list[tuple]:
        text, hyphen, misread, fixes = repair(r.body, r.previous, r.following, channel)
        return [(r.doc_id, r.seq, text, r.start_char, r.end_char, hyphen, misread, r.furniture, [f"{a} > {b}" for a, b in fixes])]

    beside = written(beside.select("doc_id", "home", "seq", "start_char", "end_char", "furniture", "body", "previous", "following"), "bodies")
    return over_windows(beside, rarer(beside, counted, sent), sent, mend, schema)


def noise_found(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id``, ``seq``, ``kind`` (``hyphen``, ``misread``, ``furniture``) of units of uploads that occur in no pair."""
    paired = pairs.select(F.col("doc_id1").alias("doc_id")).union(pairs.select("doc_id2")).where("doc_id is not null").distinct()
    fixed = repaired_units(sentences, lambda ids: ids.join(paired, "doc_id", "left_anti"))
    kinds = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("hyphen", "misread", "furniture")]))
    return fixed.select("doc_id", "seq", F.explode(kinds).alias("kind"))


def paragraphs(sentences: DataFrame) -> DataFrame:
    """The scanned uploads as paragraphs: ``doc_id``, ``paragraph``, ``text``.

    A paragraph begins where a blank line or more lies between two units that hold text; ``paragraph`` is the ``seq`` of
    its first unit.
    """
    units = written(repaired_units(sentences).where("text <> ''"), "repaired")
    block = F.floor(F.col("seq") / BLOCK)
    rows = units.withColumn("block", block)
    in_block = Window.partitionBy("doc_id", "block").orderBy("seq")
    begins = F.when(F.col("start_char") - F.lag("end_char").over(in_block) >= 2, F.col("seq"))
    begun = rows.withColumn("begins", begins).withColumn("first", F.last("begins", ignorenulls=True).over(in_block))
    # The paragraph that is open when a block begins started in an earlier block, or with the upload.
    ends = begun.groupBy("doc_id", "block").agg(F.max("first").alias("last"), F.min("seq").alias("least"))
    over = Window.partitionBy("doc_id").orderBy("block")
    carried = ends.select(
        "doc_id",
        "block",
        F.coalesce(
            F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)),
            F.first("least").over(over.rowsBetween(Window.unboundedPreceding, 0)),
        ).alias("open"),
    )
    named = begun.join(carried, ["doc_id", "block"]).withColumn("paragraph", F.coalesce("first", "open"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return named.groupBy("doc_id", "paragraph").agg(texts.alias("text"))
