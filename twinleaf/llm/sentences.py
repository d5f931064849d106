"""Problem 2: sentence boundaries across languages and scripts.

The boundary rules are compiled into a finite transducer: its input symbols are marks classified by their bounded
context, its states are the kinds of open quotation, its output says whether a sentence ends after the mark.

Every document is read in chunks. The marks of a chunk are classified once and folded into the chunk's function; the
functions are composed by a parallel prefix scan, which gives every chunk the state it begins in, and its marks their
output. Documents above a part's length are read by several tasks, whose functions are composed the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations by what may follow them. Compared in lower case, without the final full stop.
TITLES = set(
    "mr mrs ms messrs mx dr prof rev hon st sr sra srta dra sres hr fr frl ing dipl mag herr mme mlle mm me "
    "г гр проф акад д-р им د أ م डॉ श्री".split()
)
NEVER_LAST = set(
    "e.g i.e cf vs viz approx resp z.b d.h u.a o.ä s.o s.u i.v.m vgl bzw ca ggf sog inkl exkl insb ges "
    "c.-à-d p.ex ex ej p.ej см т.е т.к т.ч напр ref".split()
)
BEFORE_NUMBER = set(
    "no nos nr nrn art arts sec secs § cl cls para paras par abs ziff rn rdnr bd s p pp vol ch chap fig tab sch "
    "n.º n.° nº núm num ap apdo apt inc al l'art l'al d'art ст п пп ч разд гл рис jan feb mar apr may jun jul aug "
    "sep sept oct nov dec".split()
)
#: Words after which a single capital is a company form and may end a sentence: "e. V.", "m. b. H.".
FORM_ENDS = {("e", "v"), ("b", "h")}
GERMAN_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()

CLOSERS = "\"'”’»」』）)\\]］】〉》“"
_TAIL = f"[{CLOSERS}]"
_ASIAN = "。！？｡．"
_ALWAYS = "।॥؟۔"
_THAI = "฀-๿"
_EVENT = re.compile(
    "(?P<brk>\n[^\\S\n]*\n\\s*)"
    f"|(?P<asian>[{_ASIAN}]+[!?.…]*)"
    f"|(?P<stop>[.!?…{_ALWAYS}]+)"
    "|(?P<quote>[\"“”„«»「」『』])"
    f"|(?P<thai>(?<=[{_THAI}0-9])[ \t\n\xa0]+(?=[{_THAI}]))"
)
_BEFORE = re.compile("[^\\s(\\[{\"“”„«»「『‘—]+$")
_NEXT = re.compile(f"(?P<close>[)\\]’'］】）]*)(?P<gap>\\s*)(?P<ch>.?)", re.S)
_ZERO = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_ACRONYM = re.compile("^(?:[^\\W\\d_]\\.)+[^\\W\\d_]$")
_ENUMERATOR = re.compile("^\\(?(?:\\d{1,3}(?:\\.\\d{1,3})*|[IVXLC]{1,6}|[A-Za-z])$")
_GERMAN_DATE = re.compile(f"\\s+(?:{'|'.join(GERMAN_MONTHS)})\\b")
_ORDINAL_BEFORE = re.compile("\\b(?:am|vom|dem|im|zum|des)\\s+$")
_STARTS = set("\"“„«「『‘¿¡([{§•·–—*#<")

# States: no open quotation, or the kind of the open one.
OUT, DOUBLE, CURLY, LOW, GUILLEMET, CORNER = range(6)
STATES = 6
# Symbols.
(BREAK, STOP, DQ_OPEN, DQ_CLOSE, DQ_CLOSE_END, DQ_EITHER, LOW_OPEN, CURLY_L, CURLY_L_END, CURLY_R, CURLY_R_END,
 GUIL_OPEN, GUIL_CLOSE, GUIL_CLOSE_END, CORNER_OPEN, CORNER_CLOSE, CORNER_CLOSE_END) = range(17)
SYMBOLS = 17


def compiled() -> tuple[list[list[int]], list[list[bool]]]:
    """The transducer: next state and output by state and symbol."""
    nxt = [[s] * SYMBOLS for s in range(STATES)]
    out = [[False] * SYMBOLS for _ in range(STATES)]
    for s in range(STATES):
        nxt[s][BREAK], out[s][BREAK] = OUT, True
    out[OUT][STOP] = True

    def opens(symbol: int, state: int) -> None:
        nxt[OUT][symbol] = state

    def closes(symbol: int, *states: int, end: bool = False) -> None:
        for s in states:
            nxt[s][symbol], out[s][symbol] = OUT, end

    opens(DQ_OPEN, DOUBLE)
    opens(DQ_EITHER, DOUBLE)
    closes(DQ_CLOSE, DOUBLE)
    closes(DQ_EITHER, DOUBLE)
    closes(DQ_CLOSE_END, DOUBLE, OUT, end=True)
    opens(LOW_OPEN, LOW)
    opens(CURLY_L, CURLY)
    closes(CURLY_L, LOW)
    opens(CURLY_L_END, CURLY)
    closes(CURLY_L_END, LOW, end=True)
    closes(CURLY_R, CURLY, LOW)
    closes(CURLY_R_END, CURLY, LOW, OUT, end=True)
    opens(GUIL_OPEN, GUILLEMET)
    closes(GUIL_CLOSE, GUILLEMET)
    closes(GUIL_CLOSE_END, GUILLEMET, OUT, end=True)
    opens(CORNER_OPEN, CORNER)
    closes(CORNER_CLOSE, CORNER)
    closes(CORNER_CLOSE_END, CORNER, end=True)
    return nxt, out


NEXT_STATE, ENDS = compiled()


def _caseless(ch: str) -> bool:
    return ch.isalpha() and ch.lower() == ch.upper()


_BRACKETED = re.compile("[(\\[][^\\W\\d_](?![)\\]])")


def _may_start(ch: str, text: str = "", at: int = 0) -> bool:
    if ch in "([" and text and (m := _BRACKETED.match(text, at)) and m.group()[1].islower():
        return False
    return ch.isupper() or ch.istitle() or ch in _STARTS or _caseless(ch)


def _word_before(text: str, at: int) -> str:
    m = _BEFORE.search(text, max(0, at - 48), at)
    return m.group() if m else ""


def _ends(text: str, start: int, end: int) -> bool:
    """Whether the run of stops ``text[start:end]`` ends a sentence outside quotations."""
    m = _NEXT.match(text, end)
    ch, gap = m.group("ch"), m.group("gap")
    if not ch:
        return True
    starts = _may_start(ch, text, m.start("ch"))
    last = text[end - 1]
    if last in _ALWAYS:
        return True
    if gap and ch.islower():
        return False
    mark = text[start:end]
    if "!" in mark or "?" in mark:
        return (gap != "" and (starts or ch.isdigit())) or (not gap and ch not in CLOSERS and starts)
    if len(mark) > 1 or mark == "…":
        # A pause stands free; an ellipsis at the end of a sentence touches its word.
        return bool(gap) and starts and start > 0 and not text[start - 1].isspace()
    word = _word_before(text, start)
    if not word:
        return bool(gap) and starts
    low = _ZERO.sub("", word).lower().lstrip("'’")
    if not gap:
        if not starts or m.group("close"):
            return bool(m.group("close")) and starts
        tail = low.rpartition(".")[2]
        if text[max(0, start - len(word) - 1)] in "{<":
            return False
        return len(tail) > 1 and tail not in TITLES and low not in NEVER_LAST and not _ACRONYM.match(word)
    if low in NEVER_LAST or low in TITLES or low.rpartition(".")[2] in TITLES and len(low.rpartition(".")[2]) > 1:
        return False
    if ch.isdigit():
        if low in BEFORE_NUMBER:
            return False
    elif not starts:
        return False
    tail = word.rpartition(".")[2]
    if len(tail) == 1 and tail.isalpha():
        if _ACRONYM.match(word):
            return True
        before = text[max(0, start - 16) : start - len(tail)].split()
        if before and (before[-1].rstrip(".").lower()[-1:], tail.lower()) in FORM_ENDS and before[-1].endswith("."):
            return True
        return False
    if low in BEFORE_NUMBER and re.match("[IVXLC]+\\b|[A-Z]\\b|§", text[end + len(m.group("close")) + len(gap) :][:8]):
        return False
    if _ENUMERATOR.match(word) and not m.group("close"):
        opened = start - len(word)
        while opened > 0 and text[opened - 1] in "([":
            opened -= 1
        lead = text[max(0, opened - 64) : opened]
        bare = lead.rstrip()
        if opened == 0 or not bare:
            return False
        if "\n" in lead[len(bare) :] and (bare[-1] in ".!?:;…。！？" + _ALWAYS or bare[-1] in CLOSERS.replace("\\", "") or "\n\n" in lead[len(bare) :].replace(" ", "")):
            return False
    if word.isdigit() and len(word) <= 2:
        if _GERMAN_DATE.match(text, end) or (ch.isupper() and _ORDINAL_BEFORE.search(text, max(0, start - 24), start - len(word))):
            return False
    return True


def _quote_symbol(text: str, at: int) -> int:
    q = text[at]
    after = text[at + 1 : at + 2]
    if q == "„":
        return LOW_OPEN
    if q in "「『":
        return CORNER_OPEN
    if q == "«":
        return GUIL_OPEN
    back = at - 1
    while back >= 0 and at - back < 8 and text[back].isspace():
        back -= 1
    stopped = back >= 0 and text[back] in ".!?…" + _ASIAN + _ALWAYS
    ended = False
    if stopped:
        m = _NEXT.match(text, at + 1)
        ch = m.group("ch")
        ended = not ch or (m.group("gap") != "" and (ch.isupper() or ch in _STARTS or ch.isdigit()))
        if not ended and not m.group("gap") and ch.isupper():
            ended = True
    if q == "“":
        return CURLY_L_END if ended else CURLY_L
    if q == "”":
        return CURLY_R_END if ended else CURLY_R
    if q == "»":
        return GUIL_CLOSE_END if ended else GUIL_CLOSE
    if q in "」』":
        m = _NEXT.match(text, at + 1)
        return CORNER_CLOSE_END if stopped and "\n" in m.group("gap") else CORNER_CLOSE
    before = text[at - 1] if at else " "
    opening = after.isalnum() or after in set("¿¡")
    if before.isspace() or before in "([{—–":
        return DQ_OPEN if opening or not ended else DQ_CLOSE_END
    if opening:
        return DQ_EITHER
    return DQ_CLOSE_END if ended else DQ_CLOSE


def symbols(text: str) -> Iterator[tuple[int, int, int]]:
    """``(position, symbol, end of the sentence if it ends here)`` for the marks of ``text`` in order."""
    for m in _EVENT.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "brk":
            yield start, BREAK, start
        elif kind == "quote":
            close = re.match("[)\\]’'］）]*", text[end : end + 8]).end()
            yield start, _quote_symbol(text, start), end + close
        elif kind == "thai":
            yield start, STOP, start
        elif kind == "asian":
            m2 = re.match("[’'）)\\]］】]*", text[end : end + 8])
            yield start, STOP, end + m2.end()
        elif _ends(text, start, end):
            close = re.match("[)\\]’'］）]*", text[end : end + 8]).end()
            yield start, STOP, end + close


SAME = tuple(range(STATES))
#: The functions met so far, by what the next symbol makes of them. There are finitely many, and texts use few.
_AFTER: dict[tuple[int, ...], list[tuple[int, ...] | None]] = {}
Event = tuple[int, int, int]


def function_of(events: list[Event]) -> tuple[int, ...]:
    """The function from states to states that a stretch of marks has."""
    f = SAME
    for _, symbol, _ in events:
        row = _AFTER.setdefault(f, [None] * SYMBOLS)
        g = row[symbol]
        if g is None:
            g = row[symbol] = tuple(NEXT_STATE[s][symbol] for s in f)
        f = g
    return f


def outputs(events: list[Event], state: int) -> list[int]:
    """Where sentences end in a stretch of marks that begins in ``state``."""
    found = []
    for _, symbol, end in events:
        if ENDS[state][symbol]:
            found.append(end)
        state = NEXT_STATE[state][symbol]
    return found


def compose_scan(functions: list[tuple[int, ...]]) -> np.ndarray:
    """The state in which each chunk begins, from the chunks' functions, by parallel prefix doubling."""
    scan = np.array(functions, dtype=np.int64).reshape(-1, STATES)
    step = 1
    while step < len(scan):
        scan[step:] = np.take_along_axis(scan[step:], scan[:-step].copy(), axis=1)
        step *= 2
    return np.concatenate([[OUT], scan[:-1, OUT]])


def spans(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """Trimmed sentence spans between the ``ends``; blank ones are left out."""
    found, start = [], 0
    for end in [*ends, len(text)]:
        if end <= start:
            continue
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            found.append((a, b))
        start = end
    return found


#: Code points of a chunk, and of a part that is read by one task.
CHUNK, PART = 1 << 11, 1 << 20
#: Code points on either side of a part that classify its marks. The later side goes on behind white space and stops.
MARGIN = 512


def _chunked(text: str, begin: int, stop: int, chunk: int) -> list[list[Event]]:
    """The marks at positions ``begin <= p < stop`` by chunk."""
    chunks: list[list[Event]] = [[] for _ in range(max(1, -(-(stop - begin) // chunk)))]
    for event in symbols(text):
        if event[0] >= stop:
            break
        if event[0] >= begin:
            chunks[(event[0] - begin) // chunk].append(event)
    return chunks


def segment(text: str, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """Sentence spans of one text: its chunks as functions, composed, then the output of each chunk."""
    chunks = _chunked(text, 0, len(text), chunk)
    entry = compose_scan([function_of(c) for c in chunks]) if len(chunks) > 1 else [OUT]
    return spans(text, [end for c, state in zip(chunks, entry) for end in outputs(c, state)])


def _read_on(text: str, stop: int) -> int:
    """Where the context of marks before ``stop`` ends: ``MARGIN`` behind the white space and stops there."""
    end = stop
    while end < len(text) and (text[end].isspace() or text[end] in ".!?…。！？｡．" + _ALWAYS):
        end += 1
    return min(len(text), end + MARGIN)


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """The sentences of every document: ``<id>``, ``sent_no``, ``text``, ``start_char``, ``end_char``.

    Offsets count code points of the stored text, ends are exclusive, white space around a sentence is outside.
    Null, empty and blank texts and rows without id give no rows. Repeated rows give repeated sentences for texts of up to
    ``part`` code points; longer documents are told apart by their id and text, and read by several tasks. The result is
    the same for every ``chunk`` and ``part``. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t")).where("__id is not null and __t is not null")
    id_type = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {id_type}, sent_no int, text string, start_char int, end_char int"

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (i, k, t[a:b], a, b)
                for i, t in zip(batch["__id"], batch["__t"])
                for k, (a, b) in enumerate(segment(t, chunk))
            ]
            yield pd.DataFrame(out, columns=["__id", "sent_no", "text", "start_char", "end_char"])

    few = rows.where(F.length("__t") <= part).mapInPandas(short, schema)
    many = _long(rows.where(F.length("__t") > part), chunk, part)
    return few.unionByName(many).withColumnRenamed("__id", id_col)


def _long(rows: DataFrame, chunk: int, part: int) -> DataFrame:
    """Sentences of documents longer than one part."""
    keyed = rows.withColumn("__key", F.xxhash64("__id", "__t"))
    pieces_type = T.ArrayType(T.StructType([
        T.StructField("no", T.IntegerType()), T.StructField("low", T.IntegerType()), T.StructField("begin", T.IntegerType()),
        T.StructField("stop", T.IntegerType()), T.StructField("part", T.StringType()),
    ]))
    runs = T.StructType([T.StructField("function", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.ArrayType(T.IntegerType())))])

    @F.pandas_udf(pieces_type)
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rows = []
            for no, begin in enumerate(range(0, len(t), part)):
                low, stop = max(begin - MARGIN, 0), min(begin + part, len(t))
                rows.append({"no": no, "low": low, "begin": begin - low, "stop": stop - low, "part": t[low : _read_on(t, stop)]})
            out.append(rows)
        return pd.Series(out)

    @F.pandas_udf(runs)
    def read(low: pd.Series, begin: pd.Series, stop: pd.Series, text: pd.Series) -> pd.DataFrame:
        numbers, ends = [], []
        for lo, a, b, t in zip(low, begin, stop, text):
            chunks = _chunked(t, a, b, chunk)
            whole: tuple[int, ...] = SAME
            by_state: list[list[int]] = [[] for _ in range(STATES)]
            for c in chunks:
                f = function_of(c)
                for s in range(STATES):
                    by_state[s] += [int(lo) + e for e in outputs(c, whole[s])]
                whole = tuple(f[s] for s in whole)
            numbers.append(whole)
            ends.append(by_state)
        return pd.DataFrame({"function": numbers, "ends": ends})

    done = keyed.dropDuplicates(["__key"]).select("__key", F.explode(cut("__t")).alias("p"))
    done = done.select("__key", "p.no", read("p.low", "p.begin", "p.stop", "p.part").alias("r"))

    def scan(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("no")
        entry = compose_scan([tuple(f) for f in batch["function"]])
        ends = [int(e) for s, per in zip(entry, batch["ends"]) for e in per[s]]
        return pd.DataFrame({"__key": [batch["__key"].iloc[0]], "ends": [ends]})

    ends = done.select("__key", "no", "r.function", "r.ends").groupBy("__key").applyInPandas(scan, "__key long, ends array<int>")

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])))
    def between(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in spans(t, list(e))] for t, e in zip(text, at)])

    return (
        keyed.join(ends, "__key")
        .select("__id", "__t", F.posexplode(between("__t", "ends")).alias("sent_no", "s"))
        .select(
            "__id",
            "sent_no",
            F.expr("substring(__t, s.a + 1, s.b - s.a)").alias("text"),
            F.col("s.a").alias("start_char"),
            F.col("s.b").alias("end_char"),
        )
    )
