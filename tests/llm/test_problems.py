"""The training-data operators on small fixtures, against brute force, and on odd inputs."""

import functools
import itertools
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinleaf.llm import leakage, neighbours, normalizing, packing, residue, scans, sentences, splitting

LONG = ("The clause on page one stays. " * 400) + "x" * 3000 + " end."


def texts(spark, values, extra=True):
    rows = [(i, t, "a", "b") for i, t in enumerate(values)]
    rows.append((None, "A row without id. {{ slot }}", None, None))
    schema = "doc_id long, text string, kind string, slot string" if extra else "doc_id long, text string"
    return spark.createDataFrame(rows if extra else [r[:2] for r in rows], schema)


ODD = [None, "", "   \n ", "a", LONG, LONG, "Ünï\u0000code \U0001f600 end."]


# 1


def brute_cut(text, max_len, overlap):
    """Least cost of cutting ``text``, by trying every candidate as the next cut."""
    n, advance = len(text), max_len - overlap
    at, penalty = (x.tolist() for x in splitting._candidates(text, advance))
    ideal = (n - overlap) / -(-(n - overlap) // advance)

    @functools.cache
    def rest(start):
        if start == n:
            return 0.0
        costs = []
        for p, c in zip(at, penalty):
            begin = start - overlap if start else 0
            if p > start and p - begin <= max_len and (p == n or p >= overlap):
                gain = p - (start or overlap)
                own = splitting.IMBALANCE * ((gain - ideal) / advance) ** 2 + splitting.PER_PIECE
                costs.append(own + (c if p < n else 0.0) + rest(p))
        return min(costs, default=float("inf"))

    return rest(0)


def cost_of(text, pieces, max_len, overlap):
    n, advance = len(text), max_len - overlap
    at, penalty = splitting._candidates(text, advance)
    by = dict(zip(at.tolist(), penalty.tolist()))
    ideal = (n - overlap) / -(-(n - overlap) // advance)
    out, previous = 0.0, 0
    for _, e in pieces:
        gain = e - (previous if previous else overlap)
        out += splitting.IMBALANCE * ((gain - ideal) / advance) ** 2 + splitting.PER_PIECE + (by[e] if e < n else 0)
        previous = e
    return out


@pytest.mark.parametrize("text", ["One two. Three four, five six; seven eight nine ten.", "word " * 9, "a b, c d. " * 4])
def test_cut_is_least_cost(text):
    pieces = splitting.cut(text, 24, 4)
    assert cost_of(text, pieces, 24, 4) == pytest.approx(brute_cut(text, 24, 4))


@given(st.text(alphabet="ab ,.;\ń", min_size=0, max_size=400))
@settings(max_examples=60, deadline=None)
def test_cut_round_trip(text):
    pieces = splitting.cut(text, 50, 10)
    assert all(b - a <= 50 for a, b in pieces)
    joined = text[pieces[0][0] : pieces[0][1]]
    for (_, end), (a, b) in itertools.pairwise(pieces):
        assert a == end - 10 and b > end
        joined += text[end:b]
    assert joined == text


def test_split_odd_inputs(spark):
    df = texts(spark, ODD).withColumn("piece_no", F.lit("clash"))
    rows = splitting.split_oversized(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].piece_text.startswith("A row")
    assert by[0][0].piece_text is None and not by[0][0].is_oversized
    assert by[1][0].piece_text == "" and by[3][0].piece_text == "a"
    assert len(by[4]) == len(by[5]) > 20 and all(r.piece_length <= 500 for r in by[4])
    assert splitting.split_oversized(df.limit(0)).count() == 0


# 2


SENTENCES = [
    ("Dr. A. Brown paid EUR 1.50 to X Ltd. The rest is due on Jan. 5, 2031.", 2),
    ('The clerk wrote: "He left. It rained." and closed the file. "Stop!" said Mr. Gray at 5 p.m. on Monday.', 2),
    ("The notice reads, “We go. We stay.” Next one.", 2),
    ("Die Frist beginnt am 20. Mai 2023, z. B. den Plan. Hr. K. Holm e. V. teilen es. Norpim Ges. m. b. H. Die Frist.", 4),
    ("„Halt!“ rief Fr. Orrode. Der Zeuge ... schwieg.", 2),
    ("« Arrêtez ! » dit Me Roy, c.-à-d. avant le 5 mai. Qui paie ? La caution.", 3),
    ("«¡Alto!» dijo Sr. Gil (v. el n.º 72). ¿Quién paga? El fiador.", 3),
    ("С учётом пп. 8 п. 60 плата включает залог, в т. ч. опись. Кто платит?", 2),
    ("“停止！”调解人说。书记员记录：“未到庭。保留。”随后归档。", 2),
    ("「中止せよ！」と述べた。書記は「残す。」と記した。利息は4.5とする。", 3),
    ("ब्याज 6.2 प्रतिशत लगेगा। क्या क्रेता ने सूची प्राप्त किया? हाँ।", 3),
    ("تسري الفائدة بنسبة 5.4 في المئة. هل استلم المشتري العقار؟ فحص د. Roy العقار.", 3),
    ("ดอกเบี้ยคิดร้อยละ8.4ต่อปี ผู้เช่าต้องชำระเงิน10.5บาท", 2),
    ("1. The first holds.\n2. The second holds.\nII.\nThe panel rules.", 3),
    ("Term and Renewal\n\nThe lease ends.The file closes (see para. 3). Done.", 4),
]


@pytest.mark.parametrize(("text", "n"), SENTENCES)
def test_segment(text, n):
    found = sentences.segment(text)
    assert len(found) == n, [text[a:b] for a, b in found]


def test_scan_composes_functions():
    rng = np.random.default_rng(3)
    chosen = [tuple(f) for f in rng.integers(0, sentences.STATES, size=(37, sentences.STATES)).tolist()]
    state, expected = sentences.OUT, []
    for f in chosen:
        expected.append(state)
        state = f[state]
    assert sentences.compose_scan(chosen).tolist() == expected


def test_functions_are_those_of_the_transducer():
    rng = random.Random(6)
    for _ in range(200):
        events = [(k, rng.randrange(sentences.SYMBOLS), k + 1) for k in range(rng.randrange(30))]
        f = sentences.function_of(events)
        for s in range(sentences.STATES):
            state = s
            for _, symbol, _ in events:
                state = sentences.NEXT_STATE[state][symbol]
            assert f[s] == state


def test_sentences_in_chunks(spark):
    text = " ".join(t for t, _ in SENTENCES) * 30
    blank = "One ends here." + " " * 1500 + "\n" * 700 + "Two ends here" + "." * 900 + " Three “quotes. Four" + " " * 2000 + "ends.” Five."
    df = texts(spark, [text, "Short one. Two.", None, "  ", "", blank, text, "no stop"])
    whole = sentences.sentence_units(df, chunk=1 << 20).orderBy("doc_id", "sent_no").collect()
    assert {r.doc_id for r in whole} == {0, 1, 5, 6, 7}
    assert all(text[r.start_char : r.end_char] == r.text for r in whole if r.doc_id == 0)
    for chunk, part in ((2048, 1 << 20), (300, 1 << 20), (64, 700), (5, 1500), (2048, 2049)):
        parts = sentences.sentence_units(df, chunk=chunk, part=part).orderBy("doc_id", "sent_no").collect()
        assert whole == parts, (chunk, part)
    assert sentences.sentence_units(df.limit(0)).count() == 0


@given(st.text(alphabet="ab.A \n“”\"1?!…)", max_size=300), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_segment_is_the_same_for_every_chunk(text, chunk):
    assert sentences.segment(text, chunk) == sentences.segment(text, 1 << 20)


# 3


@given(st.text(alphabet="aeo ́̈ ​­ｅЕеοѕéëё２²ﬁ．-", max_size=40))
@settings(max_examples=300, deadline=None)
def test_consistent_form(text):
    out = normalizing.consistent(text)
    assert normalizing.consistent(out) == out
    assert unicodedata.is_normalized("NFC", out)
    # Splicing segments gives what the whole text at once gives.
    assert out == normalizing._canonical(text)


def test_consistent_pairs():
    same = [("ｔｈｅ", "the"), ("café", "café"), ("a b", "a b"), ("ѕeа", "sea"), ("ѐ", "è"), ("o­k​", "ok")]
    same += [("𝐚𝑏", "ab"), ("ᴏk", "ok"), ("ᎪꓐⲞ", "ABO"), ("ﬁle", "file"), ("Ⅳ", "IV"), ("⼀", "一"), ("ﺍ", "ا")]
    assert all(normalizing.consistent(a) == normalizing.consistent(b) for a, b in same)
    other = [("α-particle", "a-particle"), ("κ", "k"), ("①", "1"), ("…", "..."), ("Ω", "O"), ("m²", "m2"), ("A", "a"), ("é", "e"), ("a.", "a!"), ("٣", "3"), ("“a”", '"a"')]
    assert all(normalizing.consistent(a) != normalizing.consistent(b) for a, b in other)


def test_quick_check_finds_all_that_changes():
    """Every assigned character that combines or changes when composed is looked at."""
    for p in range(0x80, 0x10000):
        c = chr(p)
        if not 0xD800 <= p < 0xE000 and (unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c)):
            assert normalizing._RUN.match(c), hex(p)


def test_matches_odd_inputs(spark):
    schema = "match_id long, sent1 struct<text:string>, sent2 struct<text:string>, exact_match boolean, normalized_match boolean, text1 string"
    rows = [(1, (None,), ("a",), False, False, "x"), (2, ("",), ("",), True, True, None), (3, ("А",), ("A",), False, None, "")]
    df = spark.createDataFrame([*rows, rows[2], (4, None, None, None, None, None)], schema)
    got = {r.match_id: (r.exact_match, r.normalized_match) for r in normalizing.normalized_matches(df).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (True, True), 4: (False, False)}
    assert normalizing.normalized_matches(df.limit(0)).count() == 0


# 4


def clustered(n, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 25), dim))
    return centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, dim))


def brute_neighbours(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return [set(np.argsort(-row)[:k].tolist()) for row in s]


@pytest.mark.parametrize(("max_bucket", "levels"), [(20_000, 5), (40, 5), (30, 0)])
def test_neighbours_recall(spark, max_bucket, levels):
    x = clustered(1200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df, max_bucket=max_bucket, levels=levels, tables=6, probes=3).collect()
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, set()).add(r.other_id)
    true = brute_neighbours(x, 5)
    recall = sum(len(got.get(i, set()) & t) for i, t in enumerate(true)) / (5 * len(true))
    assert recall >= 0.9
    assert all(len(v) <= 5 for v in got.values())


@pytest.mark.parametrize("max_bucket", [20_000, 100, 20])
def test_neighbours_recall_of_default(spark, data, max_bucket):
    """The shipped tables and probes, over the stored vectors."""
    table = spark.read.parquet(f"{data}/sentence_vector.parquet")
    x = clustered(2500, seed=11)
    df = spark.createDataFrame([(10**9 + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df.unionByName(table.select("vec_id", "embedding")), max_bucket=max_bucket).where("vec_id >= 1000000000").collect()
    got = {}
    for r in rows:
        got.setdefault(r.vec_id - 10**9, set()).add(r.other_id - 10**9)
    true = brute_neighbours(x, 5)
    assert sum(len(got.get(i, set()) & t) for i, t in enumerate(true)) / (5 * len(true)) >= 0.9


def test_neighbours_recall_of_parted_cluster(spark):
    """A third of all vectors around one centre, in groups of near copies, parted at 2 % of the rows, as in production."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    groups = centre / np.linalg.norm(centre) + 0.45 * rng.normal(size=(250, 64)) / 8
    hot = np.repeat(groups, 8, axis=0) + 0.4 * rng.normal(size=(2000, 64)) / 8
    x = np.vstack([hot, clustered(4000, seed=8)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, max_bucket=120).where("vec_id < 2000").collect():
        got.setdefault(r.vec_id, set()).add(r.other_id)
    true = brute_neighbours(x, 5)[:2000]
    assert sum(len(got.get(i, set()) & t) for i, t in enumerate(true)) / (5 * 2000) >= 0.9


def test_neighbours_copies_and_unusable(spark):
    x = clustered(40, seed=4)
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    rows += [(100 + i, (x[0] * (i + 1)).tolist(), None) for i in range(8)]  # one direction, many lengths
    rows += [(1, x[1].tolist(), "again"), (200, None, ""), (201, [0.0] * 64, ""), (202, [1.0], ""), (203, [float("nan")] * 64, "")]
    rows += [(204, [None] * 64, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, unit string")
    got = {}
    for r in neighbours.nearest(df).orderBy("vec_id", "place").collect():
        got.setdefault(r.vec_id, []).append((r.other_id, round(r.similarity, 5)))
    assert not {200, 201, 202, 203, 204} & set(got)
    assert [o for o, _ in got[107]] == [0, 100, 101, 102, 103]
    assert [o for o, _ in got[0]] == [100, 101, 102, 103, 104]
    assert all(s == 1.0 for _, s in got[0])
    assert neighbours.nearest(df.limit(0)).count() == 0
    pairs = neighbours.neighbour_pairs(neighbours.nearest(df)).collect()
    assert all(p.vec_a < p.vec_b for p in pairs) and len(set(pairs)) == len(pairs)


# 5


CLEAN = [
    "The tenant shall pay the deposit within ten days of the notice.",
    "The landlord keeps the boundary wall in good order until the end of the year.",
    "A third-party buyer must not assign the storage contract to the employer.",
    "The registry recorded the access road under the schedule of the annex.",
    "The carrier bears the cost of the inventory list and the security interest.",
    "What the court decides about the repair estimate binds the supplier and the buyer.",
]
SCAN = [
    "The tenant shall pay the dep0sit within ten days of\nthe notice.",
    "Ref. ABC/12/345\nThe landlord keeps the boundary wall in good or-\nder until the end of the year.",
    "A third-\nparty buyer must not assign the storage contract\n— 3 —\nto the ernployer.",
    "Ref. ABC/12/345",
    "Room B12 and Annex 3A: the registry recorded the acc¬\ness road under the schedule of the ann-",
    "ex.\nThe carrier bears the cost of the inventory list and\nthe security intcrest.",
    "Page 3 of the schedule binds the buyer and the cost\nof 2O31.",
]


def scan_tables(spark):
    rows, schema = [], "doc_id long, seq int, text string, start_char int, end_char int, kind string"
    for d in range(1, 41):
        for q, t in enumerate(CLEAN):
            rows.append((d, q, t, q * 100, q * 100 + 90, "x"))
            rows.append((d, q + 10, f"The cost of {d} is due in 20{q}1 of the year.", q * 100, q * 100 + 90, "x"))
    for q, t in enumerate(SCAN):
        rows.append((99, q, t, q * 100, q * 100 + 99, None))
    rows += [rows[-1], (99, 50, None, 0, 0, ""), (99, 60, "", None, None, ""), (None, 1, "x", 0, 0, ""), (98, 1, LONG, 0, 9, "")]
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 2, 3), (2, None, 4)], "pair_id long, doc_id1 long, doc_id2 long")


def test_scan_repair(spark):
    units, pairs = scan_tables(spark)
    fixed = {r.seq: r for r in scans.repaired_units(units).where("doc_id = 99").collect()}
    assert fixed[0].text == CLEAN[0] and fixed[0].misread and not fixed[0].hyphen and not fixed[0].furniture
    assert fixed[1].text == CLEAN[1] and fixed[1].hyphen and fixed[1].furniture
    assert fixed[2].text == CLEAN[2] and not fixed[2].hyphen and fixed[2].furniture and fixed[2].misread
    assert fixed[3].text == "" and fixed[3].furniture
    assert fixed[4].text.endswith("the access road under the schedule of the annex.") and fixed[4].hyphen and not fixed[4].misread
    assert fixed[5].text == CLEAN[4] and fixed[5].misread and not fixed[5].hyphen
    assert fixed[6].text.endswith("of 2031.") and not fixed[6].furniture
    found = {(r.doc_id, r.seq, r.kind) for r in scans.noise_found(units, pairs).collect()}
    assert {d for d, _, _ in found} == {99} and (99, 1, "hyphen") in found and (99, 3, "furniture") in found
    paired = pairs.unionByName(spark.createDataFrame([(3, 99, 1)], pairs.schema))
    assert scans.noise_found(units, paired).count() == 0
    assert "security interest." in " ".join(r.text for r in scans.paragraphs(units).where("doc_id = 99").collect())
    assert scans.noise_found(units.limit(0), pairs).count() == 0


def test_scan_candidate_of_its_neighbours():
    # Eight more usual words stand before the one that only the word before it favours.
    usual = dict.fromkeys("ebcbcb chcbcb cbebcb cbchcb cbcbeb ehcbcb ebebcb ebchcb".split(), 1000)
    channel = scans.Channel(1_000_000, usual | {"pay": 10, "cbcbch": 10}, {"pay cbcbch": 10})
    assert {w for w, _ in channel.candidates("cbcbcb", "pay")} == {"cbcbcb", "cbcbch", *usual}
    assert channel.decode(["pay", "cbcbcb"]) == [None, "cbcbch"]


def test_running_headers(spark):
    body = ["The carrier bears the cost of the inventory", "list until the end of the year and no longer", "than that, and the tenant pays the rent in"]
    short, wide = "Lease of Roe and Doe", "The tenant shall pay the whole rent in advance"
    rows = [(1, q, "\n".join([*body, short, *body])) for q in range(3)]  # recurs between lines, short of the width
    rows += [(2, q, "\n".join([*body, wide, *body])) for q in range(2)]  # text that happens to recur
    rows += [(3, 0, body[0] + "\nDeed of Roe"), (3, 1, "Deed of Roe"), (4, 0, body[0] + "\nDeed of Roe   7"), (4, 1, body[1] + "\nDeed of Roe   8")]
    rows += [(5, q, f"Deed number {q} of Roe\n" + body[0]) for q in range(3)]  # each only once
    df = spark.createDataFrame(rows, "doc_id long, seq int, text string")
    found = {(r.doc_id, r.head) for r in scans.running_headers(df).collect()}
    assert found == {(1, short), (3, "Deed of Roe"), (4, "Deed of Roe")}
    assert scans.running_headers(df.limit(0)).count() == 0


def test_word_counts_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"The rent of {i} is due, the rent is paid.") for i in range(50)], "doc_id long, text string")
    whole = scans.word_counts(df)
    assert whole.words["rent"] == 100 and whole.words["<num>"] == 50 and whole.pairs["the rent"] == 100 and whole.pairs["due the"] == 50
    monkeypatch.setattr(scans, "COUNTED", 1)
    tables = list(scans._tallied(iter([df.select("text").toPandas()] * 3)))
    assert len(tables) == 3 and sum(t.loc[t.gram == "rent", "n"].sum() for t in tables) == 300


def test_scan_repair_with_rare_words(spark, monkeypatch):
    # Whether words and pairs are sent to all workers or looked up for the text that asks for them changes nothing.
    units, _ = scan_tables(spark)
    odd = ["The dep|0sit of the ten-\nant and the land-\nlo-\nrd is in the annnex of 2O31.", "the boun‑\ndary wal1 | of the third-\nparty-\nbuyer~", "\n \nINVENT0RY lis+ of the ernpl0yer."]
    rows = [(99, 5000 * k + q, t, q, q, None) for k in (1, 2) for q, t in enumerate(odd)]
    units = units.unionByName(spark.createDataFrame(rows, units.schema))
    told = {}
    for kept in (0.0, 1e-3, 1.0):
        monkeypatch.setattr(scans, "KEPT", kept)
        told[kept] = sorted(scans.repaired_units(units).collect(), key=lambda r: (r.doc_id, r.seq))
    assert sum(r.misread for r in told[0.0]) >= 5 and any("deposit" in r.text for r in told[1.0])
    assert told[0.0] == told[1e-3] == told[1.0]


LETTERS = "abcdeghilmnorstuvwz013!@|$€+~-ñя"


@given(st.text(LETTERS, min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_rare_words_are_found_by_their_keys(word):
    reached = scans.Channel._reached(word)
    keys = set(scans.skeletons(word))
    assert all(scans.skeleton(x) in keys for x in reached)
    near = {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in "aeя"} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in "aeя"} | {word[:k] + word[k + 1 :] for k in range(len(word))}
    known = dict.fromkeys((near | set(list(reached)[:200])) - {word, ""}, 9)
    usual, rare = scans.Channel(1000, known, {}), scans.Channel(1000, {}, {})
    rare.take(known)
    for name in ("r", "e") if word.isalpha() else ("r",):
        assert rare._remembered(name, word) == usual._remembered(name, word)


def test_edits_are_all_near_words():
    words = dict.fromkeys("tenant tenants tonant rental entire tenan café cafés".split(), 9)
    channel = scans.Channel(1000, words, {})
    assert set(channel._edited("tenant")) == {"tenants", "tonant", "tenan"}
    assert set(channel._edited("cafés")) == {"café"} and set(channel._edited("tenannt")) == {"tenant"}


# 6


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=60, deadline=None)
def test_pack(sizes):
    at = packing.pack(np.array(sizes, dtype=np.int64), 40)
    assert len(at) == len(sizes)
    fill = np.bincount(at, weights=sizes) if sizes else np.array([])
    assert (fill <= 40).all() and (fill > 0).all()


def brute_pack(sizes, capacity):
    """Sum of squares, stated directly."""
    fills, out = [], []
    for s in sizes:
        def squares(f):
            counts = {}
            for x in f:
                if 0 < x < capacity:
                    counts[x] = counts.get(x, 0) + 1
            return sum(c * c for c in counts.values())

        best = None
        for gap in sorted({capacity - f for f in fills if capacity - f >= s} | {capacity}):
            trial = list(fills)
            if gap == capacity:
                trial.append(s)
            else:
                trial[next(i for i, f in enumerate(trial) if capacity - f == gap)] += s
            if best is None or squares(trial) < best[0]:
                best = (squares(trial), trial)
        fills = best[1]
        out.append(sorted(fills))
    return sorted(fills)


def test_pack_against_direct_statement():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 12) for _ in range(30)]
        at = packing.pack(np.array(sizes), 12)
        assert sorted(np.bincount(at, weights=sizes).astype(int).tolist()) == brute_pack(sizes, 12)


def test_packed_documents(spark):
    rng = random.Random(1)
    df = texts(spark, [*ODD, *["word " * rng.randint(1, 900) for _ in range(300)]])
    rows = packing.packed(df.unionByName(df.limit(3)), share=60).collect()
    by = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r)
    assert {r.doc_id for r in by.pop(None)} == {0, 1}
    assert all(sum(r.tokens for r in rs) <= 2048 for rs in by.values())
    total = sum(r.tokens for r in rows)
    counted = packing.token_counts([r.text or "" for r in df.where("doc_id is not null").orderBy("doc_id").collect()], packing.VOCABULARY)
    assert total == sum(counted) and len({(r.doc_id, r.part) for r in rows}) == len(rows)
    assert all(counted[r.doc_id] > 2048 for r in rows if r.part > 0)
    assert len(by) <= 1.1 * (total / 2048) + 4
    assert packing.packed(df.limit(0)).count() == 0


# 7


def item_text(k):
    rng = random.Random(k)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randint(0, 30)) for _ in range(60))


def test_leakage_against_brute_force(spark):
    rng = random.Random(2)
    items = [(k, item_text(k)) for k in range(30)]
    docs = []
    for k in range(120):
        words = item_text(1000 + k).split()
        if k % 2:
            src = items[rng.randrange(30)][1].split()
            a, n = rng.randrange(40), rng.choice([6, 10, 11, 12, 13, 20])
            words[30:30] = src[a : a + n]
        text = " ".join(words)
        if k % 3 == 0:
            text = text.upper().replace(" ", " \n").replace("A", "А")
        docs.append(text)
    expected = set()
    squeezed = ["".join(leakage.words_of(t)) for t in docs]
    for i, t in items:
        ws = leakage.words_of(t)
        runs = ["".join(ws[k : k + 12]) for k in range(len(ws) - 11)]
        expected |= {(d, i) for d, s in enumerate(squeezed) if any(r in s for r in runs)}
    df = texts(spark, docs)
    table = spark.createDataFrame([(*x, "en") for x in items] + [(90, None, ""), (91, "few words", ""), (None, "x", ""), (*items[0], "en")], "item_id long, text string, doc_id string")
    for shard, chars in ((leakage.SHARD, leakage.TASK_CHARS), (900, 20_000)):
        got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, table, shard=shard, task_chars=chars).collect()}
        assert got == expected and expected
    assert leakage.leaked_items(texts(spark, ODD), table).count() == 0
    assert leakage.leaked_items(df.limit(0), table).count() == 0 and leakage.leaked_items(df, table.limit(0)).count() == 0


def index_of(items, run=12):
    own = [leakage.Item(t, run) for _, t in items]
    df = {}
    for x in own:
        for t in np.unique(x.sure).view(np.int64).tolist():
            df[t] = df.get(t, 0) + 1
    average = sum(len(x.words) for x in own) / len(own)
    made = list(leakage.weights(own, [df] * len(own), len(own), average))
    return leakage.ItemIndex([i for i, _ in items], [x.words for x in own], [t for t, _ in made], [w for _, w in made], run)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 1.0])
def test_leakage_skips_nothing(threshold):
    """The cursors give all items, with their scores, that a sum over all postings gives."""
    index = index_of([(k, item_text(k % 150)) for k in range(300)])
    texts = ["".join(item_text(k).split()[:20] + item_text(500 + k).split()[:30]) for k in range(60)]
    text, _, hashes = leakage.terms_of(texts)
    exact, named = {}, set()
    for t, h in zip(text.tolist(), hashes.tolist()):
        k = int(np.searchsorted(index.term, np.uint64(h)))
        if k < len(index.term) and index.term[k] == h and (t, k) not in named:
            named.add((t, k))
            for p in range(index.start[k], index.stop[k]):
                pair = t, int(index.item[p])
                exact[pair] = exact.get(pair, 0.0) + index.weight[p]
    passage, term = (np.array(x) for x in zip(*sorted(named)))
    found = {(int(a), int(b)): s for a, b, s in zip(*index.candidates(passage, term, threshold))}
    assert set(found) == {p for p, x in exact.items() if x >= threshold} and found
    assert all(found[p] == pytest.approx(exact[p]) for p in found)


def test_leakage_run_scores_one():
    index = index_of([(k, item_text(k)) for k in range(80)])
    rng = random.Random(9)
    for _ in range(200):
        k, a = rng.randrange(80), rng.randrange(48)
        text = "".join(item_text(900 + k).split()[: rng.randrange(20)] + item_text(k).split()[a : a + 12] + ["end"] * rng.randrange(9))
        assert k in {i for _, i, _, _ in index.search([text])}


def test_leakage_cost_does_not_grow_with_unrelated_items():
    rng = random.Random(4)

    def odd():
        return " ".join("".join(rng.choice("bcdfghjk") for _ in range(rng.randint(3, 9))) for _ in range(60))

    items = [(k, item_text(k)) for k in range(240)]
    texts = ["".join(item_text(5000 + k).split()) * 4 for k in range(300)]
    few, many = index_of(items), index_of(items + [(1000 + k, odd()) for k in range(5000)])
    assert sorted(few.search(texts)) == sorted(many.search(texts))
    steps = []
    for index in (few, many):
        calls = []
        seek = index._seek
        index._seek = lambda *x, seek=seek, calls=calls: calls.append(x[0].size) or seek(*x)
        list(index.search(texts))
        steps.append(sum(calls))
    assert steps[1] <= 2 * steps[0] + 1000


def test_leakage_of_scripts_without_blanks(spark):
    han = "甲方应当在收到通知之日起十五日内向乙方支付全部剩余款项并承担由此产生的利息费用及违约责任同时提交书面说明材料一式三份"
    rows = [(1, "前言。" + han + "。后记。"), (2, "前言。" + han[3:31] + "。"), (3, "前言。" + han[:20] + "。"), (4, "Something else.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, han), (8, "ข้อความภาษาไทยที่ยาวพอสมควรสำหรับการทดสอบระบบค้นหา")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items).collect()} == {(1, 7), (2, 7)}


# 8


CASES = {
    "The fee of {{ amount }} is due.": "slot", "Signed by [CLIENT NAME] today.": "slot", "The XXXXXX is due.": "slot",
    "El registro anota «importe» hoy.": "slot", "Das Gericht in [Ort eintragen] entscheidet.": "slot", "The [●] is due.": "slot",
    "Lorem ipsum velit quilat opera. Modus lorem taciti ipsum.": "filler", "Sample text goes here. asdf asdf asdf jkl.": "filler",
    "Home | Help | Search\n\nError 404: no se pudo abrir el documento.": "error", "410 Gone\n\nSign in · My files · Help": "error",
    "<html><head><title>503 Service Unavailable</title></head><body>Service Unavailable</body></html>": "error",
    "Please enable JavaScript to read this document.": "script", "JAVASCRIPTを有効にしてください。": "script",
}
TRAPS = [
    "Signed at Dover on 3 May 2031: ____________________.", "The set {a, b, c} of plots is closed.", "It was “verry old” [sic] in para. 58.",
    "The panel relied on A v. B [2031] 4 QLR 118.", "Amounts in [square brackets] are shown net of tax.", "The gap must stay <0.5 mm and >0.1 mm.",
    "If the server returns error 503 the tenant shall extend the deadline by 96 hours.", "« Arrêtez ! » dit Me Roy.",
    "The designer shall replace every lorem ipsum passage of the brochure before 8 January 2024.",
    "Access denied by the supplier without cause counts as a breach of cl. 4. The file stays open.",
    "The user keeps JavaScript enabled while signing in the viewer of Mr. Roy.", "The template in Annex 3 has been filled in by Ms. Roy.",
]


def test_residue(spark):
    df = texts(spark, [*CASES, *TRAPS, *ODD])
    expected = dict(enumerate(CASES.values()))
    rows = residue.template_residue(df.unionByName(df.limit(4))).collect()
    assert {r.doc_id: r.kind for r in rows} == expected and len(rows) == len(expected)
    assert residue.template_residue(df.limit(0)).count() == 0
    kinds = {r.verdict for r in residue.message_templates(df).collect()}
    assert {"error", "script", "filler", "menu"} <= kinds


WRAPPED = [
    "{{ party\n}}", "{% address\n%}", "${governing\nlaw}", "{governing\nlaw}", "<<governing\nlaw>>", "[[client\nname]]",
    "@@client\nname@@", "[\n●]", "<CLIENT\nNAME>", "[party\nTBC]", "[enter governing \n  law here]", "[CLIENT\nNAME]", "«nom\nclient»",
    "Haga clic\naquí para escribir nombre", "Click here\nto enter text", "Klicken Sie\nhier, um Text einzugeben", "cliquez\nici pour saisir",
    "{{ the full name of the party that signs this agreement for\nthe company }}", "[insert the full name of the party that signs for\nthe company and its city]",
]


@pytest.mark.parametrize("slot", WRAPPED)
def test_wrapped_slot(slot):
    assert residue.has_slot(f"The schedule names\n{slot} as the\ncondition.")
    assert residue.has_slot(f"The schedule names {slot.replace(chr(10), chr(13) + chr(10))} as the condition.")


def test_slot_ends_with_its_paragraph():
    for text in ("The set {{ a\n\nb }} is closed.", "See [enter\n \nlaw] here.", "Click here\n\nto enter text", "See [the\ncourt] and <a\nb>."):
        assert not residue.has_slot(text)
    assert residue.has_slot("The {{ party }} signs.\n\nThe rest stays.")


UNSEEN = {
    "Oops! That page has wandered off.": "error", "Page non trouvée.": "error", "Pagina non trovata": "error", "You have been blocked.": "error",
    "Please wait while we verify you are human.": "error", "Dear [First Name],": "slot", "Hello *|FNAME|*": "slot",
    "TypeError: cannot read the record\n\nHome · Help": "error", "Warning 17: the server could not be reached.": "error",
    "Your browser is too old. Update your browser to continue.": "script", "Scripts are disabled. Enable scripts and reload.": "script",
}
ORDINARY = ["The court found no error.", "The exception applies.", "The error in the account was corrected by the trustee.", "The tenant denied access."]


def test_residue_unseen(spark):
    rows = residue.template_residue(texts(spark, [*UNSEEN, *ORDINARY])).collect()
    assert {r.doc_id: r.kind for r in rows} == dict(enumerate(UNSEEN.values()))


def test_message_and_template_have_one_verdict():
    """Joining a template never changes what a message is."""
    rng = random.Random(5)
    stock = "the page file could not be opened error javascript please enable found lorem ipsum tenant shall rent reload home help court".split()
    tree, read = residue.PrefixTree(), []
    for _ in range(4000):
        words = [rng.choice(stock) if rng.random() < 0.9 else f"word{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(1, 9))]
        read.append((list(words), tree.add(list(words))))
    assert any(residue.OTHER in t[0] for _, t in read)
    assert all(residue.verdict(" ".join(w)) == residue.verdict(" ".join(t[0])) for w, t in read)


def test_residue_learns_from_the_corpus(spark):
    rng = random.Random(2)
    odd = "vadel quilat tupor nisipe dolem ferat rebum".split()
    filler = [" ".join(["lorem", *rng.sample(odd, 4)]) + "." for _ in range(30)]
    alone = " ".join(odd[:5]) + "."
    page = "The vault stays shut today. Error 17 of the page."
    df = texts(spark, ["The rent is due. " + alone, *filler, *[page] * 4, "The rent is due on Monday. The deposit is paid."])
    kinds = {r.doc_id: r.kind for r in residue.template_residue(df).collect()}
    assert kinds[0] == "filler" and all(kinds[k] == "filler" for k in range(1, 31))
    assert [kinds.get(k) for k in range(31, 36)] == ["error"] * 4 + [None]


def test_residue_tells_sentences_from_their_like(spark):
    # In every partition the message stands beside sentences that differ from it in one word.
    ends = "amended assigned divided let sold valued insured leased moved shared split taxed".split()
    df = texts(spark, ["The file here could not be opened.", *[f"The file here could not be {w}." for w in ends * 4]])
    rows = residue.template_residue(df).collect()
    assert {r.doc_id: r.kind for r in rows} == {0: "error"}


def test_residue_of_overlapping_templates(spark):
    # The wildcards of the first message match words of the second, which has the better verdict of its own.
    df = texts(spark, ["Error in page 1 2 3.", "Error in page enable javascript now."])
    rows = residue.template_residue(df).collect()
    assert {r.doc_id: r.kind for r in rows} == {0: "error", 1: "script"}
