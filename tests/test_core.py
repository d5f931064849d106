"""The comparison engine on small fixtures with worked-out results."""

import collections
import dataclasses
import io
import json
import math
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from twinleaf.config import DEFAULTS
from twinleaf.functions import text as tx
from twinleaf.operators import matching, report, sentences, similarity
from twinleaf.plans.compare import Comparison
from twinleaf.plans.render import report_html, report_json
from twinleaf.sources import work
from twinleaf.sources.files import accepted, expired, read_documents, read_pages, reader_of
from twinleaf.streaming import compare_arrivals


def column(spark, values, f, schema="t string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"k int, {schema}")
    return [r.out for r in df.select("k", f().alias("out")).orderBy("k").collect()]


def test_clean(spark):
    cases = {
        "A  clause.\n\n\n\nNext.\n12\nEnd.\fTail ": "A clause.\n\nNext.\nEnd.\n\nTail", "a\n\n5\n\nb": "a\n\n\nb", "a\n1\n2\n3\nb": "a\n2\nb",
        "x\fy": "x\n\ny", "a\n٣\nb": "a\nb", "": "",
    }
    assert column(spark, [*cases, None], lambda: tx.clean_text(F.col("t"))) == [*cases.values(), None]


def test_ocr_quality(spark):
    got = column(spark, ["", "Clean text here.", "a1b2", "Th1s a b c t€xt", None], lambda: tx.ocr_quality(F.col("t")))
    assert got == [0.0, 1.0, 0.0, 0.0, 0.0]


def test_split_long(spark):
    parts = column(
        spark, ["a" * 300 + ";" + " b" * 120, "a" * 500 + ";b:c", "x" * 400 + ":" + "y" * 200, ";" * 501, "z" * 1201], lambda: tx.split_long(F.col("t"))
    )
    assert [len(x) for x in parts] == [2, 2, 2, 0, 3]
    assert [len(x) for x in parts[1]] == [500, 4] and [len(x) for x in parts[4]] == [500, 500, 201]


def test_small_functions(spark):
    assert column(spark, [" .Hi!;: ", "A \t\n B"], lambda: tx.normalize_sentence(F.col("t"))) == ["hi", "a b"]
    assert column(spark, ["a" * 500, "a" * 501], lambda: tx.preview(F.col("t"))) == ["a" * 500, "a" * 500 + "..."]
    pairs = [("A b", "b a"), ("a", "c"), ("?!", "a"), ("Élan ça", "élan"), (None, "a")]
    assert column(spark, pairs, lambda: tx.jaccard(F.col("a"), F.col("b")), "a string, b string") == [1.0, 0.0, 0.0, 0.5, 0.0]
    hints = column(
        spark, [("l", "1"), ("1", "I"), ("a", "a" * 11), ("a", "a" * 12), ("a", "a b c d"), ("a", "a b c d e")],
        lambda: tx.suggestions(F.col("a"), F.col("b")), "a string, b string",
    )
    assert hints[0] == ["Possible OCR error: 'l' → '1'"] and hints[1] == ["Possible OCR error: '1' → 'I'"]
    assert hints[2] == [] and hints[3] == ["Length difference: 11 characters"]
    assert hints[4] == [] and hints[5] == ["Word count difference: 1 vs 5 words"]


def test_verdict_steps(spark):
    rows = [(98.0, 5), (97.99, 6), (90.0, 0), (89.99, 0), (75.0, 0), (74.99, 0), (50.0, 0), (49.99, 0)]
    got = column(spark, rows, lambda: F.struct(*[c.alias(k) for k, c in tx.verdict(F.col("o"), F.col("m")).items()]), "o double, m int")
    assert [g.status for g in got] == ["identical", "very_similar", "very_similar", "similar", "similar", "different", "different", "very_different"]
    assert [g.confidence for g in got[:2]] == ["medium", "high"]


def test_classes(spark):
    rows = [(True, True, 1.0), (False, True, 0.5), (False, False, 0.96), (False, False, 0.95), (False, False, 0.85), (False, False, None)]
    got = column(spark, rows, lambda: tx.classify(F.col("e"), F.col("n"), F.col("s")), "e boolean, n boolean, s double")
    assert got == ["exact_match", "minor_difference", "minor_difference", "rewording", "significant", "significant"]


def test_chunks(spark):
    long = "x" * 600 + ". "
    df = spark.createDataFrame([(1, f"{long}No. A b. Hi there! ok"), (2, "  "), (3, None), (4, "")], "doc_id long, text string")
    rows = sentences.sentence_chunks(df).orderBy("doc_id", "seq").collect()
    assert [(r.seq, r.sent_id, r.is_split, r.length) for r in rows] == [(0, 0, True, 500), (1, 1, True, 101), (2, 1, False, 3), (3, 2, False, 4), (4, 3, False, 9)]
    assert (rows[3].start_char, rows[3].end_char, rows[3].text) == (606, 610, "A b.")
    stats = {r.doc_id: r for r in sentences.chunk_statistics(df, sentences.sentence_chunks(df)).collect()}
    assert stats[1].total_sentences == 5 and stats[2].total_sentences == stats[3].total_chars == 0


def test_paragraphs_and_context(spark):
    spans = [(0, 5), (7, 9), (12, 15), (10, 15)]
    df = spark.createDataFrame([(1, i, f"s{i}", a, b) for i, (a, b) in enumerate(spans)], "doc_id long, seq int, text string, start_char int, end_char int")
    assert [r.paragraph_id for r in sentences.paragraph_groups(df).orderBy("seq").collect()] == [0, 0, 1, 1]
    c = sentences.sentence_context(df).orderBy("seq").collect()
    assert (c[0].before, c[0].after, c[3].before, c[3].after) == ([], ["s1"], ["s2"], [])


def sequential(edges, n1, n2, w=2):
    """The matching rule, one pair at a time."""
    sim = {(i, j): s for s, i, j in edges}
    left, right, out = set(), set(), []
    for s, i, j in sorted(edges, reverse=True):
        if s < 0.85 or i in left or j in right:
            continue
        near = [(i + o, j + o) for o in range(-w, w + 1) if o and 0 <= i + o < n1 and 0 <= j + o < n2]
        near = [(a, b) for a, b in near if a not in left and b not in right]
        if len(near) >= 2 and not any(sim.get(x, 0) > 0.7 for x in near):
            continue
        left.add(i)
        right.add(j)
        out.append((i, j))
    return out


def test_matching_parity(spark):
    rng = random.Random(11)
    rows, sizes, expected = [], [], {}
    for p in range(150):
        n1, n2 = rng.randint(0, 9), rng.randint(0, 9)
        edges = [(rng.choice([0.7, 0.75, 0.84, 0.85, 0.9, 1.0]), i, j) for i in range(n1) for j in range(n2) if rng.random() < 0.4]
        rows += [(p, i, j, s) for s, i, j in edges]
        sizes.append((p, n1, n2))
        expected[p] = sequential(edges, n1, n2)
    edges = spark.createDataFrame(rows, "pair_id long, i int, j int, similarity double")
    got = {p: [] for p in expected}
    for r in matching.greedy_match(edges, spark.createDataFrame(sizes, "pair_id long, n1 int, n2 int")).orderBy("pair_id", "match_rank").collect():
        got[r.pair_id].append((r.i, r.j))
    assert got == expected
    assert matching.greedy_match(edges.limit(0), spark.createDataFrame(sizes, "pair_id long, n1 int, n2 int")).count() == 0


def test_edges_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = "the tenant pays rent to a landlord before notice of breach".split()
    texts = {d: [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(12)] + ["", "?!"] for d in (1, 2, 3)}
    units = spark.createDataFrame([(d, i, i, t, "x") for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, seq int, sent_id int, text string, token string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 3), (4, 1, 9)], "pair_id long, doc_id1 long, doc_id2 long")

    def cos(a, b):
        x, y = ({w: t.split().count(w) for w in t.split() if w.isalpha()} for t in (a, b))
        dot = sum(n * y.get(w, 0) for w, n in x.items())
        return dot / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5 if dot else 0.0

    expected = {(p, i, j) for p, a, b in ((1, 1, 2), (2, 2, 3), (3, 3, 3)) for i, s in enumerate(texts[a]) for j, t in enumerate(texts[b]) if cos(s, t) >= 0.7}
    got = {(r.pair_id, r.i, r.j) for r in similarity.similarity_edges(pairs, units.drop("token"), 0.7).collect()}
    assert got == expected and expected


def test_report_figures(spark):
    matches = spark.createDataFrame(
        [(1, 1, 0, 0, 1.0, "This is sentence one.", "This is sentence one.", True, True), (1, 2, 1, 1, 0.92, "This is sentence two.", "This is sentnce two.", False, False)],
        "pair_id long, match_rank int, index1 int, index2 int, similarity double, text1 string, text2 string, exact_match boolean, normalized_match boolean",
    )
    none = spark.createDataFrame([], "pair_id long, seq int, sent_id int, text string")
    extra = spark.createDataFrame([(1, 2, 2, "Extra sentence in doc 2.")], none.schema)
    diffs = report.differences(matches, none, extra)
    ordered = report.ordered_differences(diffs).orderBy("place").collect()
    assert [(r.position1, r.position2, r.classification, r.severity) for r in ordered] == [(2, 2, "rewording", "medium"), (None, 3, "addition", "high")]
    assert ordered[0].suggestions == []
    pairs = matches.select("pair_id").distinct()
    quality = report.match_quality(pairs, matches)
    scores = spark.createDataFrame([(1, 2, 3, 2, 0.85)], "pair_id long, n1 int, n2 int, matched long, match_score double")
    summary = report.summary(scores, quality, report.reorderings(matches))
    s = summary.first()
    assert (s.overall_match, s.matched_sentences, s.exact_matches, s.minor_differences, s.significant_differences) == (85.0, 2, 1, 0, 1)
    assert (s.missing_in_doc1, s.missing_in_doc2, s.reorderings_detected, s.avg_similarity) == (1, 0, 0, 0.96)
    v = report.verdicts(summary).first()
    assert (v.status, v.color, v.confidence) == ("similar", "yellow", "medium")
    advice = report.recommendations(summary, diffs).first().recommendations
    assert len(advice) == 2 and advice[0].startswith("1 sentence(s) appear only in document 2.")


def test_reorderings(spark):
    df = spark.createDataFrame([(1, 1, 0, 4, "a"), (1, 2, 0, 5, "b"), (1, 3, 7, 2, "c")], "pair_id long, match_rank int, index1 int, index2 int, text1 string")
    assert [(r.sentence, r.displacement) for r in report.reorderings(df).orderBy("match_rank").collect()] == [("b", 5), ("c", -5)]


def test_compare_documents(spark):
    one = "This is the first sentence. This is the second sentence. This is the third sentence."
    docs = [(1, one), (2, one.replace("second", "seccond")), (3, one), (4, None), (5, "<b>Other</b> words entirely.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 1, 3), (2, 1, 2), (3, 1, 4), (4, 4, 4), (5, 1, 5), (None, 1, 2), (1, 1, 3)], "pair_id long, doc_id1 long, doc_id2 long")
    c = Comparison.of_documents(pairs, df)
    s = {r.pair_id: r for r in c.summary.collect()}
    assert {p: r.overall_match for p, r in s.items()} == {1: 100.0, 2: 66.67, 3: 0.0, 4: 0.0, 5: 0.0}
    assert s[3].missing_in_doc2 == 3 and s[4].total_sentences_doc1 == 0
    r = {x.pair_id: json.loads(x.report) for x in report_json(c.report()).collect()}
    assert r[1]["recommendations"] == ["Documents match very closely. No significant issues detected."] and r[1]["differences"] == []
    names = spark.createDataFrame([(5, "a<1>.txt", "b.txt")], "pair_id long, file1_name string, file2_name string")
    page = {x.pair_id: x.html for x in report_html(c.report(), names).collect()}[5]
    assert "a&lt;1&gt;.txt" in page and "&lt;b&gt;Other" in page and "Missing In Doc2" in page and "Missing in Document 1" in page and "0.0%" in page
    assert "0 of 3 sentences matched" in page and page.count("<tr>") == 5 and "No sentence has moved." in page


def word_file(*lines):
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("  two  spaces ", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(word_file("One  line.", "Next."))
    (tmp_path / "c.doc").write_bytes(b"\xd0\xcf\x11\xe0 legacy")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "e.zip").write_bytes(b"x")
    rows = {r.name: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.TXT"].text == "  two  spaces " and rows["b.docx"].text == "One line.\nNext."
    assert all(rows[n].text is None and rows[n].error for n in ("c.doc", "d.txt", "e.zip"))


def test_file_rules(spark):
    top = DEFAULTS.max_upload_size
    rows = [("A.PDF", 1), (".pdf", 1), ("a.tar.gz", 1), ("a.txt", top), ("a.txt", top + 1), (None, 1), ("a.txt", None)]
    got = column(spark, rows, lambda: accepted(F.col("n"), F.col("l")), "n string, l long")
    assert got == [True, False, False, True, False, False, False]
    assert column(spark, [".PDF", ".jpeg", ".doc", ".xls", None], lambda: reader_of(F.col("t"))) == ["pdf", "image", "word", None, None]
    files = spark.sql("select 'a' n, timestamp'2031-01-01 00:00:00' t union all select 'b', timestamp'2031-01-01 00:00:01'")
    assert [r.n for r in expired(files, "t", F.lit("2031-01-02 00:00:01"), 24).collect()] == ["a"]


def test_stream_of_pairs(spark, tmp_path):
    units = spark.createDataFrame([(1, 0, 0, "The rent is due."), (2, 0, 0, "The rent is due.")], "doc_id long, seq int, sent_id int, text string")
    schema = "pair_id long, doc_id1 long, doc_id2 long"
    spark.createDataFrame([(7, 1, 2)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    compare_arrivals(stream, units, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().overall_match == 100.0


def test_vectors_in_the_comparison(spark):
    units = [(1, 0, 0, "Rent is due."), (1, 1, 1, "Deposit paid."), (2, 0, 0, "The rent falls due."), (2, 1, 1, "Cats."), (3, 0, 0, "Alone.")]
    df = spark.createDataFrame(units, "doc_id long, seq int, sent_id int, text string")
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0]), (2, 0, [3.0, 0.1]), (2, 1, [0.0, 0.0]), (2, 1, None), (3, 0, [1.0, 0.0, 0.0]), (1, None, [1.0, 1.0])]
    vectors = spark.createDataFrame([*rows, rows[0]], "doc_id long, seq int, embedding array<float>")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 9)], "pair_id long, doc_id1 long, doc_id2 long")
    c = Comparison(pairs, df, vectors=vectors)
    assert [(r.pair_id, r.index1, r.index2) for r in c.matches.collect()] == [(1, 0, 0)]
    assert [(r.pair_id, r.reason) for r in c.refused.collect()] == [(3, "document 2 is empty")]
    assert Comparison(pairs, df, vectors=vectors.limit(0)).matches.count() == 0


def test_vector_blocks_lose_nothing(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(d, q, [rng.gauss(0, 1) for _ in range(3)]) for d in (1, 2) for q in range(40)]
    vectors = spark.createDataFrame(rows, "doc_id long, seq int, embedding array<double>")
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, doc_id1 long, doc_id2 long")
    whole = {(r.i, r.j, r.similarity) for r in similarity.vector_edges(pairs, vectors, 0.8).collect()}
    monkeypatch.setattr(similarity, "VECTOR_BLOCK", 7)
    assert whole == {(r.i, r.j, r.similarity) for r in similarity.vector_edges(pairs, vectors, 0.8).collect()} and len(whole) > 20
    x, y = ([v for d, _, v in rows if d == k] for k in (1, 2))
    cos = lambda a, b: sum(p * q for p, q in zip(a, b)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))
    assert {(i, j) for i, j, _ in whole} == {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if cos(a, b) >= 0.8}


def test_edges_of_common_words(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["the"] * 6
    units = [(d, q, 0, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for d in (1, 2) for q in range(40)]
    df = spark.createDataFrame(units, "doc_id long, seq int, sent_id int, text string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, doc_id1 long, doc_id2 long")
    got = {(r.i, r.j): r.similarity for r in similarity.similarity_edges(pairs, df, 0.7).collect()}
    counts = {(d, q): collections.Counter(t.split()) for d, q, _, t in units}
    norm = {k: sum(v * v for v in c.values()) for k, c in counts.items()}
    true = {}
    for i in range(40):
        for j in range(40):
            a, b = (1, i), (2, j)
            dot = sum(n * counts[b][w] for w, n in counts[a].items())
            if dot and dot / math.sqrt(norm[a] * norm[b]) >= 0.7:
                true[i, j] = dot / math.sqrt(norm[a] * norm[b])
    assert got == pytest.approx(true) and true


def test_written_folders_are_removed(spark):
    with work.cleared(spark):
        place = work.written(spark.range(3), "kept").inputFiles()[0].removeprefix("file:")
        assert os.path.exists(place)
    assert not os.path.exists(place)


def test_pages(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"x" * 50)
    (tmp_path / "c.png").write_bytes(b"scan")
    rows = {(r.name, r.page_no): (r.text, r.error) for r in read_pages(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a.pdf", None), ("b.pdf", None), ("c.png", None)} and all(t is None and e for t, e in rows.values())
    small = dataclasses.replace(DEFAULTS, max_upload_size=20)
    rows = {r.name: r.error for r in read_pages(spark, str(tmp_path), small).collect()}
    assert rows["b.pdf"] == "type or size not accepted" and "optional library" in rows["a.pdf"]


def test_odd_characters_in_chunks(spark):
    text = "One\x01two ends. Three\x01 is here! " + "Four five. Six"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "  ")], "doc_id long, text string")
    rows = sentences.sentence_chunks(df).orderBy("seq").collect()
    assert [r.text for r in rows] == ["One\x01two ends.", "Three\x01 is here!", "Four five.", "Six"]
    assert all(text[r.start_char : r.end_char] == r.text for r in rows)
