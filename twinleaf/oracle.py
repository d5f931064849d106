"""The queries as SQL, for comparison on another engine."""

from __future__ import annotations

from twinleaf.functions.text import EDGES, ONLY_TEXTS, OCR_PAIRS, VERDICTS, WS


def q(s: str) -> str:
    """``s`` as a SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(EDGES)}, '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), {q(f'[{WS}]+')}, ' ', 'g'), ' .,!?;:')"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def clean(x: str) -> str:
    out = f"regexp_replace({x}, ' +', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n\\p{{Nd}}+\\n', chr(10), 'g')"
    return strip(f"regexp_replace({out}, '\\f', chr(10) || chr(10), 'g')")


def quality(x: str) -> str:
    odd = q(rf"""[^\p{{L}}\p{{N}}_{WS}.,!?;:\-'"()]""")
    single = q(rf"[{WS}][\p{{L}}\p{{N}}_][{WS}]")
    mixed = q(r"\p{Nd}[a-zA-Z]|[a-zA-Z]\p{Nd}")
    n = " + ".join(f"len(regexp_extract_all({x}, {p}))" for p in (odd, single, mixed))
    return f"CASE WHEN length({x}) = 0 THEN 0.0::double ELSE greatest(0.0::double, 1.0::double - (({n})::double / length({x})::double) * 10.0::double) END"


def parts(x: str, mark: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '{mark}'), lambda s: {strip('s')}), lambda s: s <> '')"


def split_long(x: str) -> str:
    def short(mark: str) -> str:
        return f"contains({x}, '{mark}') AND len(list_filter({parts(x, mark)}, lambda s: length(s) >= 500)) = 0"

    slices = f"list_transform(range(0, greatest(length({x}), 1), 500), lambda o: substring({x}, (o + 1)::int, 500))"
    return f"CASE WHEN {short(';')} THEN {parts(x, ';')} WHEN {short(':')} THEN {parts(x, ':')} ELSE {slices} END"


def kind(exact: str = "exact_match", normalized: str = "normalized_match", sim: str = "similarity") -> str:
    return (
        f"CASE WHEN {exact} THEN 'exact_match' WHEN {normalized} THEN 'minor_difference' WHEN {sim} > 0.95::double THEN 'minor_difference' "
        f"WHEN {sim} > 0.85::double THEN 'rewording' ELSE 'significant' END"
    )


def severity(k: str) -> str:
    return f"CASE {k} WHEN 'exact_match' THEN 'none' WHEN 'minor_difference' THEN 'low' WHEN 'rewording' THEN 'medium' WHEN 'significant' THEN 'high' ELSE 'medium' END"


def hints(a: str, b: str) -> str:
    rows = []
    for x, y in OCR_PAIRS:
        for p, r in ((x, y), (y, x)):
            said = q(f"Possible OCR error: '{p}' → '{r}'")
            rows.append(f"CASE WHEN contains({a}, '{p}') AND contains({b}, '{r}') THEN {said} END")
    apart = f"abs(length({a}) - length({b}))"
    rows.append(f"CASE WHEN {apart} > 10 THEN 'Length difference: ' || {apart} || ' characters' END")

    def words(x: str) -> str:
        return f"len(list_filter(regexp_split_to_array({x}, {q(f'[{WS}]+')}), lambda w: w <> ''))"

    m, n = words(a), words(b)
    rows.append(f"CASE WHEN abs({m} - {n}) > 3 THEN 'Word count difference: ' || {m} || ' vs ' || {n} || ' words' END")
    return f"array_to_string(list_filter([{', '.join(rows)}], lambda h: h IS NOT NULL), ' | ')"


UNITS = """u AS (SELECT doc_id, seq, any_value(sent_id) AS sent_id, any_value(text) AS text, any_value(start_char) AS start_char,
 any_value(end_char) AS end_char, length(any_value(text)) AS length FROM sentence
 WHERE doc_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL GROUP BY doc_id, seq)"""
MATCHES = """m AS (SELECT match_id, pair_id, match_rank, sent1.text AS text1, sent2.text AS text2, similarity, index1, index2, exact_match,
 normalized_match FROM sentence_match QUALIFY row_number() OVER (PARTITION BY match_id) = 1)"""
UPLOADS = """f AS (SELECT doc_id, name, ext, n_bytes, uploaded_at FROM upload_file
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY received_at DESC, name DESC) = 1)"""
SUFFIX = "lower(regexp_extract(name, '[^/](\\.[^./]+)$', 1))"

PAIRS = """p AS (SELECT pair_id, any_value(doc_id1) AS doc_id1, any_value(doc_id2) AS doc_id2 FROM doc_pair
 WHERE pair_id IS NOT NULL AND doc_id1 IS NOT NULL AND doc_id2 IS NOT NULL GROUP BY pair_id)"""
EDGES_CTE = f"""{UNITS}, {PAIRS},
used AS (SELECT doc_id1 AS doc_id FROM p UNION SELECT doc_id2 FROM p),
t AS (SELECT doc_id, seq, token, count(*) AS tf FROM (SELECT doc_id, seq, unnest({toks('text')}) AS token FROM u SEMI JOIN used USING (doc_id))
 GROUP BY ALL),
n AS (SELECT doc_id, seq, sum(tf * tf)::bigint AS norm2 FROM t GROUP BY ALL),
dots AS (SELECT p.pair_id, a.seq AS i, b.seq AS j, sum(a.tf * b.tf)::bigint AS dot, any_value(p.doc_id1) AS d1, any_value(p.doc_id2) AS d2
 FROM p JOIN t a ON a.doc_id = p.doc_id1 JOIN t b ON b.doc_id = p.doc_id2 AND b.token = a.token GROUP BY ALL),
e AS (SELECT pair_id, i, j, dot::double / sqrt((x.norm2 * y.norm2)::double) AS similarity FROM dots
 JOIN n x ON x.doc_id = d1 AND x.seq = i JOIN n y ON y.doc_id = d2 AND y.seq = j
 WHERE dot::double / sqrt((x.norm2 * y.norm2)::double) >= 0.7::double)"""
SIZES = """z AS (SELECT pair_id, coalesce(n1, 0)::int AS n1, coalesce(n2, 0)::int AS n2 FROM p
 LEFT JOIN (SELECT doc_id, count(*) AS n1 FROM u GROUP BY ALL) a ON a.doc_id = doc_id1
 LEFT JOIN (SELECT doc_id, count(*) AS n2 FROM u GROUP BY ALL) b ON b.doc_id = doc_id2)"""
# The edges of a pair are a list of one-element lists, folded into the list of the accepted ones.
MATCH_CTE = f"""{EDGES_CTE}, {SIZES},
g AS (SELECT pair_id, list([{{'s': similarity, 'i': i, 'j': j}}] ORDER BY similarity DESC, i DESC, j DESC) FILTER (WHERE similarity >= 0.85::double) AS es,
 coalesce(list(i::bigint * 1000000 + j) FILTER (WHERE similarity > 0.7::double), []) AS sup FROM e GROUP BY ALL),
h AS (SELECT pair_id, n1, n2, es, sup FROM g JOIN z USING (pair_id) WHERE es IS NOT NULL),
folded AS (SELECT pair_id, list_reduce(list_prepend([]::struct(s double, i int, j int)[], es), lambda acc, x: CASE
 WHEN len(list_filter(acc, lambda a: a.i = x[1].i OR a.j = x[1].j)) > 0 THEN acc
 WHEN len(list_filter([-2, -1, 1, 2], lambda o: x[1].i + o >= 0 AND x[1].i + o < n1 AND x[1].j + o >= 0 AND x[1].j + o < n2
  AND len(list_filter(acc, lambda a: a.i = x[1].i + o OR a.j = x[1].j + o)) = 0)) >= 2
  AND len(list_filter([-2, -1, 1, 2], lambda o: x[1].i + o >= 0 AND x[1].i + o < n1 AND x[1].j + o >= 0 AND x[1].j + o < n2
  AND len(list_filter(acc, lambda a: a.i = x[1].i + o OR a.j = x[1].j + o)) = 0
  AND list_contains(sup, (x[1].i + o)::bigint * 1000000 + (x[1].j + o)))) = 0 THEN acc
 ELSE list_concat(acc, x) END) AS acc FROM h),
gm AS (SELECT pair_id, k::int AS match_rank, acc[k].i AS i, acc[k].j AS j, acc[k].s AS similarity
 FROM (SELECT pair_id, acc, unnest(range(1, len(acc) + 1)) AS k FROM folded)),
mm AS (SELECT gm.pair_id, match_rank, i AS index1, j AS index2, similarity, a.text AS text1, b.text AS text2, a.text = b.text AS exact_match,
 {norm('a.text')} = {norm('b.text')} AS normalized_match FROM gm JOIN p USING (pair_id)
 JOIN u a ON a.doc_id = doc_id1 AND a.seq = i JOIN u b ON b.doc_id = doc_id2 AND b.seq = j),
only1 AS (SELECT p.pair_id, u.seq, u.sent_id, u.text FROM p JOIN u ON u.doc_id = doc_id1
 WHERE NOT EXISTS (SELECT 1 FROM gm WHERE gm.pair_id = p.pair_id AND gm.i = u.seq)),
only2 AS (SELECT p.pair_id, u.seq, u.sent_id, u.text FROM p JOIN u ON u.doc_id = doc_id2
 WHERE NOT EXISTS (SELECT 1 FROM gm WHERE gm.pair_id = p.pair_id AND gm.j = u.seq)),
kinds AS (SELECT *, {kind()} AS kind FROM mm),
qual AS (SELECT p.pair_id, count(k.pair_id) AS total_matches, count(*) FILTER (WHERE kind = 'exact_match') AS exact_matches,
 count(*) FILTER (WHERE kind = 'minor_difference') AS minor_differences, count(*) FILTER (WHERE kind = 'rewording') AS rewordings,
 count(*) FILTER (WHERE kind = 'significant') AS significant_differences, coalesce(avg(similarity), 0.0::double) AS avg_similarity
 FROM p LEFT JOIN kinds k USING (pair_id) GROUP BY p.pair_id),
moved AS (SELECT pair_id, match_rank, text1 AS sentence, index1 AS expected_position, index2 AS actual_position, index2 - index1 AS displacement
 FROM mm WHERE abs(index1 - index2) > 4),
sc AS (SELECT z.pair_id, n1, n2, coalesce(c, 0) AS matched,
 CASE WHEN n1 + n2 > 0 THEN (coalesce(c, 0) * 2)::double / (n1 + n2)::double ELSE 0.0::double END AS match_score
 FROM z LEFT JOIN (SELECT pair_id, count(*) AS c FROM gm GROUP BY ALL) USING (pair_id)),
summ AS (SELECT sc.pair_id, round_even(match_score * 100, 2) AS overall_match, n1 AS total_sentences_doc1, n2 AS total_sentences_doc2,
 matched AS matched_sentences, exact_matches, minor_differences, significant_differences + (n1 - matched) + (n2 - matched) AS significant_differences,
 n2 - matched AS missing_in_doc1, n1 - matched AS missing_in_doc2, coalesce(r, 0) AS reorderings_detected, round_even(avg_similarity, 3) AS avg_similarity
 FROM sc JOIN qual USING (pair_id) LEFT JOIN (SELECT pair_id, count(*) AS r FROM moved GROUP BY ALL) USING (pair_id)),
diffs AS (SELECT pair_id, 0 AS source, match_rank AS source_seq, 'mismatch' AS type, kind AS classification, {severity('kind')} AS severity,
 index1 + 1 AS position1, index2 + 1 AS position2, text1 AS sentence1, text2 AS sentence2, similarity, {hints('text1', 'text2')} AS suggestions
 FROM kinds WHERE NOT exact_match
 UNION ALL SELECT pair_id, 1, seq, 'missing_in_doc2', 'addition', 'high', sent_id + 1, NULL, text, NULL, 0.0, {q(ONLY_TEXTS[0])} FROM only1
 UNION ALL SELECT pair_id, 2, seq, 'missing_in_doc1', 'addition', 'high', NULL, sent_id + 1, NULL, text, 0.0, {q(ONLY_TEXTS[1])} FROM only2),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY position1 ASC NULLS LAST, position2 ASC NULLS LAST, source, source_seq) AS place
 FROM diffs),
ver AS (SELECT pair_id, overall_match, {', '.join('CASE ' + ' '.join(f"WHEN overall_match >= {v[0]} THEN {q(v[k])}" for v in VERDICTS[:-1]) + f" ELSE {q(VERDICTS[-1][k])} END AS {name}" for k, name in ((1, 'status'), (2, 'message'), (3, 'color')))},
 CASE WHEN matched_sentences > 5 THEN 'high' ELSE 'medium' END AS confidence FROM summ),
rules AS (SELECT s.pair_id, s.overall_match, list_filter([
 CASE WHEN coalesce(ocr, 0) > 3 THEN 'Multiple potential OCR errors detected. Consider rescanning document with higher quality settings.' END,
 CASE WHEN reorderings_detected > 0 THEN 'Detected ' || reorderings_detected || ' sentences that appear in different order. Verify if content was intentionally reorganized.' END,
 CASE WHEN missing_in_doc1 > 0 THEN missing_in_doc1 || ' sentence(s) appear only in document 2. Check if content was added or if OCR missed these sections.' END,
 CASE WHEN missing_in_doc2 > 0 THEN missing_in_doc2 || ' sentence(s) appear only in document 1. Check if content was removed or if OCR failed.' END,
 CASE WHEN overall_match < 90 THEN 'Documents have notable differences. Manual review recommended for important documents.' END,
 CASE WHEN overall_match >= 95 AND minor_differences > 0 THEN 'Documents are very similar. Differences appear to be minor (typos, punctuation). Verify if these are acceptable variations.' END
 ], lambda x: x IS NOT NULL) AS said
 FROM summ s LEFT JOIN (SELECT pair_id, count(*) FILTER (WHERE contains(suggestions, 'OCR')) AS ocr FROM diffs GROUP BY ALL) USING (pair_id)),
rec AS (SELECT pair_id, CASE WHEN len(said) = 0 AND overall_match >= 98 THEN 'Documents match very closely. No significant issues detected.'
 ELSE array_to_string(said, ' | ') END AS recommendations FROM rules)"""

# Edges by the stored vectors in place of words; everything behind them is the same.
VECTOR_EDGES_CTE = f"""{UNITS},
p AS (SELECT DISTINCT doc_id AS pair_id, (SELECT min(doc_id) FROM sentence_vector WHERE embedding IS NOT NULL) AS doc_id1, doc_id AS doc_id2
 FROM sentence_vector WHERE embedding IS NOT NULL AND doc_id IS NOT NULL),
v AS (SELECT doc_id, seq, min(embedding::double[]) AS x FROM sentence_vector
 WHERE doc_id IS NOT NULL AND seq IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 GROUP BY ALL),
vs AS (SELECT p.pair_id, a.seq AS i, b.seq AS j, round(list_cosine_similarity(a.x, b.x), 9) AS similarity
 FROM p JOIN v a ON a.doc_id = p.doc_id1 JOIN v b ON b.doc_id = p.doc_id2 AND len(b.x) = len(a.x)),
e AS (SELECT * FROM vs WHERE NOT isnan(similarity) AND similarity >= 0.7::double)"""
VECTOR_MATCH_CTE = MATCH_CTE.replace(EDGES_CTE, VECTOR_EDGES_CTE)

CHUNKS = f"""parts AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, k - 1 AS pos, ps[k] AS part FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM parts)),
placed AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS start_char FROM raw),
kept AS (SELECT *, (start_char + length(regexp_replace(part, '\\s+$', '')))::int AS end_char, {strip('part')} AS whole FROM placed),
cutted AS (SELECT doc_id, pos, start_char, end_char, length(whole) > 500 AS is_split,
 CASE WHEN length(whole) > 500 THEN {split_long('whole')} ELSE [whole] END AS texts FROM kept WHERE length(whole) >= 3),
listed AS (SELECT *, texts[k] AS text FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS k FROM cutted)),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1)::int AS seq FROM listed)"""


def oracle_sql() -> dict[str, str]:
    u, m, f, e, g = (f"WITH {x} " for x in (UNITS, MATCHES, UPLOADS, EDGES_CTE, MATCH_CTE))
    image = "lower('.' || ext) IN ('.png', '.jpg', '.jpeg')"
    conf = f"CASE WHEN {image} THEN {quality('body')} ELSE 1.0::double END"
    vectors = f"WITH {VECTOR_EDGES_CTE} "
    report = g + """SELECT s.pair_id, s.overall_match, matched_sentences, significant_differences, status, confidence, coalesce(n, 0)::int AS n_differences,
 reorderings_detected::int AS n_reorderings, coalesce(ts, '') AS difference_types, recommendations FROM summ s JOIN ver USING (pair_id) JOIN rec USING (pair_id)
 LEFT JOIN (SELECT pair_id, count(*) AS n, string_agg(type, ',' ORDER BY place) AS ts FROM placed GROUP BY ALL) USING (pair_id)"""
    return {
        "read_files": "SELECT doc_id, '.txt' AS ext, text || chr(10) AS text, false AS refused FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
        "extract_payload": "SELECT doc_id, name AS filename, text, length(text)::int AS length, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS preview FROM documents",
        "engine_config": """SELECT 10485760 AS max_upload_size, '.pdf,.png,.jpg,.jpeg,.txt,.doc,.docx' AS allowed_extensions, 0.85::double AS similarity_threshold,
 0.7::double AS context_similarity, 2 AS context_window, 0.95::double AS minor_above, 0.85::double AS rewording_above, 500 AS max_sentence_length,
 3 AS min_sentence_length, 2 AS paragraph_gap, 0.7::double AS ocr_warning_at, 500 AS preview_length""",
        "vector_edges": vectors + "SELECT pair_id, i, j, similarity FROM e",
        "vector_match": f"WITH {VECTOR_MATCH_CTE} SELECT pair_id, match_rank, index1, index2, similarity, exact_match, normalized_match FROM mm",
        "refused_pairs": f"""WITH {UNITS}, {PAIRS}, {SIZES} SELECT pair_id, concat_ws(', ', CASE WHEN n1 = 0 THEN 'document 1 is empty' END,
 CASE WHEN n2 = 0 THEN 'document 2 is empty' END) AS reason FROM z WHERE n1 = 0 OR n2 = 0""",
        "moved_sentences": m
        + """, r AS (SELECT * REPLACE (max(index2) OVER (PARTITION BY pair_id) - index2 AS index2) FROM m)
 SELECT pair_id, match_rank, index1 AS expected_position, index2 AS actual_position, index2 - index1 AS displacement FROM r WHERE abs(index1 - index2) > 4""",
        "json_fields": report,
        "html_parts": g
        + """SELECT pair_id, CASE WHEN coalesce(n, 0) > 0 THEN n + 1 ELSE 0 END::int AS table_rows,
 matched_sentences || ' of ' || greatest(total_sentences_doc1, total_sentences_doc2) || ' sentences matched' AS matched
 FROM summ LEFT JOIN (SELECT pair_id, count(*) AS n FROM diffs GROUP BY ALL) USING (pair_id)""",
        "clean_text": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
        "ocr_quality": f"SELECT doc_id, {quality('text')} AS quality FROM documents WHERE text IS NOT NULL",
        "extract_confidence": f"""WITH {UNITS}, {UPLOADS}, b AS (SELECT f.doc_id, ext, coalesce(string_agg(text, chr(10) ORDER BY seq), '') AS body
 FROM f LEFT JOIN u USING (doc_id) GROUP BY ALL) SELECT doc_id, CASE WHEN {image} THEN 'ocr' ELSE 'direct' END AS method, {conf} AS confidence,
 CASE WHEN {conf} > 0.7::double THEN '' ELSE 'Low OCR quality detected' END AS warnings FROM b""",
        "normalize_sentence": u + f"SELECT doc_id, seq, {norm('text')} AS normalized FROM u",
        "split_long_sentence": u
        + f""", s AS (SELECT doc_id, seq, {split_long('text')} AS ps FROM u WHERE length(text) > 500)
 SELECT doc_id, seq, (k - 1)::int AS part_no, ps[k] AS part FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM s)""",
        "text_preview": "SELECT doc_id, length(text)::int AS n_chars, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS preview FROM documents",
        "word_tokens": u + f"SELECT doc_id, seq, array_to_string(list_sort(list_distinct({toks('text')})), ' ') AS words FROM u",
        "token_jaccard": m
        + f""", x AS (SELECT match_id, list_distinct({toks('text1')}) AS a, list_distinct({toks('text2')}) AS b FROM m)
 SELECT match_id, CASE WHEN coalesce(len(a), 0) = 0 OR coalesce(len(b), 0) = 0 THEN 0.0::double ELSE len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b)))::double END AS jaccard FROM x""",
        "equality_flags": m + f"SELECT match_id, text1 = text2 AS exact, {norm('text1')} = {norm('text2')} AS normalized FROM m",
        "classify_difference": m + f"SELECT match_id, {kind()} AS classification FROM m",
        "severity": m + f"SELECT match_id, {severity(kind())} AS severity FROM m",
        "suggest_corrections": m + f"SELECT match_id, {hints('text1', 'text2')} AS suggestions FROM m",
        "upload_validation": f
        + f"""SELECT doc_id, {SUFFIX} AS suffix, coalesce({SUFFIX} IN ('.pdf', '.png', '.jpg', '.jpeg', '.txt', '.doc', '.docx') AND n_bytes <= 10485760, false) AS accepted FROM f""",
        "reader_dispatch": f
        + """SELECT CASE lower('.' || ext) WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'image' WHEN '.jpg' THEN 'image' WHEN '.jpeg' THEN 'image'
 WHEN '.txt' THEN 'text' WHEN '.docx' THEN 'word' WHEN '.doc' THEN 'word' ELSE 'none' END AS reader, count(*) AS files FROM f GROUP BY ALL""",
        "retention_listing": f
        + "SELECT doc_id, uploaded_at FROM f WHERE epoch_us((SELECT max(uploaded_at) FROM f)) - epoch_us(uploaded_at) > 86400000000",
        "sentence_chunks": f"""WITH {CHUNKS} SELECT doc_id, seq, CASE WHEN is_split THEN seq ELSE pos::int END AS sent_id, text, start_char, end_char,
 length(text)::int AS length, is_split FROM numbered""",
        "chunk_statistics": u
        + """SELECT d.doc_id, coalesce(count(u.seq), 0) AS total_sentences, coalesce(avg(length), 0) AS avg_length, coalesce(min(length), 0)::int AS min_length,
 coalesce(max(length), 0)::int AS max_length, coalesce(sum(length), 0)::bigint AS total_chars FROM (SELECT DISTINCT doc_id FROM upload_file) d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id""",
        "sentence_context": u
        + """SELECT doc_id, seq, coalesce(lag(text) OVER w, '') AS before, text AS target, coalesce(lead(text) OVER w, '') AS after FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""",
        "paragraph_groups": u
        + """, x AS (SELECT doc_id, seq, CASE WHEN start_char - lag(end_char) OVER (PARTITION BY doc_id ORDER BY seq) > 2 THEN 1 ELSE 0 END AS new FROM u)
 SELECT doc_id, seq, (sum(new) OVER (PARTITION BY doc_id ORDER BY seq))::int AS paragraph_id FROM x""",
        "vector_cosine": """WITH v AS (SELECT doc_id, seq, vec_id, embedding FROM sentence_vector WHERE embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id) = 1),
 x AS (SELECT a.vec_id, b.vec_id AS next_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS c FROM v a JOIN v b ON b.doc_id = a.doc_id AND b.seq = a.seq + 1)
 SELECT vec_id, next_id, round(c, 6) AS similarity FROM x WHERE c IS NOT NULL AND NOT isnan(c)""",
        "similarity_edges": e + "SELECT pair_id, i, j, similarity FROM e",
        "threshold_edges": e + "SELECT pair_id, i, j, similarity FROM e WHERE similarity >= 0.85::double",
        "ranked_edges": e
        + "SELECT pair_id, i, j, row_number() OVER (PARTITION BY pair_id ORDER BY similarity DESC, i DESC, j DESC)::int AS place FROM e WHERE similarity >= 0.85::double",
        "context_rule": e
        + """SELECT a.pair_id, a.i, a.j, a.similarity, (SELECT count(*) FROM e b WHERE b.pair_id = a.pair_id AND b.i - b.j = a.i - a.j AND abs(b.i - a.i) BETWEEN 1 AND 2
 AND b.similarity > 0.7::double)::int AS supports FROM e a WHERE a.similarity >= 0.85::double""",
        "greedy_match": g + "SELECT * FROM gm",
        "unmatched_doc1": g + "SELECT * FROM only1",
        "unmatched_doc2": g + "SELECT * FROM only2",
        "match_documents": g + "SELECT pair_id, match_rank, index1, index2, text1, text2, exact_match, normalized_match FROM mm",
        "match_score": g + "SELECT pair_id, round(match_score, 9) AS match_score FROM sc",
        "match_quality": g
        + "SELECT pair_id, total_matches, exact_matches, minor_differences, rewordings, significant_differences, round(avg_similarity, 9) AS avg_similarity FROM qual",
        "class_counts": m + f"SELECT pair_id, {kind()} AS classification, count(*) AS n FROM m GROUP BY ALL",
        "reorderings": g + "SELECT * FROM moved",
        "stored_reorderings": m
        + "SELECT pair_id, match_rank, index1 AS expected_position, index2 AS actual_position, index2 - index1 AS displacement FROM m WHERE abs(index1 - index2) > 4",
        "differences": g + "SELECT * REPLACE (round(similarity, 9) AS similarity) FROM diffs",
        "ordered_differences": g + "SELECT pair_id, place::int AS place, type, position1, position2 FROM placed",
        "report_summary": g + "SELECT * FROM summ",
        "verdict": g + "SELECT pair_id, status, message, color, confidence FROM ver",
        "recommendations": g + "SELECT * FROM rec",
        "comparison_report": report,
        "similar_text_groups": u
        + f"SELECT {norm('text')} AS normalized, count(*) AS units, count(DISTINCT doc_id) AS documents FROM u GROUP BY 1 HAVING count(*) > 1",
    }
