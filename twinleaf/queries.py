"""The queries of the comparison engine over the tables of one directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinleaf.config import DEFAULTS
from twinleaf.functions import text as tx
from twinleaf.operators import matching, report, sentences, similarity
from twinleaf.oracle import oracle_sql  # noqa: F401
from twinleaf.plans.compare import Comparison
from twinleaf.plans.render import report_html, report_json
from twinleaf.sources import table
from twinleaf.sources.files import accepted, expired, read_documents, reader_of
from twinleaf.sources.work import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.latest_units(table(spark, d, "sentence"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """The stored matches once each, with the texts of both sides."""
    m = table(spark, d, "sentence_match").dropDuplicates(["match_id"])
    return m.withColumns({"text1": F.col("sent1.text"), "text2": F.col("sent2.text")})


def _comparison(spark: SparkSession, d: str) -> Comparison:
    return Comparison(table(spark, d, "doc_pair"), _units(spark, d))


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """Uploads once each; of rows sent twice the one received last."""
    last = F.max_by(F.struct("name", "ext", "n_bytes", "uploaded_at"), F.struct("received_at", "name")).alias("r")
    return table(spark, d, "upload_file").groupBy("doc_id").agg(last).select("doc_id", "r.*")


# Texts


@_query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@_query
def ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", tx.ocr_quality(F.col("text")).alias("quality"))


@_query
def extract_confidence(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("u"))
    text = F.array_join(F.transform("u", lambda x: x["text"]), "\n")
    rows = _uploads(spark, d).join(units, "doc_id", "left").withColumn("text", F.coalesce(text, F.lit("")))
    image = tx.is_image(F.concat(F.lit("."), F.col("ext")))
    rows = rows.withColumn("method", F.when(image, "ocr").otherwise("direct")).withColumn(
        "confidence", F.when(image, tx.ocr_quality(F.col("text"))).otherwise(F.lit(1.0))
    )
    warning = F.when(F.col("confidence") > DEFAULTS.ocr_warning_at, "").otherwise("Low OCR quality detected")
    return rows.select("doc_id", "method", "confidence", warning.alias("warnings"))


@_query
def normalize_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("doc_id", "seq", tx.normalize_sentence(F.col("text")).alias("normalized"))


@_query
def split_long_sentence(spark: SparkSession, d: str) -> DataFrame:
    rows = _units(spark, d).where(F.length("text") > DEFAULTS.max_sentence_length)
    return rows.select("doc_id", "seq", F.posexplode(tx.split_long(F.col("text"))).alias("part_no", "part"))


@_query
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.length(t).alias("n_chars"), tx.preview(t).alias("preview"))


@_query
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_sort(F.array_distinct(tx.tokens(F.col("text"))))
    return _units(spark, d).select("doc_id", "seq", F.array_join(words, " ").alias("words"))


@_query
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("match_id", tx.jaccard(F.col("text1"), F.col("text2")).alias("jaccard"))


@_query
def equality_flags(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("text1"), F.col("text2")
    same = tx.normalize_sentence(a) == tx.normalize_sentence(b)
    return _matches(spark, d).select("match_id", (a == b).alias("exact"), same.alias("normalized"))


@_query
def classify_difference(spark: SparkSession, d: str) -> DataFrame:
    kind = tx.classify(F.col("exact_match"), F.col("normalized_match"), F.col("similarity"))
    return _matches(spark, d).select("match_id", kind.alias("classification"))


@_query
def severity(spark: SparkSession, d: str) -> DataFrame:
    kind = tx.classify(F.col("exact_match"), F.col("normalized_match"), F.col("similarity"))
    return _matches(spark, d).select("match_id", tx.severity(kind).alias("severity"))


@_query
def suggest_corrections(spark: SparkSession, d: str) -> DataFrame:
    hints = tx.suggestions(F.col("text1"), F.col("text2"))
    return _matches(spark, d).select("match_id", F.array_join(hints, " | ").alias("suggestions"))


# Uploads


@_query
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _uploads(spark, d)
    return rows.select("doc_id", tx.suffix(F.col("name")).alias("suffix"), accepted(F.col("name"), F.col("n_bytes")).alias("accepted"))


@_query
def reader_dispatch(spark: SparkSession, d: str) -> DataFrame:
    reader = F.coalesce(reader_of(F.concat(F.lit("."), F.col("ext"))), F.lit("none"))
    return _uploads(spark, d).groupBy(reader.alias("reader")).agg(F.count(F.lit(1)).alias("files"))


@_query
def retention_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = _uploads(spark, d)
    now = rows.agg(F.max("uploaded_at")).scalar()
    return expired(rows, "uploaded_at", now, 24.0).select("doc_id", "uploaded_at")


@_query
def read_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents with a text as files of the shared folder, read back."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    docs = _docs(spark, d).where("doc_id is not null and text is not null")
    docs.write.partitionBy("doc_id").text(folder)
    rows = read_documents(spark, folder)
    doc_id = F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("long")
    return rows.where("ext = '.txt'").select(doc_id.alias("doc_id"), "ext", "text", F.col("error").isNotNull().alias("refused"))


@_query
def extract_payload(spark: SparkSession, d: str) -> DataFrame:
    """What an extraction returns: file name, text, length and preview."""
    t = F.col("text")
    rows = table(spark, d, "documents").select("doc_id", F.col("name").alias("filename"), "text")
    return rows.select("doc_id", "filename", "text", F.length(t).alias("length"), tx.preview(t).alias("preview"))


@_query
def engine_config(spark: SparkSession, d: str) -> DataFrame:
    """The settings in one row."""
    values = asdict(DEFAULTS) | {"allowed_extensions": ",".join(DEFAULTS.allowed_extensions)}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# Sentences


@_query
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_chunks(_docs(spark, d))


@_query
def chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    return sentences.chunk_statistics(table(spark, d, "upload_file"), _units(spark, d))


@_query
def sentence_context(spark: SparkSession, d: str) -> DataFrame:
    rows = sentences.sentence_context(_units(spark, d))
    return rows.select("doc_id", "seq", F.array_join("before", " ¶ ").alias("before"), "target", F.array_join("after", " ¶ ").alias("after"))


@_query
def paragraph_groups(spark: SparkSession, d: str) -> DataFrame:
    return sentences.paragraph_groups(_units(spark, d))


# Similarity and matching


@_query
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "sentence_vector").where("embedding is not null").dropDuplicates(["vec_id"])
    v = v.select("doc_id", "seq", "vec_id", "embedding")
    nxt = v.select("doc_id", (F.col("seq") - 1).alias("seq"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("e2"))
    rows = v.join(nxt, ["doc_id", "seq"]).withColumn("c", similarity.cosine(F.col("embedding"), F.col("e2")))
    return rows.select("vec_id", "next_id", F.round("c", 6).alias("similarity")).where("c is not null")


@_query
def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).edges


def _by_vectors(spark: SparkSession, d: str) -> Comparison:
    """Every upload that has stored vectors against the first of them, compared by these. The pairs asked for have none."""
    vectors = table(spark, d, "sentence_vector")
    ids = vectors.where("embedding is not null and doc_id is not null").select("doc_id").distinct()
    pairs = ids.select(F.col("doc_id").alias("pair_id"), ids.agg(F.min("doc_id")).scalar().alias("doc_id1"), F.col("doc_id").alias("doc_id2"))
    return Comparison(pairs, _units(spark, d), vectors=vectors)


@_query
def vector_edges(spark: SparkSession, d: str) -> DataFrame:
    return _by_vectors(spark, d).edges


@_query
def vector_match(spark: SparkSession, d: str) -> DataFrame:
    return _by_vectors(spark, d).matches.drop("text1", "text2")


@_query
def refused_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).refused


@_query
def threshold_edges(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).edges.where(F.col("similarity") >= DEFAULTS.similarity_threshold)


@_query
def ranked_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _comparison(spark, d).edges.where(F.col("similarity") >= DEFAULTS.similarity_threshold)
    return similarity.ranked_edges(edges).select("pair_id", "i", "j", "place")


@_query
def context_rule(spark: SparkSession, d: str) -> DataFrame:
    return matching.context_checks(_comparison(spark, d).edges)


@_query
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    c = _comparison(spark, d)
    return matching.greedy_match(c.edges, c.sizes)


@_query
def unmatched_doc1(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).unmatched(1)


@_query
def unmatched_doc2(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).unmatched(2)


@_query
def match_documents(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).matches.drop("similarity")


@_query
def match_score(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).scores.select("pair_id", F.round("match_score", 9).alias("match_score"))


# Reports


@_query
def match_quality(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).quality.withColumn("avg_similarity", F.round("avg_similarity", 9))


@_query
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = tx.classify(F.col("exact_match"), F.col("normalized_match"), F.col("similarity"))
    return _matches(spark, d).groupBy("pair_id", kind.alias("classification")).agg(F.count(F.lit(1)).alias("n"))


@_query
def reorderings(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).reorderings


@_query
def stored_reorderings(spark: SparkSession, d: str) -> DataFrame:
    rows = report.reorderings(_matches(spark, d).select("match_id", "pair_id", "match_rank", "text1", "index1", "index2"))
    return rows.select("pair_id", "match_rank", "expected_position", "actual_position", "displacement")


@_query
def moved_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The stored matches with the second document read from its end: nearly all have moved."""
    last = F.max("index2").over(Window.partitionBy("pair_id"))
    turned = _matches(spark, d).withColumn("index2", last - F.col("index2"))
    return report.reorderings(turned).select("pair_id", "match_rank", "expected_position", "actual_position", "displacement")


def _listed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"suggestions": F.array_join("suggestions", " | "), "similarity": F.round("similarity", 9)})


@_query
def differences(spark: SparkSession, d: str) -> DataFrame:
    return _listed(_comparison(spark, d).differences)


@_query
def ordered_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = report.ordered_differences(_comparison(spark, d).differences)
    return rows.select("pair_id", "place", "type", "position1", "position2")


@_query
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).summary


@_query
def verdict(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).verdicts


@_query
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d).recommendations.withColumn("recommendations", F.array_join("recommendations", " | "))


@_query
def comparison_report(spark: SparkSession, d: str) -> DataFrame:
    r = _comparison(spark, d).report()
    return r.select(
        "pair_id", "summary.overall_match", "summary.matched_sentences", "summary.significant_differences", "verdict.status",
        "verdict.confidence", F.size("differences").alias("n_differences"), F.size("reorderings").alias("n_reorderings"),
        F.array_join(F.transform("differences", lambda x: x["type"]), ",").alias("difference_types"),
        F.array_join("recommendations", " | ").alias("recommendations"),
    )


@_query
def report_as_json(spark: SparkSession, d: str) -> DataFrame:
    return report_json(_comparison(spark, d).report())


@_query
def report_as_html(spark: SparkSession, d: str) -> DataFrame:
    return report_html(_comparison(spark, d).report(), table(spark, d, "doc_pair"))


@_query
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """The JSON report read back: the figures of its parts."""
    reports = _comparison(spark, d).report()
    like = reports.drop("pair_id").schema
    r = report_json(reports).select("pair_id", F.from_json("report", like).alias("r"))
    return r.select(
        "pair_id", "r.summary.overall_match", "r.summary.matched_sentences", "r.summary.significant_differences", "r.verdict.status",
        "r.verdict.confidence", F.size("r.differences").alias("n_differences"), F.size("r.reorderings").alias("n_reorderings"),
        F.array_join(F.transform("r.differences", lambda x: x["type"]), ",").alias("difference_types"),
        F.array_join("r.recommendations", " | ").alias("recommendations"),
    )


@_query
def html_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the pages: rows of the table of differences, and how many sentences were matched."""
    page = F.col("html")
    rows = report_html(_comparison(spark, d).report(), table(spark, d, "doc_pair"))
    matched = F.regexp_extract(page, ", ([0-9]+ of [0-9]+ sentences matched)</p>", 1)
    return rows.select("pair_id", F.regexp_count(page, F.lit("<tr>")).alias("table_rows"), matched.alias("matched"))


@_query
def similar_text_groups(spark: SparkSession, d: str) -> DataFrame:
    """Units of equal normalized text: one row per text with its number of units and documents."""
    rows = _units(spark, d).withColumn("normalized", tx.normalize_sentence(F.col("text")))
    by_doc = rows.groupBy("normalized", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("normalized").agg(F.sum("n").alias("units"), F.count(F.lit(1)).alias("documents")).where("units > 1")
