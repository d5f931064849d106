"""Sinks of reports: JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinleaf.functions.text import escape_html, label

SHEET = """
main { max-width: 70rem; margin: auto; font: 1rem/1.5 Georgia, serif }
table { width: 100%; border-collapse: collapse }
th, td { text-align: left; vertical-align: top; padding: 0 1ch; border-bottom: thin solid silver }
td:nth-child(2) { font-variant: small-caps }
""".strip()


def report_json(reports: DataFrame) -> DataFrame:
    """``pair_id`` and the report as one JSON text."""
    return reports.select("pair_id", F.to_json(F.struct(*[c for c in reports.columns if c != "pair_id"])).alias("report"))


def percent(c: Column) -> Column:
    """A share as text with one decimal."""
    return F.format_string("%.1f%%", c.cast("double") * 100)


def matched_text(summary: Column) -> Column:
    """How many sentences were matched, out of the longer side."""
    longer = F.greatest(summary["total_sentences_doc1"], summary["total_sentences_doc2"])
    return F.concat(summary["matched_sentences"].cast("string"), F.lit(" of "), longer.cast("string"), F.lit(" sentences matched"))


def side_text(sentence: Column, side: int) -> Column:
    """The sentence of one side, or that it is missing there."""
    return F.coalesce(sentence, F.lit(f"Missing in Document {side}"))


def _element(name: str, *content: Column | str) -> Column:
    inner = [F.lit(c) if isinstance(c, str) else c for c in content]
    return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))


def _plain(c: Column) -> Column:
    return escape_html(F.coalesce(c.cast("string"), F.lit("")))


def _each(name: str, items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: _element(name, _plain(x))), "")


def _cells(d: Column, k: Column) -> Column:
    """One difference as a row: what it is, where it stands, both texts, how alike they are, and what to look at."""
    places = F.concat_ws(" / ", *[F.coalesce(d[f"position{n}"].cast("string"), F.lit("–")) for n in (1, 2)])
    hints = F.concat(percent(d["similarity"]), _each("div", d["suggestions"]))
    cells = (
        (k + 1).cast("string"), d["severity"], F.concat_ws(", ", label(d["type"]), label(d["classification"])), places,
        _plain(side_text(d["sentence1"], 1)), _plain(side_text(d["sentence2"], 2)), hints,
    )
    return _element("tr", *[_element("td", c) for c in cells])


COLUMNS = ("No.", "Weight", "Kind", "Places", "Left text", "Right text", "Likeness and hints")


def report_html(reports: DataFrame, names: DataFrame) -> DataFrame:
    """``pair_id`` and a page for each report; ``names`` has ``pair_id``, ``file1_name``, ``file2_name``. Texts are escaped.

    The page lists all figures of the summary under their column names, all differences as one table, moved sentences
    and the advice. Parts without rows say so.
    """
    summary = F.col("summary")
    figures = reports.schema["summary"].dataType.fieldNames()
    terms = F.concat(*[x for c in figures for x in (_element("dt", label(F.lit(c))), _element("dd", _plain(summary[c])))])
    head = _element("tr", *[_element("th", c) for c in COLUMNS])
    rows = F.array_join(F.transform("differences", _cells), "")
    table = F.when(F.size("differences") > 0, _element("table", head, rows)).otherwise(_element("p", "The texts do not differ."))

    def move(r: Column) -> Column:
        steps = F.concat_ws(" → ", r["expected_position"].cast("string"), r["actual_position"].cast("string"))
        return _element("li", _plain(r["sentence"]), " (", steps, ")")

    moves = F.array_join(F.transform("reorderings", move), "")
    moved = F.when(F.size("reorderings") > 0, _element("ul", moves)).otherwise(_element("p", "No sentence has moved."))
    title = F.concat_ws(" ↔ ", _plain(F.col("file1_name")), _plain(F.col("file2_name")))
    page = F.concat(
        F.lit("<!DOCTYPE html>"), _element("style", SHEET),
        _element(
            "main", _element("h1", title), _element("p", _element("b", _plain(F.col("verdict.message"))), ", ", matched_text(summary)),
            _element("h2", "What differs"), table, _element("h2", "What moved"), moved,
            _element("h2", "What to do"), _element("ol", _each("li", F.col("recommendations"))),
            _element("h2", "Figures"), _element("dl", terms),
        ),
    )
    one = names.select("pair_id", "file1_name", "file2_name").dropDuplicates(["pair_id"])
    return reports.join(one, "pair_id", "left").select("pair_id", page.alias("html"))
