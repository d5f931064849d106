"""Document files as text: plain text, Word, and - where their libraries are installed - PDF and images."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinleaf.config import DEFAULTS, Settings
from twinleaf.functions.text import clean_text, suffix

_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
IMAGES = (".png", ".jpg", ".jpeg")


def accepted(name: Column, length: Column, cfg: Settings = DEFAULTS) -> Column:
    """Whether a file has a readable type and is not too large; false where either is unknown."""
    return F.coalesce(suffix(name).isin(*cfg.allowed_extensions) & (length <= cfg.max_upload_size), F.lit(False))


def reader_of(ext: Column) -> Column:
    """The reader that an extension (with its dot) is sent to; null where there is none."""
    e = F.lower(ext)
    return F.when(e == ".pdf", "pdf").when(e.isin(*IMAGES), "image").when(e == ".txt", "text").when(e.isin(".docx", ".doc"), "word")


def word_text(content: bytes) -> str:
    """The paragraphs of a Word container, one per line. Legacy binary files are no containers and are refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError) as e:
        raise ValueError("not a Word container") from e
    lines = []
    for p in root.iter(f"{_WORD_NS}p"):
        runs = []
        for node in p.iter():
            if node.tag == f"{_WORD_NS}t":
                runs.append(node.text or "")
            elif node.tag == f"{_WORD_NS}tab":
                runs.append("\t")
            elif node.tag in (f"{_WORD_NS}br", f"{_WORD_NS}cr"):
                runs.append("\n")
        lines.append("".join(runs))
    return "\n".join(lines)


def _image_text(content: bytes) -> str:
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise ValueError("image text needs the optional libraries pytesseract and PIL") from e
    return pytesseract.image_to_string(Image.open(io.BytesIO(content)).convert("RGB"))


def _pdf_pages(content: bytes) -> list[str]:
    try:
        import fitz
    except ImportError as e:
        raise ValueError("PDF text needs the optional library PyMuPDF") from e
    pages = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            text = page.get_text()
            if not text.strip():
                try:
                    text = _image_text(page.get_pixmap(matrix=fitz.Matrix(2, 2)).tobytes("png"))
                except Exception:  # a page that can't be recognized is empty, as one without text
                    text = ""
            pages.append(text)
    return pages


#: By reader: the pages of a file.
READERS = {
    "text": lambda c: [c.decode("utf-8")],
    "word": lambda c: [word_text(c)],
    "image": lambda c: [_image_text(c)],
    "pdf": _pdf_pages,
}


def read_pages(spark: SparkSession, path: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """The files under ``path``: ``path``, ``name``, ``ext``, ``length``, ``page_no`` (from 1), ``text``, ``error``.

    Only accepted files are opened: type and size are tested on the listing. The others, and files that can't be read,
    come out as one row with null page and text and the reason in ``error``.
    """
    name = F.element_at(F.split("path", "/"), -1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = listed.withColumn("name", name).withColumn("ext", suffix(name))
    good = accepted(F.col("name"), F.col("length"), cfg)
    refused = listed.where(~good).select(
        "path", "name", "ext", "length", F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text"),
        F.lit("type or size not accepted").alias("error"),
    )
    # The size is tested apart, since the listing applies it before a file is read.
    opened = listed.where(F.col("length") <= cfg.max_upload_size).where(good).withColumn("reader", reader_of(F.col("ext")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    pages = READERS[r.reader](r.content)
                    out += [(r.path, r.name, r.ext, r.length, k, t, None) for k, t in enumerate(pages, 1)]
                except Exception as e:
                    out.append((r.path, r.name, r.ext, r.length, None, None, f"{type(e).__name__}: {e}"))
            rows = pd.DataFrame(out, columns=["path", "name", "ext", "length", "page_no", "text", "error"])
            yield rows.astype({"page_no": "Int64"})

    schema = "path string, name string, ext string, length long, page_no int, text string, error string"
    return opened.select("path", "name", "ext", "length", "content", "reader").mapInPandas(read, schema).unionByName(refused)


def read_documents(spark: SparkSession, path: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """The files under ``path``: ``path``, ``name``, ``ext``, ``length``, ``text``, ``error``.

    Pages are joined by blank lines. Text files are taken as they are, the others cleaned. Files of other types or above
    the size limit, and those that can't be read, have null text and the reason in ``error``.
    """
    page = F.when(F.col("page_no").isNotNull(), F.struct("page_no", "text"))
    rows = read_pages(spark, path, cfg).groupBy("path", "name", "ext", "length").agg(
        F.array_sort(F.collect_list(page)).alias("pages"), F.first("error").alias("error")
    )
    raw = F.when(F.col("error").isNull(), F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n"))
    return rows.select("path", "name", "ext", "length", F.when(F.col("ext") == ".txt", raw).otherwise(clean_text(raw)).alias("text"), "error")


def expired(files: DataFrame, modified: str, now: Column, hours: float = 24) -> DataFrame:
    """The files whose time ``modified`` lies more than ``hours`` before ``now``."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(modified).cast("timestamp"))
    return files.where(age > int(hours * 3_600_000_000))
