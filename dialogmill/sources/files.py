"""Texts of files: several encodings, Word documents, Unicode forms. Files come through Spark's binaryFile source."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the encodings in the order in which they are tried, the endings of plain texts, and the bounds of the choice between texts
ENCODINGS = ("utf-8-sig", "utf-8", "cp1254", "latin-1")
PLAIN = {"txt", "md", "json", "yaml", "yml", "csv", "tsv"}
SCANT_CHARS, LONGER = 80, 1.1


def decode(data: bytes) -> str:
    """By the first encoding that fits."""
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def compact(text: str) -> str:
    """Compatibility forms composed, line ends of one kind, no blanks at the ends, no more than one empty line in a row."""
    unix = "\n".join(unicodedata.normalize("NFKC", text).split("\r\n"))
    return re.sub("\n\n\n+", "\n\n", unix.strip())


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word document that have text, a line each."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        paragraphs = ElementTree.fromstring(z.read("word/document.xml")).iter(space + "p")
        return "\n".join(filter(None, ("".join(n.text or "" for n in p.iter(space + "t")).strip() for p in paragraphs)))


def extract(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(parser, text) of a file by its ending; no text for kinds that need other programs, for damaged files and for empty ones."""
    kind = name.rsplit(".", 1)[-1].lower()
    parser = "text" if kind in PLAIN else "docx" if kind == "docx" else None
    if parser is None:
        return None, None
    try:
        return parser, compact(decode(data) if parser == "text" else docx_text(data)) or None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return parser, None


def chosen_text(embedded: Column, scanned: Column, mode: str = "auto") -> Column:
    """struct(text, parser) of a document with an embedded text and a recognised one (null where there is none).

    ``auto`` looks at the recognised text of scant documents only, ``always`` at all, ``never`` at none; it is taken if the embedded
    one is scant or clearly shorter.
    """
    own, other = F.coalesce(embedded, F.lit("")), F.coalesce(scanned, F.lit(""))
    blank = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    scant = F.length(blank(own)) < SCANT_CHARS
    looked = {"auto": scant, "always": F.lit(True), "never": F.lit(False)}[mode]
    take = looked & (blank(other) != "") & (scant | (F.length(other) > F.length(own) * LONGER))
    return F.struct(F.when(take, other).otherwise(own).alias("text"), F.when(take, "ocr").otherwise("pdf_text").alias("parser"))


def read_texts(spark: SparkSession, path: str, max_chars: int = 90_000) -> DataFrame:
    """path, parser, text, truncated of all files; the text is cut at ``max_chars`` characters, as profiles are."""
    @F.pandas_udf("parser string, text string")
    def texts(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(n, bytes(c)) for n, c in zip(names, contents, strict=True)], columns=["parser", "text"])

    rows = spark.read.format("binaryFile").load(path).select("path", texts("path", "content").alias("x"))
    return rows.select("path", "x.parser", F.substring("x.text", 1, max_chars).alias("text"), F.coalesce(F.length("x.text") > max_chars, F.lit(False)).alias("truncated"))


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """Unicode normalisation, which has no built-in function."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return normal(c)
