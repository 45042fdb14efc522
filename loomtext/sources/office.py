"""Word documents: paragraphs and tables, read from the file's own XML."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions.text import clean_text

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(p: ElementTree.Element) -> str:
    """Text of a paragraph; tabs and breaks as they print."""
    out = []
    for x in p.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _body(content: bytes) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")


def read_docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """file, no, text: paragraphs of the documents that are not blank; those inside tables do not count."""
    def run(batches):
        for df in batches:
            rows = []
            for f, c in zip(df["path"], df["content"]):
                texts = [_text(p) for p in _body(c).findall(_W + "p")]
                rows += [(f, i, t) for i, t in enumerate(t for t in texts if t.strip())]
            yield pd.DataFrame(rows, columns=["file", "no", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, no int, text string")


def read_docx_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, table, row, cells: rows of the documents' tables, cells as lists of texts."""
    def run(batches):
        for df in batches:
            rows = []
            for f, c in zip(df["path"], df["content"]):
                for n, t in enumerate(_body(c).findall(_W + "tbl")):
                    for r, tr in enumerate(t.findall(_W + "tr")):
                        rows.append((f, n, r, ["\n".join(_text(p) for p in tc.findall(_W + "p")) for tc in tr.findall(_W + "tc")]))
            yield pd.DataFrame(rows, columns=["file", "table", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, table int, row int, cells array<string>")


def verse_table(rows: DataFrame, columns: dict[str, int], verse_column: int, first_row: int = 1) -> DataFrame:
    """file, table, source, verse, text: a parallel table's columns by verse.

    ``rows``: file, table, row, cells.  A verse begins at the row whose ``verse_column`` names it, '(3)' or '(3a-c)'; rows in between belong to
    the verse before, those from ``first_row`` on to verse 1.  Verses must come in rising order: a smaller number later is no
    beginning.  Cells are cleaned, empty ones left out, and joined by blank lines.
    """
    r = rows.select("file", "table", "row", "cells", F.regexp_extract(F.get("cells", verse_column), r"(?i)\(\s*(\d+)[a-d-]*\s*\)", 1).try_cast("int").alias("named")).where(F.col("row") >= first_row)
    w = Window.partitionBy("file", "table").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("named").over(w)
    r = r.withColumn("start", F.when(F.col("named") > F.coalesce(top, F.lit(0)), F.col("named")))
    r = r.withColumn("verse", F.coalesce(F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)))
    cells = F.array(*[F.struct(F.lit(s).alias("source"), clean_text(F.get("cells", c)).alias("text")) for s, c in columns.items()])
    t = r.select("file", "table", "row", "verse", F.inline(cells)).where("text <> ''")
    g = t.groupBy("file", "table", "source", "verse").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("x"))
    return g.select("file", "table", "source", "verse", F.array_join(F.transform("x", lambda x: x.text), "\n\n").alias("text"))


def dehyphenated(text):
    """Text of a PDF's pages: words divided at line ends joined, blanks squeezed; line feeds stay."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=[\p{L}\p{M}\p{N}_])-\s*\n\s*(?=[\p{L}\p{M}\p{N}_])", ""), "[ \t]+", " ")
