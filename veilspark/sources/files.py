"""Document files as rows: text, Word, Excel and PDF files of a folder."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "docx", "xlsx", "txt")


def list_files(spark: SparkSession, folder: str, names: list[str] | None = None, most: int | None = None, ordered: bool = True) -> DataFrame:
    """(file_name, ext, path, length, content) of the supported files, by lower-cased name; some ``names``, or the first ``most``.

    What is wanted is settled on the listing: no other file is opened. A job that reads contents has no use for an order: with ``ordered`` false contents
    are not sorted, and not shuffled. Spark's reader leaves out files of no bytes.
    """
    found, order = _files(spark, folder, names), [F.lower("file_name"), F.col("file_name")]
    if most is not None:
        # Without its content a file is listed, not read; at most ``most`` names come to the driver.
        first = found.select("file_name").orderBy(*order).limit(most)
        found = _files(spark, folder, [r.file_name for r in first.collect()])
    return found.orderBy(*order) if ordered else found


def _files(spark: SparkSession, folder: str, names: list[str] | None) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if names is not None:
        read = read.option("pathGlobFilter", "{" + ",".join(re.sub(r"([\\\[\]{}*?,^!-])", r"\\\1", n) for n in names) + "}")
    df = read.load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    df = df.select(name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "path", "length", "content")
    df = df.where(F.col("ext").isin(*SUFFIXES))
    if names is not None:
        df = df.where(F.col("file_name").isin(*names))
    return df


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(file_name) of ``names`` that the folder does not have."""
    wanted = spark.createDataFrame([(n,) for n in names], "file_name string")
    return wanted.join(list_files(spark, folder, ordered=False).select("file_name"), "file_name", "left_anti")


def extract(files: DataFrame) -> DataFrame:
    """(file_name, ext, text, error) of ``list_files``; a file that cannot be read has a null text and says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for ext, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    texts.append(READERS[ext](content))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["file_name", "ext", "text", "error"])

    return files.select("file_name", "ext", "content").mapInArrow(run, "file_name string, ext string, text string, error string")


def read_txt(content: bytes) -> str:
    """UTF-8; bytes that are not are left out."""
    return content.decode("utf-8", "ignore")


def read_pdf(content: bytes) -> str:
    """Page texts, one line feed between them; needs pypdf."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_docx(content: bytes) -> str:
    """Paragraphs that are not blank, then the tables' rows with cells parted by bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")

    def text_of(node) -> str:
        pieces = []
        for n in node.iter():
            if n.tag == f"{WORD}t":
                pieces.append(n.text or "")
            elif n.tag == f"{WORD}tab":
                pieces.append("\t")
            elif n.tag in (f"{WORD}br", f"{WORD}cr"):
                pieces.append("\n")
        return "".join(pieces)

    lines = [t for p in body.findall(f"{WORD}p") if (t := text_of(p)).strip()]
    for table in body.findall(f"{WORD}tbl"):
        for row in table.findall(f"{WORD}tr"):
            cells = ["\n".join(text_of(p) for p in c.findall(f"{WORD}p")).strip() for c in row.findall(f"{WORD}tc")]
            if any(cells):
                lines.append(" | ".join(cells))
    return "\n".join(lines)


def read_xlsx(content: bytes) -> str:
    """Every sheet under its title, a line for each row of the cells that are not blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in root.findall(f"{SHEET}si")]
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): re.sub(r"^/?(?:xl/)?", "xl/", r.get("Target")) for r in rels}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        lines = []
        for sheet in book.iter(f"{SHEET}sheet"):
            lines.append(f"[Sheet: {sheet.get('name')}]")
            for row in ElementTree.fromstring(z.read(target[sheet.get(LINK)])).iter(f"{SHEET}row"):
                cells = [v for c in row.findall(f"{SHEET}c") if (v := _cell(c, shared)).strip()]
                if cells:
                    lines.append(" | ".join(cells))
    return "\n".join(lines)


def _cell(cell, shared: list[str]) -> str:
    kind, value = cell.get("t"), cell.find(f"{SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    raw = value.text or "" if value is not None else ""
    if kind == "s" and raw:
        return shared[int(raw)]
    if kind == "b" and raw:
        return "True" if raw == "1" else "False"
    return raw


READERS = {"txt": read_txt, "pdf": read_pdf, "docx": read_docx, "xlsx": read_xlsx}


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, file_name, ext, text) of the files that could be read; the id is the first 60 bits of the name's MD5."""
    text = extract(files).where("error IS NULL")
    doc_id = F.conv(F.substring(F.md5("file_name"), 1, 15), 16, 10).cast("bigint")
    return text.select(doc_id.alias("doc_id"), "file_name", "ext", "text")
