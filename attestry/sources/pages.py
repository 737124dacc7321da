"""Pages out of files: JSON documents, PDF files, and what is checked before anything runs.

A table of pages has doc_id, doc_pos, document_name, page_ord (0-based), page_number and text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.find import trimmed
from ..scratch import numbered

DOCUMENT = "documents array<struct<filename:string,fileSize:bigint,pages:array<struct<pageNumber:int,text:string>>>>"
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 10, 25 << 20, 28 << 20
#: Of a file that can't be parsed: bytes that are looked at, and characters that are kept.
RAW_BYTES, RAW_CHARS, NO_TEXT = 50_000, 10_000, "[No extractable text on page]"


def _listed(files: DataFrame) -> DataFrame:
    """(file, i, d): the documents of JSON files, each with its place in its file."""
    return files.select(F.col("_metadata.file_path").alias("file"), F.posexplode("documents").alias("i", "d"))


def _pages(listed: DataFrame, *more: str) -> DataFrame:
    name = F.coalesce(F.nullif("d.filename", F.lit("")), F.concat(F.lit("Document "), (F.col("i") + 1).cast("string")))
    pages = listed.select("file", "i", name.alias("document_name"), "d.fileSize", *more, F.posexplode("d.pages").alias("page_ord", "p"))
    text = trimmed(F.coalesce("p.text", F.lit("")))
    number = F.coalesce(F.nullif("p.pageNumber", F.lit(0)), F.col("page_ord") + 1)
    return pages.select(F.concat(F.lit("doc_"), F.xxhash64("file").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("doc_id"), *more, "document_name", "page_ord", number.alias("page_number"), text.alias("text"), "fileSize")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON files {documents: [{filename, fileSize, pages: [{pageNumber, text}]}]}. Names and page numbers that are missing are counted up; texts are trimmed.

    doc_pos counts the documents of all files from 0, by the file's path and the place in it.
    """
    listed = _listed(spark.read.schema(DOCUMENT).json(path, multiLine=True))
    places = numbered(listed.select("file", "i"), "doc_pos", "file", "i").withColumn("doc_pos", F.col("doc_pos") - 1)
    return _pages(listed.join(places, ["file", "i"]), "doc_pos")


def stream_json(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """The same pages as a stream of the files that arrive in a folder. There is no doc_pos: whoever keeps the documents numbers them."""
    return _pages(_listed(spark.readStream.schema(DOCUMENT).option("multiLine", True).option("maxFilesPerTrigger", files_at_once).json(path)))


def document_sizes(pages: DataFrame) -> DataFrame:
    """(doc_id, total_pages, file_size): the stated size, or else the characters of all pages."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.coalesce(F.nullif(F.max("fileSize"), F.lit(0)), F.sum(F.length("text"))).alias("file_size"))


_STREAM = re.compile(rb"(?:<<(?P<head>(?:[^<>]|<[^<]|>[^>])*)>>)?\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\((?P<text>(?:\\.|[^\\()])*)\)\s*(?:Tj|')|<(?P<hex>[0-9A-Fa-f\s]*)>\s*Tj|(?P<line>T\*|-?[\d.]+\s+-?[\d.]+\s+T[dD])|\[(?P<array>.*?)\]\s*TJ", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(raw: bytes) -> bytes:
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), raw)


def _page_texts(content: bytes) -> list[str]:
    """The text of each content stream that shows any: one for each page in plain files. Only literal and hexadecimal strings in Latin-1 are read."""
    pages = []
    for found in _STREAM.finditer(content):
        body = found["body"]
        if b"FlateDecode" in (found["head"] or b""):
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        out = b""
        for show in _SHOW.finditer(body):
            if show["line"] is not None:
                out += b"\n" if out and not out.endswith(b"\n") else b""
            elif show["text"] is not None:
                out += _plain(show["text"])
            elif show["hex"] is not None:
                digits = re.sub(rb"\s", b"", show["hex"])
                out += bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                out += b"".join(_plain(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", show["array"]))
        if out.strip():
            pages.append(out.decode("latin-1").strip())
    return pages


def _raw_text(content: bytes) -> str:
    """Of a file without readable streams: its shown strings, as UTF-8, or else its printable ASCII."""
    head = content[:RAW_BYTES]
    said = b" ".join(_plain(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*Tj", head)) or re.sub(rb"[^\x20-\x7e\n]+", b" ", head)
    return said.decode("utf-8", "replace")[:RAW_CHARS]


def read_pdf(spark: SparkSession, path: str, collapse: bool = False) -> DataFrame:
    """Pages of PDF files, document by document in the order of their paths. With `collapse`, runs of white space are one space (so each page is a line) and empty pages hold a note.

    A file without readable streams is one page: its literal strings, or else its printable ASCII, from the first
    RAW_BYTES bytes. Rows travel by file, so memory follows the largest file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["path"], frame["content"], strict=True):
                texts = _page_texts(content)
                texts = texts or [_raw_text(content)]
                rows += [(file, i, t) for i, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["path", "page_ord", "text"])

    pages = files.mapInPandas(run, "path string, page_ord int, text string")
    text = F.regexp_replace("text", r"\s+", " ") if collapse else F.col("text")
    text = trimmed(text)
    name = F.element_at(F.split("path", "/"), -1)
    order = numbered(files.select("path"), "doc_pos", "path").withColumn("doc_pos", F.col("doc_pos") - 1)
    named = pages.join(order, "path")
    return named.select(F.concat(F.lit("doc_"), F.xxhash64("path").cast("string")).alias("doc_id"), "doc_pos", name.alias("document_name"), "page_ord", (F.col("page_ord") + 1).alias("page_number"), (F.when(text == "", NO_TEXT).otherwise(text) if collapse else text).alias("text"))


def accepted_files(files: DataFrame) -> DataFrame:
    """Of files (name, size, place, ...) those that may be read: PDF by name, at most MAX_FILE_BYTES, of each name the one with the least place."""
    fine = files.filter(F.lower("name").endswith(".pdf") & (F.col("size") <= MAX_FILE_BYTES))
    return fine.groupBy("name").agg(F.min_by(F.struct(*files.columns), "place").alias("f")).select("f.*")


def check_files(files: DataFrame) -> None:
    """Raise ValueError for more than MAX_FILES files, one beyond MAX_FILE_BYTES, or MAX_TOTAL_BYTES in all: limits of one interactive request."""
    n, most, total = files.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > MAX_FILES or most > MAX_FILE_BYTES or total > MAX_TOTAL_BYTES:
        raise ValueError(f"{n} files, the largest of {most} bytes, {total} bytes in all: more than may be read at once")


def check_pages(pages: DataFrame) -> None:
    """Raise ValueError for fewer than two documents, or one whose every page is blank."""
    docs = pages.groupBy("doc_id").agg(F.every(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    n, blank = docs.agg(F.count("*"), F.coalesce(F.count_if("blank"), F.lit(0))).first()
    if n < 2:
        raise ValueError("at least two documents are needed")
    if blank:
        raise ValueError(f"{blank} documents have no text")
