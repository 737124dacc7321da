"""Pages as a data source of their own: spark.read.format("pages").load(folder) for JSON and PDF files.

Register it once: spark.dataSource.register(PageSource). The folder is listed once, files are dealt into partitions by
their sizes, and each task reads its files one after the other. A document's position is its file's number in the order
of paths, shifted, plus its place in the file: global and in order without a job that counts. `columns` names those that are read;
texts aren't put together where they are not among them. The file systems are those that Arrow knows; read_json() and
read_pdf() take any that Spark knows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .pages import _page_texts, _raw_text

TYPES = {"doc_id": "string", "doc_pos": "bigint", "document_name": "string", "page_ord": "int", "page_number": "int", "text": "string", "fileSize": "bigint"}
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
#: Documents that a file may hold, as a power of two.
FILE_SHIFT = 24
#: Bytes of files in a partition; a larger file is a partition.
PARTITION_BYTES = 128 << 20
#: Pages in a batch.
BATCH = 1024
_BLANKS = " \t\n\r\x0b\x0c\xa0﻿"


class Files(InputPartition):
    """Files that one task reads: (number, path, size)."""

    def __init__(self, files: list[tuple[int, str, int]]):
        self.files = files


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        self.size = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        one = system.get_file_info(root)
        found = [one] if one.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith((".json", ".pdf")))
        out: list[Files] = []
        left = 0
        for number, (path, size) in enumerate(files):
            if not out or size > left:
                out.append(Files([]))
                left = self.size
            out[-1].files.append((number, path, size))
            left -= size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        schema = pa.schema([(c, ARROW[TYPES[c]]) for c in self.columns])
        rows: list[dict] = []
        for number, path, size in partition.files:
            with system.open_input_stream(path) as stream:
                content = stream.read()
            for row in self._rows(number, path, content):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _rows(self, number: int, path: str, content: bytes) -> Iterator[dict]:
        digest = hashlib.blake2b(path.encode(), digest_size=8).hexdigest()
        if path.lower().endswith(".json"):
            documents = (json.loads(content) or {}).get("documents") or []
        else:
            documents = [{"filename": path.rsplit("/", 1)[-1], "fileSize": len(content), "pages": [{"text": t} for t in _page_texts(content) or [_raw_text(content)]]}]
        for i, document in enumerate(documents):
            for k, page in enumerate(document.get("pages") or []):
                own = {"doc_id": f"doc_{digest}_{i}", "doc_pos": (number << FILE_SHIFT) + i, "document_name": document.get("filename") or f"Document {i + 1}", "page_ord": k, "page_number": page.get("pageNumber") or k + 1, "fileSize": document.get("fileSize")}
                if "text" in self.columns:
                    own["text"] = (page.get("text") or "").strip(_BLANKS)
                yield {c: own[c] for c in self.columns}


class PageSource(DataSource):
    """Pages of JSON files {documents: [{filename, fileSize, pages: [{pageNumber, text}]}]} and of PDF files."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        wanted = self.options.get("columns", ",".join(TYPES)).replace(" ", "").split(",")
        unknown = [c for c in wanted if c not in TYPES]
        if unknown:
            raise ValueError(f"pages have no columns {unknown}; they have {list(TYPES)}")
        return ", ".join(f"{c} {TYPES[c]}" for c in wanted)

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options), schema)
