"""Data sources for folders of labels and for documents too large for a row.

Registered with :func:`register`, they are read like any format::

    spark.read.format("label_lines").option("path", "/labels").load()
    spark.read.format("json_elements").option("path", "/coco").option("parts", "images,annotations").load()

The schema is fixed, so nothing is opened before the job runs. A partition is a slice of the folder's
files, cut by their bytes; it is read as a stream of Arrow batches. ``json_elements`` walks through a
document in blocks and gives one row per element of the arrays named by ``parts``, so what a task holds is
a block and one element, however long the document is. One document stays with one task. Files are
opened through Arrow's file systems: local and mounted folders, and the addresses Arrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLICE_BYTES = 64 << 20
SLICE_FILES = 2_000
_ROWS = 10_000
_BLOCK = 4 << 20
#: A string, closed or cut by the end of the block, or a mark.
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*("?)|[{}\[\],:]', re.DOTALL)


class Slice(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class FolderReader(DataSourceReader):
    """Slices the files of ``path`` (a file or a folder, searched deeply) that end in ``suffix``."""

    suffix = ""

    def __init__(self, schema, options):
        self.schema = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in schema.fields])
        if "path" not in options:
            raise ValueError("option path is missing")
        self.path, self.suffix = options["path"], options.get("suffix", self.suffix)
        self.most_bytes, self.most_files = int(options.get("sliceBytes", SLICE_BYTES)), int(options.get("sliceFiles", SLICE_FILES))

    def _files(self):
        found, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        about = found.get_file_info(path)
        if about.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        inside = [about] if about.is_file else found.get_file_info(pafs.FileSelector(path, recursive=True))
        return found, sorted((i.path, i.size or 0) for i in inside if i.is_file and i.path.endswith(self.suffix))

    def partitions(self) -> list[InputPartition]:
        slices, held = [[]], 0
        for path, size in self._files()[1]:
            if slices[-1] and (held + size > self.most_bytes or len(slices[-1]) >= self.most_files):
                slices.append([])
                held = 0
            slices[-1].append(path)
            held += size
        return [Slice(files) for files in slices]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        found = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        rows: list[tuple] = []
        for path in partition.files:
            with found.open_input_stream(path) as stream:
                for row in self.rows(path, stream):
                    rows.append(row)
                    if len(rows) >= _ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)

    def rows(self, path: str, stream) -> Iterator[tuple]:
        raise NotImplementedError


class LabelReader(FolderReader):
    suffix = ".txt"

    def rows(self, path, stream):
        text = stream.read().decode("utf-8", "replace").strip()
        for i, line in enumerate(re.split(r"\r?\n", text) if text else []):
            yield path, i + 1, line


class LabelLines(DataSource):
    """``path, line_no, line`` of label files; numbering starts at the first line that isn't blank."""

    @classmethod
    def name(cls):
        return "label_lines"

    def schema(self):
        return "path string, line_no int, line string"

    def reader(self, schema):
        return LabelReader(schema, self.options)


def walk(stream, parts: set[str], block: int = _BLOCK) -> Iterator[tuple[str, int, bytes]]:
    """``part, pos, element`` of the arrays at the dotted paths ``parts`` ('' is the document itself) of a JSON stream.

    Tokens are matched block by block; a token cut by the end of a block waits for the next.
    """
    path: list[str | None] = []  # the key under which each open container lies
    kinds: list[bytes] = []
    key: str | None = None
    text: bytes | None = None  # the last string, perhaps a key
    array: int | None = None  # depth of the array being told
    start = done = pos = 0
    buffer, ended = b"", False

    def name() -> str:
        return ".".join(k for k in path if k is not None)

    while True:
        end = done
        for m in _TOKEN.finditer(buffer, done):
            token = m.group()
            if token[:1] == b'"':
                if not m.group(1):
                    end = m.start()
                    break
                text, end = token, m.end()
                continue
            end = m.end()
            if token == b":":
                if kinds and kinds[-1] == b"{" and text is not None:
                    key = text[1:-1].decode("utf-8", "replace")
            elif token in b"{[":
                kinds.append(token)
                path.append(key)
                key = None
                if array is None and token == b"[" and name() in parts and all(k == b"{" for k in kinds[:-1]):
                    array, start, pos = len(kinds), end, 0
            else:
                if array == len(kinds) and token in b",]":
                    element = buffer[start:m.start()].strip()
                    if element:
                        yield name(), pos, element
                        pos += 1
                    start = end
                if token in b"}]":
                    if not kinds:
                        return
                    if array == len(kinds):
                        array = None
                    kinds.pop()
                    path.pop()
                key = None
            text = None
        if ended:
            return
        # Keep what an open element or a cut string still needs.
        keep = min(start, end) if array is not None else end
        more = stream.read(block)
        ended = not more
        buffer = buffer[keep:] + more
        done, start = end - keep, start - keep


class ElementReader(FolderReader):
    suffix = ".json"

    def __init__(self, schema, options):
        super().__init__(schema, options)
        self.parts = {p.strip() for p in options.get("parts", "").split(",")}

    def rows(self, path, stream):
        for part, pos, element in walk(stream, self.parts):
            yield path, part, pos, element.decode("utf-8", "replace")


class JsonElements(DataSource):
    """``doc, part, pos, element``: elements of the arrays at ``parts`` (dotted paths, comma between) of JSON documents."""

    @classmethod
    def name(cls):
        return "json_elements"

    def schema(self):
        return "doc string, part string, pos bigint, element string"

    def reader(self, schema):
        return ElementReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    for source in (LabelLines, JsonElements):
        spark.dataSource.register(source)


def read_elements(spark: SparkSession, path: str, *parts: str) -> DataFrame:
    """``doc, part, pos, v``: elements of large documents as VARIANT, as :func:`documents.items` gives them for small ones."""
    register(spark)
    rows = spark.read.format("json_elements").option("path", path).option("parts", ",".join(parts)).load()
    return rows.select("doc", "part", "pos", F.try_parse_json("element").alias("v"))


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of a folder of label files."""
    register(spark)
    return spark.read.format("label_lines").option("path", path).load()
