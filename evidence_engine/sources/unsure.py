"""A Spark data source for text files of unsure encoding: each file decoded strictly to its last byte, every row with its place.

``spark.dataSource.register(UnsureSource)`` and then ``spark.read.format("unsure")`` with ``path`` (a file or a folder;
comma-separated for several) and ``kind``: ``lines`` gives the text lines, ``csv`` the records of files with a header
as maps from column names. A file is a task and is streamed, once to settle its encoding and once to be read, so that
memory is bounded by a chunk and a record. ``line`` is where the row begins in its file, from 1.

Defined cases: the first encoding of the list that decodes all of a file holds for it, whatever other files have; a file
that none decodes fails with its name; a byte-order mark is no text; an empty file has no rows.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.contracts import ENCODINGS

CHUNK = 1 << 20
SCHEMA = {"lines": "file string, encoding string, line bigint, value string", "csv": "file string, encoding string, line bigint, record map<string,string>"}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class UnsureReader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.kind, self.paths = kind, [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        found = []
        for path in self.paths:
            system, at = _filesystem(path)
            info = system.get_file_info(at)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            scheme = path.split("://")[0] + "://" if "://" in path else ""
            inside = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
            found += [_File(scheme + f.path) for f in sorted(inside, key=lambda f: f.path)]
        return found

    def read(self, partition: _File) -> Iterator[tuple]:
        system, at = _filesystem(partition.path)
        encoding = encoding_of(lambda: system.open_input_stream(at), partition.path)
        with system.open_input_stream(at) as raw:
            text = io.TextIOWrapper(io.BufferedReader(_Raw(raw), CHUNK), encoding=encoding, errors="strict", newline="" if self.kind == "csv" else None)
            if self.kind == "lines":
                for i, line in enumerate(text, 1):
                    yield partition.path, encoding, i, line.rstrip("\n")
                return
            rows = csv.reader(text)
            header, begin = next(rows, None), rows.line_num + 1
            for row in rows:
                if row:
                    yield partition.path, encoding, begin, dict(zip(header, row))
                begin = rows.line_num + 1


class _Raw(io.RawIOBase):
    """A readable over a stream that only reads."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.stream.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def encoding_of(opened, path: str, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that decodes the whole stream strictly; ``opened`` opens it from its beginning."""
    for name in encodings:
        decoder = codecs.getincrementaldecoder(name)("strict")
        try:
            with opened() as raw:
                while part := raw.read(CHUNK):
                    decoder.decode(part)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            continue
        return name
    raise ValueError(f"none of {', '.join(encodings)} decodes {path}")


class UnsureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "unsure"

    def _kind(self) -> str:
        kind = self.options.get("kind", "lines")
        if kind not in SCHEMA:
            raise ValueError(f"kind is one of {', '.join(SCHEMA)}")
        return kind

    def schema(self) -> str:
        return SCHEMA[self._kind()]

    def reader(self, schema) -> UnsureReader:
        return UnsureReader(self.options, self._kind())


def read_unsure(spark: SparkSession, path: str, kind: str = "lines") -> DataFrame:
    spark.dataSource.register(UnsureSource)
    return spark.read.format("unsure").options(path=path, kind=kind).load()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): records with the file and line of each; errors (file, line, value) of lines that are no JSON object of the schema. Blank lines are neither."""
    lines = read_unsure(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, __malformed string", {"columnNameOfCorruptRecord": "__malformed", "mode": "PERMISSIVE"}))
    bad = F.col("r.__malformed").isNotNull()
    return parsed.where(~bad).select("file", "line", "r.*").drop("__malformed"), parsed.where(bad).select("file", "line", "value")
