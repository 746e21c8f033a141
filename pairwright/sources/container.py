"""A tensor container as a Spark data source: reading takes headers only, writing puts rows into files.

A file begins with a magic word, a version and two counts; key-value pairs and descriptions of tensors follow, every text and array behind
its length; the tensors' data comes after. A header is read in blocks until its end, so its cost doesn't depend on
the tensors. One task reads one file at a time; files are reached through Arrow's file systems (local, HDFS, S3, GCS).

Layout (all little-endian): ``GGUF``, u32 version 3, u64 tensors, u64 pairs; a pair is name, u32 type, value; an array value is
u32 type, u64 length, values; a tensor is name, u32 number of dimensions, u64 each, u32 type, u64 offset
from the aligned end of the header; a text is u64 length and UTF-8 bytes.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "tensor_container"
HEADER = "file string, kind string, name string, type string, value string, dims array<bigint>, at bigint, bytes bigint"
# Fixed values of the format: scalar types by number (name, struct code), then text and array; tensor types (name, bytes of a block, values in it).
SCALARS = {0: ("u8", "B"), 1: ("i8", "b"), 2: ("u16", "H"), 3: ("i16", "h"), 4: ("u32", "I"), 5: ("i32", "i"), 6: ("f32", "f"), 7: ("bool", "?"), 10: ("u64", "Q"), 11: ("i64", "q"), 12: ("f64", "d")}
TEXT, ARRAY, ALIGN = 8, 9, 32
TENSORS = {0: ("f32", 4, 1), 1: ("f16", 2, 1), 2: ("q4_0", 18, 32), 8: ("q8_0", 34, 32), 24: ("i8", 1, 1), 26: ("i32", 4, 1), 28: ("f64", 8, 1), 30: ("bf16", 2, 1)}
BLOCK = 1 << 16
#: What no sound header exceeds: bytes of a text, values of an array, pairs or tensors, dimensions.
MOST_TEXT, MOST_ITEMS, MOST_DIMS = 1 << 24, 1 << 24, 8


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Header:
    """Parses a header from a stream, block by block."""

    def __init__(self, stream, name: str) -> None:
        self.stream, self.name, self.held, self.at, self.read = stream, name, b"", 0, 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = self.stream.read(max(BLOCK, n - (len(self.held) - self.at)))
            if not more:
                raise ValueError(f"{self.name}: the header ends early")
            self.read += len(more)
            self.held, self.at = self.held[self.at :] + more, 0
        self.at += n
        return self.held[self.at - n : self.at]

    def number(self, code: str):
        return struct.unpack(f"<{code}", self.take(struct.calcsize(code)))[0]

    def count(self, most: int) -> int:
        n = self.number("Q")
        if n > most:
            raise ValueError(f"{self.name}: a count of {n}")
        return n

    def text(self) -> str:
        return self.take(self.count(MOST_TEXT)).decode()

    def value(self, kind: int):
        if kind == TEXT:
            return self.text()
        if kind in SCALARS:
            return self.number(SCALARS[kind][1])
        if kind != ARRAY:
            raise ValueError(f"{self.name}: unknown type {kind}")
        inner, n = self.number("I"), self.count(MOST_ITEMS)
        if inner == ARRAY:
            raise ValueError(f"{self.name}: an array of arrays")
        return [self.value(inner) for _ in range(n)]

    def rows(self) -> Iterator[tuple]:
        """Rows of ``HEADER``: pairs first, then tensors."""
        if self.take(4) != b"GGUF" or self.number("I") != 3:
            raise ValueError(f"{self.name}: not a container of version 3")
        tensors, pairs = self.count(MOST_ITEMS), self.count(MOST_ITEMS)
        seen = set()
        for _ in range(pairs):
            name, kind = self.text(), self.number("I")
            if name in seen:
                raise ValueError(f"{self.name}: {name} occurs twice")
            seen.add(name)
            shown = {TEXT: "text", ARRAY: "array"}.get(kind) or SCALARS.get(kind, ("?",))[0]
            value = self.value(kind)
            yield self.name, "pair", name, shown, value if kind == TEXT else json.dumps(value), None, None, None
        seen = set()
        for _ in range(tensors):
            name, n = self.text(), self.number("I")
            if n > MOST_DIMS or name in seen:
                raise ValueError(f"{self.name}: tensor {name} has {n} dimensions or occurs twice")
            seen.add(name)
            dims = [self.number("Q") for _ in range(n)]
            kind, at = self.number("I"), self.number("Q")
            shown, size, block = TENSORS.get(kind, (str(kind), None, 1))
            total = 1
            for d in dims:
                total *= d
            yield self.name, "tensor", name, shown, None, dims, at, None if size is None else total // block * size


@dataclass
class FilePart(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[FilePart]:
        system, place = file_system(self.path)
        found = system.get_file_info(pafs.FileSelector(place, recursive=True)) if system.get_file_info(place).type == pafs.FileType.Directory else [system.get_file_info(place)]
        return [FilePart(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        with system.open_input_stream(partition.path, compression=None, buffer_size=0) as stream:
            yield from Header(stream, partition.path).rows()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def packed(tensors: list[tuple[str, list[int], bytes]], pairs: dict[str, object]) -> bytes:
    """A file's bytes: texts and whole numbers as pairs, tensors of 32-bit floats."""

    def text(value: str) -> bytes:
        data = value.encode()
        return struct.pack("<Q", len(data)) + data

    out = [b"GGUF", struct.pack("<IQQ", 3, len(tensors), len(pairs))]
    for name, value in pairs.items():
        out.append(text(name) + (struct.pack("<I", TEXT) + text(value) if isinstance(value, str) else struct.pack("<Iq", 11, value)))
    at, data = 0, []
    for name, dims, raw in tensors:
        out.append(text(name) + struct.pack(f"<I{len(dims)}QIQ", len(dims), *dims, 0, at))
        data.append(raw + b"\0" * (-len(raw) % ALIGN))
        at += len(data[-1])
    head = b"".join(out)
    return head + b"\0" * (-len(head) % ALIGN) + b"".join(data)


class Writer(DataSourceWriter):
    """Rows (name, values) into files of at most ``rows`` tensors; a file appears whole, by a rename."""

    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def write(self, iterator: Iterator) -> Written:
        system, place = file_system(self.path)
        system.create_dir(place, recursive=True)
        files, held = [], []

        def put() -> None:
            name = f"{uuid.uuid4().hex}.gguf"
            pairs = {"general.architecture": "table", "general.alignment": ALIGN, "table.rows": len(held)}
            with system.open_output_stream(f"{place}/_{name}", compression=None) as stream:
                stream.write(packed(held, pairs))
            system.move(f"{place}/_{name}", f"{place}/{name}")
            files.append(f"{place}/{name}")
            held.clear()

        for row in iterator:
            values = np.asarray(row["values"] or [], dtype="<f4")
            held.append((row["name"], [len(values)], values.tobytes()))
            if len(held) >= self.rows:
                put()
        if held:
            put()
        return Written(files)

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for file in (f for m in messages if m is not None for f in m.files):
            system.delete_file(file)


class TensorContainer(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("rows", "4096")))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Pairs and tensor descriptions of a file, or of all files of a folder."""
    spark.dataSource.register(TensorContainer)
    return spark.read.format(NAME).load(path)


def write_tensors(rows: DataFrame, path: str, per_file: int = 4096) -> None:
    """Rows (name, values: array of float) as containers of at most ``per_file`` tensors."""
    rows.sparkSession.dataSource.register(TensorContainer)
    rows.select("name", "values").write.format(NAME).option("rows", per_file).mode("append").save(path)
