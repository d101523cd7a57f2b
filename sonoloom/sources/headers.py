"""Header files as a Spark data source: a tree of header dumps to one row per instance, faults included.

A file holds one header as a JSON object, or with the option ``lines`` one on each line, read as a stream. Elements are named by keyword
(``PatientID``) or by name (``Patient's Birth Date``), values are scalars, lists, or lists of objects (sequences).
The listing is split into partitions of bounded bytes and files on the driver; headers are read and parsed in the tasks.

A row has ``InputPath`` (the instance's file, not the dump's), the elements that the operators take, typed, ``json`` (the whole
header by keyword, pixel data left out) and ``error``. A header that cannot be read, or whose element is not of its type, has an error and
no elements; nothing is dropped in silence.
"""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Elements by type, the sequence that holds the spacing, and endings of instance files and of dumps.
TEXTS = (
    "PatientID PatientName PatientBirthDate PatientAge PatientSex StudyInstanceUID SeriesInstanceUID SOPInstanceUID SOPClassUID Modality ContentDate ContentTime StudyDate StudyTime SeriesDate StudyDescription SeriesNumber InstanceNumber "
    "StationName TransducerData TransducerType Manufacturer ManufacturerModelName Laterality PatientOrientation ImageType FrameIncrementPointer ReferringPhysicianName AccessionNumber"
).split()
COUNTS = "NumberOfFrames SamplesPerPixel PlanarConfiguration BitsAllocated BitsStored HighBit PixelRepresentation Rows Columns".split()
NUMBERS = "FrameTime PhysicalDeltaX PhysicalDeltaY".split()
REGIONS, PIXELS, SPACING = "SequenceOfUltrasoundRegions", "PixelData", ("PhysicalDeltaX", "PhysicalDeltaY")
INSTANCE, DUMP = re.compile(r"\.(dcm|dicom)$", re.I), re.compile(r"(_DICOMHeader)?\.json$", re.I)
SCHEMA = pa.schema([("InputPath", pa.string()), *((c, pa.string()) for c in TEXTS), *((c, pa.int32()) for c in COUNTS), *((c, pa.float64()) for c in NUMBERS), ("json", pa.string()), ("error", pa.string())])
DDL = ", ".join(f"{f.name} {({pa.string(): 'string', pa.int32(): 'int', pa.float64(): 'double'})[f.type]}" for f in SCHEMA)
#: Most bytes and files of a partition, and rows of a batch.
PARTITION_BYTES, PARTITION_FILES, BATCH_ROWS = 1 << 25, 2000, 1000


@lru_cache(4096)
def keyword(name: str) -> str:
    """Keyword of an element's name: no possessive, words joined, each with a capital."""
    return "".join(w[:1].upper() + w[1:] for w in re.findall(r"[A-Za-z0-9]+", name.replace("'s", "")))


def by_keyword(value: Any) -> Any:
    """A header with its elements, and those of its sequences, by keyword; pixel data left out."""
    if isinstance(value, dict):
        return {k: by_keyword(v) for name, v in value.items() if (k := keyword(name)) != PIXELS}
    return [by_keyword(v) for v in value] if isinstance(value, list) else value


def instance_path(dump: str) -> str:
    """The instance that a dump belongs to: its name without the dump's ending, and with an instance's."""
    path = DUMP.sub("", dump)
    return path if INSTANCE.search(path) else f"{path}.dcm"


def parsed(text: str | bytes, path: str) -> dict[str, Any]:
    """The row of one header; ``path`` is the instance's unless the header has an ``InputPath`` of its own."""
    try:
        given = json.loads(text)
        if not isinstance(given, dict):
            raise ValueError("not a JSON object")
        head = by_keyword(given)
        row: dict[str, Any] = {"InputPath": head.pop("InputPath", None) or path, "json": json.dumps(head, ensure_ascii=False)}
        regions = head.get(REGIONS)
        first = regions[0] if isinstance(regions, list) and regions and isinstance(regions[0], dict) else {}
        for c in TEXTS:
            v = head.get(c)
            row[c] = v if v is None or isinstance(v, str) else "\\".join(map(str, v)) if isinstance(v, list) else str(v)
        for c in COUNTS:
            row[c] = None if head.get(c) in (None, "") else int(head[c])
        for c in NUMBERS:
            v = first.get(c, head.get(c)) if c in SPACING else head.get(c)
            row[c] = None if v in (None, "") else float(v)
        return row
    except (ValueError, TypeError, UnicodeDecodeError) as fault:
        return {"InputPath": path, "error": str(fault)}


@dataclass
class Files(InputPartition):
    paths: list[str]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.lines = options.get("lines", "false").lower() == "true"
        self.most_bytes, self.most_files = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("partitionfiles", PARTITION_FILES))

    def partitions(self) -> list[Files]:
        """Neighbouring files, packed up to the bounds; hidden ones and resource forks are left out."""
        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        ending = "" if self.lines else ".json"
        out: list[Files] = []
        size = self.most_bytes
        for info in sorted((i for i in found if i.type == fs.FileType.File and i.base_name.lower().endswith(ending) and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            if not out or size + info.size > self.most_bytes or len(out[-1].paths) >= self.most_files:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(info.path)
            size += info.size
        return out or [Files([])]

    def _rows(self, paths: list[str]) -> Iterator[dict[str, Any]]:
        system, _ = file_system(self.path)
        for path in paths:
            try:
                with system.open_input_stream(path) as stream:  # compressed files are told by their ending
                    for piece in io.BufferedReader(stream, 1 << 20) if self.lines else [stream.read()]:
                        for text in piece.splitlines() if self.lines else [piece]:
                            yield parsed(text, instance_path(path))
            except OSError as fault:
                yield {"InputPath": instance_path(path), "error": str(fault)}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        for row in self._rows(partition.paths):
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "header_files"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def read_headers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Header records of a tree of dumps; see the module for their columns."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("header_files").option("lines", str(lines).lower()).load(path)


def header_errors(headers: DataFrame) -> DataFrame:
    return headers.where(F.col("error").isNotNull()).select("InputPath", "error")
