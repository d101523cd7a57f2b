"""Aligned array exports: five tables of one frame each, committed together or not at all.

A row of the exported DataFrame is a frame with all its arrays. Each task writes a file for each of the five outputs, with its rows in
the same order, to a staging folder. When all tasks are done the driver moves the files of the attempts that count and
writes the manifest; a folder without manifest is no export. If any task fails, staging goes and nothing is left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sonoloom.sources.headers import file_system

#: The outputs and the column of each; the keys of a frame go with all.
OUTPUTS = {"frames": "pixels", "transforms": "m", "secondary": "slice", "segmentations": "labelmap", "captured": "captured"}
KEYS, MANIFEST, STAGING = ("clip_id", "frame_no"), "_export.json", "_staging-"


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.compression = options.get("compression", "zstd")
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def _at(self, *names: str) -> tuple[fs.FileSystem, str]:
        system, root = file_system(self.path)
        return system, "/".join((root, *names))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, rows, writers = f"part-{uuid.uuid4().hex}.parquet", 0, {}
        try:
            for batch in iterator:
                rows += batch.num_rows
                for name, column in OUTPUTS.items():
                    own = batch.select([*KEYS, column])
                    if name not in writers:
                        system, folder = self._at(self.staging, name)
                        system.create_dir(folder)
                        writers[name] = pq.ParquetWriter(f"{folder}/{part}", own.schema, filesystem=system, compression=self.compression)
                    writers[name].write_batch(own)
        finally:
            for w in writers.values():
                w.close()
        return Written(part if writers else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None and m.part]
        system, root = self._at()
        if system.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(f"{self.path} holds an export")
            system.delete_file(f"{root}/{MANIFEST}")
        for name in OUTPUTS:
            if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                system.delete_dir(f"{root}/{name}")
            system.create_dir(f"{root}/{name}")
            for m in done:
                system.move(f"{root}/{self.staging}/{name}/{m.part}", f"{root}/{name}/{m.part}")
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"outputs": OUTPUTS, "rows": sum(m.rows for m in done), "parts": sorted(m.part for m in done)}).encode())
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, staged = self._at(self.staging)
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "aligned_arrays"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        missing = {*KEYS, *OUTPUTS.values()} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return ArrayWriter(self.options, overwrite)


def export_arrays(whole: DataFrame, path: str, compression: str = "zstd", overwrite: bool = False) -> None:
    """Write the five outputs of ``whole``: the keys of a frame and pixels, m, slice, labelmap, captured."""
    whole.sparkSession.dataSource.register(ArraySource)
    whole.write.format("aligned_arrays").option("compression", compression).mode("overwrite" if overwrite else "append").save(path)


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The outputs of a committed export; a folder without manifest is an error."""
    system, root = file_system(path)
    with system.open_input_stream(f"{root}/{MANIFEST}") as held:
        named = json.loads(held.read())["outputs"]
    return {name: spark.read.parquet(f"{path}/{name}") for name in named}
