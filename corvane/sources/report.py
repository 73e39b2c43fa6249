"""One JSON file of several record lists, written by Spark: a data source whose parts are joined when all are there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corvane.session import ship

_COPY_BYTES = 1 << 20


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path)


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: for each list a file of records."""

    number: int
    files: dict[str, str]


class ReportWriter(DataSourceArrowWriter):
    """Rows are ``list, record``; a task writes its records beside the report, the commit joins them in the order of tasks."""

    def __init__(self, path: str, lists: list[str]) -> None:
        self.path, self.lists, self.parts = path, lists, f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, folder = _files(self.parts)
        files.create_dir(folder, recursive=True)
        task, open_ = TaskContext.get(), {}
        stem = f"{task.partitionId()}-{task.taskAttemptId()}"
        try:
            for batch in iterator:
                for name, record in zip(batch.column("list").to_pylist(), batch.column("record").to_pylist(), strict=True):
                    if name not in open_:
                        place = f"{folder}/{stem}-{self.lists.index(name)}"
                        open_[name] = place, files.open_output_stream(place)
                        open_[name][1].write(record.encode())
                    else:
                        open_[name][1].write(b",\n" + record.encode())
        finally:
            for _, stream in open_.values():
                stream.close()
        return Part(task.partitionId(), {name: place for name, (place, _) in open_.items()})

    def commit(self, messages: list[Part | None]) -> None:
        """Copy the parts, a megabyte at a time, into a file that then takes the report's name."""
        files, path = _files(self.path)
        whole = f"{path}.{uuid.uuid4().hex}"
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        with files.open_output_stream(whole) as out:
            out.write(b"{")
            for k, name in enumerate(self.lists):
                out.write((",\n" if k else "\n").encode() + json.dumps(name).encode() + b": [")
                for j, place in enumerate(m.files[name] for m in parts if name in m.files):
                    out.write(b",\n" if j else b"\n")
                    with files.open_input_stream(place) as part:
                        while data := part.read(_COPY_BYTES):
                            out.write(data)
                out.write(b"]")
            out.write(b"\n}\n")
        files.move(whole, path)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = _files(self.parts)
        if files.get_file_info(folder).type != pafs.FileType.NotFound:
            files.delete_dir(folder)


class Report(DataSource):
    """``df.write.format("json_report").option("path", ...).option("lists", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "json_report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], json.loads(self.options["lists"]))


def write_report(frames: Mapping[str, DataFrame], path: str) -> None:
    """A JSON object with a list of records for each frame, in the frame's order, nulls kept; a failed write leaves no file and no parts."""
    spark = next(iter(frames.values())).sparkSession
    rows = None
    for name, frame in frames.items():
        own = frame.select(F.lit(name).alias("list"), F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("record"))
        rows = own if rows is None else rows.unionByName(own)
    ship(spark)
    spark.dataSource.register(Report)
    rows.write.format("json_report").option("path", path).option("lists", json.dumps(list(frames))).mode("append").save()
