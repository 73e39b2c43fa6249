"""Calls as a data source: the files of a folder, of which a query opens only those that it names.

``spark.read.format("calls").load(folder)`` gives ``company, quarter, year,
source_file, path, n_bytes, text``.  The options ``company``, ``quarter`` and
``year`` (one value, or several with commas between) are answered by file names,
before a file is opened; tasks are packed by bytes.  They are options, not
filters that Spark hands down: Spark 4.1 keeps the filters handed to a Python
source with the loaded table, so two different filters on one DataFrame read the
same files, and a union of the two is wrong.  With the option ``rejects`` the
source gives ``path, reason`` of the files whose name has another form.
``extractor`` names a function (``module:function``) from a file's bytes to page texts.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.session import ship
from corvane.sources.files import NAME_FORM, plain_pages
from corvane.sources.schemas import FILENAME, PAGE_BREAK

#: Bytes of files that a task reads, about; a larger file is a task of its own.
PACK_BYTES = 64 << 20
_KEYS = ("company", "quarter", "year")


@dataclass(frozen=True)
class File:
    company: str
    quarter: str
    year: int
    source_file: str
    path: str
    n_bytes: int


@dataclass
class Pack(InputPartition):
    files: list[File]


def listed(folder: str) -> tuple[list[File], list[str]]:
    """The folder's PDF files, in order: those with metadata in their names, and the paths of the others."""
    files, place = pafs.FileSystem.from_uri(folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") else folder)
    good, other = [], []
    for info in files.get_file_info(pafs.FileSelector(place)):
        if info.type != pafs.FileType.File or not info.base_name.lower().endswith(".pdf"):
            continue
        named = re.match(FILENAME, info.base_name[:-4])
        if named:
            good.append(File(named[1].upper(), named[2], int(named[3]), info.base_name, info.path, info.size or 0))
        else:
            other.append(info.path)
    return sorted(good, key=lambda f: f.path), sorted(other)


def packed(files: Iterable[File], size: int) -> list[Pack]:
    packs, held = [], 0
    for f in files:
        if not packs or held + f.n_bytes > size:
            packs.append(Pack([]))
            held = 0
        packs[-1].files.append(f)
        held += f.n_bytes
    return packs


class CallsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.extractor = options["path"], options.get("extractor")
        self.rejects, self.size = options.get("rejects", "false") == "true", int(options.get("packbytes", PACK_BYTES))
        self.wanted = {k: {v.strip().upper() for v in options[k].split(",")} for k in _KEYS if options.get(k)}

    def partitions(self) -> list[Pack]:
        good, other = listed(self.folder)
        if self.rejects:
            return [Pack([File("", "", 0, "", path, 0) for path in other[k : k + 10_000]]) for k in range(0, len(other), 10_000)] or [Pack([])]
        kept = [f for f in good if all(str(getattr(f, name)) in values for name, values in self.wanted.items())]
        return packed(kept, self.size) or [Pack([])]

    def read(self, partition: Pack) -> Iterator[tuple]:
        if self.rejects:
            yield from ((f.path, NAME_FORM) for f in partition.files)
            return
        module, _, name = (self.extractor or "").partition(":")
        extract = getattr(importlib.import_module(module), name) if module else plain_pages
        files, _ = pafs.FileSystem.from_uri(self.folder.removeprefix("file://").removeprefix("file:") if self.folder.startswith("file:") else self.folder)
        for f in partition.files:
            with files.open_input_stream(f.path) as stream:
                pages = extract(stream.read())
            yield f.company, f.quarter, f.year, f.source_file, f.path, f.n_bytes, f"\n{PAGE_BREAK}\n".join(pages)


class Calls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "calls"

    def schema(self) -> str:
        if self.options.get("rejects", "false") == "true":
            return "path string, reason string"
        return "company string, quarter string, year int, source_file string, path string, n_bytes long, text string"

    def reader(self, schema) -> CallsReader:
        return CallsReader({k.lower(): v for k, v in self.options.items()})


def calls(spark: SparkSession, folder: str, *, company: str | Iterable[str] = (), quarter: str | Iterable[str] = (), year: int | Iterable[int] = (), **options: str) -> DataFrame:
    """The source, registered; of each key the given values only, or all."""
    ship(spark)
    spark.dataSource.register(Calls)
    for name, values in zip(_KEYS, (company, quarter, year), strict=True):
        listed_ = [values] if isinstance(values, (str, int)) else values
        options[name] = ",".join(map(str, listed_))
    return spark.read.format("calls").options(**options).load(folder)
