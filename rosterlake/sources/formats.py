"""Published files as Spark formats, beside the readers of sources.files: `spark.read.format("list_table").load(folder)`.

A format lists its files when the scan is planned and deals them, by size, to partitions; filters on `path` are pushed to the listing, so files that
cannot match are not opened. A file that cannot be read is named in the error. register(spark) makes the formats known.

- list_lines: (path, ord, line), without byte-order mark and carriage returns, up to a line that begins with the option `until`;
- list_table: (path, row_ord, cells) of each page's first table;
- list_sections: (path, ord, section_ord, heading, item) of each page;
- list_records: (path, list_id, ord, the eight fields) of list documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from rosterlake.schema import ENTITY, FIELDS
from rosterlake.session import ship
from rosterlake.sources.files import Sections, Table
from rosterlake.sources.sinks import store_of

#: Bytes that a partition reads, and files at most.
PART_BYTES, PART_FILES = 32 << 20, 1000


def _lines(raw: bytes, options: dict) -> Iterator[tuple]:
    text, until = raw.decode("utf-8", "replace").removeprefix("﻿"), options.get("until")
    for i, line in enumerate(text.split("\n")):
        if until and line.startswith(until):
            return
        yield i, line.removesuffix("\r")


def _table(raw: bytes, options: dict) -> Iterator[tuple]:
    parser = Table()
    parser.feed(raw.decode("utf-8", "replace"))
    yield from ((i, [(t, s) for t, s in row]) for i, row in enumerate(r for r in parser.rows if r))


def _sections(raw: bytes, options: dict) -> Iterator[tuple]:
    parser = Sections()
    parser.feed(raw.decode("utf-8", "replace"))
    yield from ((i, *item) for i, item in enumerate(parser.items))


def _records(raw: bytes, options: dict) -> Iterator[tuple]:
    doc = json.loads(raw)
    for i, e in enumerate(doc["entities"]):
        yield doc["list_id"], i, *(e.get(f) for f in FIELDS)


class _Format(DataSource):
    columns: str
    parse: Callable[[bytes, dict], Iterator[tuple]]

    def schema(self) -> str:
        return f"path string, {self.columns}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], dict(self.options), type(self).parse)


class Lines(_Format):
    columns, parse = "ord int, line string", staticmethod(_lines)

    @classmethod
    def name(cls) -> str:
        return "list_lines"


class FirstTable(_Format):
    columns, parse = "row_ord int, cells array<struct<text:string,strongs:array<string>>>", staticmethod(_table)

    @classmethod
    def name(cls) -> str:
        return "list_table"


class SectionItems(_Format):
    columns, parse = "ord int, section_ord int, heading string, item string", staticmethod(_sections)

    @classmethod
    def name(cls) -> str:
        return "list_sections"


class Records(_Format):
    columns, parse = f"list_id string, ord int, {ENTITY}", staticmethod(_records)

    @classmethod
    def name(cls) -> str:
        return "list_records"


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict, parse: Callable):
        self.path, self.options, self.parse = path, options, parse
        self.keep: list[Callable[[str], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what is asked of `path`; gives back the rest."""
        for f in filters:
            if getattr(f, "attribute", None) != ("path",):
                yield f
            elif isinstance(f, EqualTo):
                self.keep.append(lambda p, v=f.value: p == v)
            elif isinstance(f, In):
                self.keep.append(lambda p, v=frozenset(f.value): p in v)
            elif isinstance(f, StringStartsWith):
                self.keep.append(lambda p, v=f.value: p.startswith(v))
            elif isinstance(f, StringEndsWith):
                self.keep.append(lambda p, v=f.value: p.endswith(v))
            elif isinstance(f, StringContains):
                self.keep.append(lambda p, v=f.value: v in p)
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        store, base = store_of(self.path)
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"missing: {self.path}")
        infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        visible = [f for f in infos if f.type == fs.FileType.File and not re.search(r"/[._][^/]*$", f.path)]
        return sorted((f.path, f.size) for f in visible if all(k(f.path) for k in self.keep))

    def partitions(self) -> list[_Files]:
        out, size = [], PART_BYTES
        for path, n in self.files():
            if size + n > PART_BYTES or len(out[-1].paths) >= PART_FILES:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        for path in partition.paths:
            try:
                raw = store.open_input_file(path).read()
                rows = list(self.parse(raw, self.options))
            except Exception as e:
                raise RuntimeError(f"cannot read {path}: {type(e).__name__}: {e}") from e
            for row in rows:
                yield path, *row


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, with their filters pushed."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in (Lines, FirstTable, SectionItems, Records):
        spark.dataSource.register(kind)
