"""Sinks: entity rows as Parquet by list, as list documents, the index, and the bundle. All are seen whole or not at all.

What is written goes to a folder beside its place first. When every task is done, and the rows are as they must be, it is moved there; if anything
fails before, the old files stay. The counts that decide are observed in the job that writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from rosterlake.operators.checks import SourceError
from rosterlake.schema import FIELDS
from rosterlake.session import ship


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if path.startswith(("/", "file:")) else path)


def replace_folder(path: str, write: Callable[[str], None], check: Callable[[], None] = lambda: None) -> None:
    """Lets `write` fill a folder, then `check` raise if it must not be seen, and puts it in the place of `path`."""
    new, old = f"{path}-{uuid.uuid4().hex}.new", f"{path}-{uuid.uuid4().hex}.old"
    store, at = store_of(path)
    try:
        write(new)
        check()
    except BaseException:
        if store.get_file_info(store_of(new)[1]).type != fs.FileType.NotFound:
            store.delete_dir(store_of(new)[1])
        raise
    there = store.get_file_info(at).type != fs.FileType.NotFound
    if there:
        store.move(at, store_of(old)[1])
    store.move(store_of(new)[1], at)
    if there:
        store.delete_dir(store_of(old)[1])


def watched(entities: DataFrame, what: str) -> tuple[DataFrame, Callable[[], None]]:
    """The rows, counted as they pass, and a check for when they have: SourceError if there were none, or one without a name."""
    seen = Observation()

    def check() -> None:
        n, unnamed = seen.get["n"], seen.get["unnamed"]
        if not n:
            raise SourceError(f"nothing was extracted from {what}")
        if unnamed:
            raise SourceError(f"{unnamed} of {n} rows from {what} have no name")

    return entities.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("name", F.lit("")) == "").alias("unnamed")), check


def write_entities(entities: DataFrame, path: str, *, what: str = "the sources") -> None:
    """Parquet, a folder for each list, so that a filter on the list prunes; checked in the same job."""
    rows, check = watched(entities, what)
    replace_folder(path, lambda p: rows.write.partitionBy("list_id").parquet(p), check)


def write_index(index: DataFrame, path: str) -> None:
    replace_folder(path, lambda p: index.write.partitionBy("l").parquet(p))


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class ListDocuments(DataSource):
    """Format "list_documents": rows (list_id, source_file, extracted, count, the eight fields), those of a list together and in order, become its
    document, named by the list. A task writes its documents row by row beside their place; all are moved there when every task is done."""

    @classmethod
    def name(cls) -> str:
        return "list_documents"

    def schema(self) -> str:
        from rosterlake.schema import ENTITY

        return f"list_id string, source_file string, extracted string, count long, {ENTITY}"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options["path"].rstrip("/"), self.options.get("newline", "true") == "true")


class _DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, newline: bool):
        self.path, self.newline = path, newline
        self.beside = f"{path}/_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        """Documents end where the next list begins; a try of a task has files of its own."""
        store, base = store_of(self.beside)
        store.create_dir(base, recursive=True)
        at = uuid.uuid4().hex
        files, out, current, n = [], None, None, 0

        def close() -> None:
            out.write((("\n ]" if n else "]") + "\n}" + "\n" * self.newline).encode())
            out.close()

        for row in iterator:
            if out is None or row["list_id"] != current:
                if out is not None:
                    close()
                current, n = row["list_id"], 0
                files.append(f"{at}-{current.replace('-', '_')}.json")
                out = store.open_output_stream(f"{base}/{files[-1]}")
                head = {k: row[k] for k in ("list_id", "source_file", "extracted", "count")}
                out.write((json.dumps(head, ensure_ascii=False, indent=1)[:-2] + ',\n "entities": [').encode())
            if row["name"] is not None:
                one = {f: row[f] for f in FIELDS}
                out.write(((",\n  " if n else "\n  ") + json.dumps(one, ensure_ascii=False, indent=1).replace("\n", "\n  ")).encode())
                n += 1
        if out is not None:
            close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = store_of(self.beside)
        final = store_of(self.path)[1]
        for f in [f for m in messages if m for f in m.files]:
            store.move(f"{base}/{f}", f"{final}/{f.split('-', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, base = store_of(self.beside)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


def write_documents(entities: DataFrame, path: str, *, extracted: str, newline: bool = True) -> None:
    """The document of each list as the site ships it, `path`/its_id.json: fields in order, indented, non-ASCII as it is.

    entities: rows with list_id, source_file and ord. A list's rows are sorted where they are written; none passes through the driver.
    """
    spark = entities.sparkSession
    ship(spark)
    spark.dataSource.register(ListDocuments)
    counts = entities.groupBy("list_id").agg(F.count(F.lit(1)).alias("count"))
    rows = entities.join(counts, "list_id").repartition("list_id").sortWithinPartitions("list_id", "ord")
    rows.select("list_id", "source_file", F.lit(extracted).alias("extracted"), "count", *FIELDS).write.format("list_documents").mode("append").option("path", path).option("newline", str(newline).lower()).save()


def write_bundle(idx: DataFrame, meta: DataFrame, path: str, variable: str = "window.DATA") -> None:
    """The whole index as one minified assignment, empty fields left out, records in list and file order.

    Records are text rows, range-sorted by ord; part files in the order of their names are the bundle. Only the head, a row
    for each list, is gathered.
    """
    counts = idx.groupBy("l").agg(F.count(F.lit(1)).alias("n")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l", "n"))))).alias("c")).scalar()
    lists = F.map_from_entries(F.transform("lists", lambda x: F.struct(x["id"].alias("k"), x.alias("v"))))
    head = F.concat(F.lit(f"{variable}="), F.regexp_replace(F.to_json(F.struct("generated", "dcl_url", lists.alias("lists"))), r"\}$", ""), F.lit(',"counts":'), counts, F.lit(',"entities":['))
    first = idx.agg(F.min("ord").alias("ord")).scalar()
    record = F.concat(F.when(F.col("ord") == first, "").otherwise(","), F.to_json(F.struct("n", "l", "a", "c", "ad", "s", "d", "fr", "no", "k")))
    rows = meta.select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("ord"), head.alias("value"))
    rows = rows.unionByName(idx.select(F.lit(1).alias("part"), F.col("ord").cast("long"), record.alias("value"))).unionByName(meta.select(F.lit(2).alias("part"), F.lit(None).cast("long").alias("ord"), F.lit("]};").alias("value")))
    sorted_ = rows.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("value")
    replace_folder(path, lambda p: sorted_.write.option("lineSep", "\n").text(p))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index that write_index wrote; a filter on l reads its list's folder only."""
    return spark.read.parquet(path).withColumn("l", F.col("l").cast("string"))
