"""Sources of list publications, each as a DataFrame that carries its rows' places in the file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.text import LINE_ENDS, strip_tags
from rosterlake.operators.checks import SourceError
from rosterlake.schema import DOCUMENT, META
from rosterlake.session import ship

#: Bytes 0x80 to 0x9f in windows-1252; those it leaves out have no entry. Fixed values.
_C1 = {
    "\x80": "€", "\x82": "‚", "\x83": "ƒ", "\x84": "„", "\x85": "…", "\x86": "†", "\x87": "‡", "\x88": "ˆ", "\x89": "‰", "\x8a": "Š", "\x8b": "‹", "\x8c": "Œ", "\x8e": "Ž", "\x91": "‘", "\x92": "’", "\x93": "“", "\x94": "”", "\x95": "•", "\x96": "–", "\x97": "—", "\x98": "˜", "\x99": "™", "\x9a": "š", "\x9b": "›", "\x9c": "œ", "\x9e": "ž", "\x9f": "Ÿ",
}
_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"
#: Characters of a frame that a task hands on.
FRAME = 1 << 22


def require_files(spark: SparkSession, *paths: str) -> None:
    """Raises SourceError for a missing or empty file; sizes come from Spark's listing, so any store will do."""
    for p in paths:
        try:
            sizes = [r["length"] for r in spark.read.format("binaryFile").load(p).select("length").collect()]
        except AnalysisException as e:
            raise SourceError(f"missing: {p}") from e
        if not sizes or not all(sizes):
            raise SourceError(f"missing or empty: {p}")


def _csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, escape='"', encoding=encoding, mode="PERMISSIVE").csv(path)


def _any(df: DataFrame, pattern: str) -> bool:
    return not df.filter(F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]), lambda x: x.rlike(pattern))).isEmpty()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings: UTF-8; windows-1252 where that fails; UTF-8 with marks where both do. Line ends inside fields vanish."""
    df = _csv(spark, path, "UTF-8")
    if _any(df, "�"):
        narrow = _csv(spark, path, "ISO-8859-1")
        if not _any(narrow, _UNDEFINED):
            df = narrow.select(*[F.translate(f"`{c}`", "".join(_C1), "".join(_C1.values())).alias(c) for c in narrow.columns])
    plain = [F.regexp_replace(f"`{c}`", LINE_ENDS, "").alias(c.lstrip("﻿")) for c in df.columns]
    return df.select(*plain, F.monotonically_increasing_id().alias("ord"))


def column(df: DataFrame, name: str):
    """The column, or null where the file has none of that name."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def read_lines(spark: SparkSession, path: str, *, until: str | None = None) -> DataFrame:
    """(path, ord, line) of text files, without byte-order mark and carriage returns, up to a line that begins with `until`."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    if until is not None:
        whole = whole.withColumn("value", F.regexp_replace("value", rf"(?s)(?:^|(?<=\n))\Q{until}\E.*$", ""))
    return whole.select("path", F.posexplode(F.split("value", "\n", -1)).alias("ord", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))


def pages_between(lines: DataFrame, start: int, end: int) -> DataFrame:
    """The lines or fragments of pages start to end, in order, to be looked at."""
    return lines.filter(F.col("page").between(start, end)).orderBy("path", "page", *[c for c in ("ord",) if c in lines.columns])


def read_documents(spark: SparkSession, *paths: str) -> tuple[DataFrame, list[str]]:
    """Entity rows of list documents, with list_id and ord (file order, then place), and the paths that are missing."""
    there, missing = [], []
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p).select("length").limit(1).collect()
            there.append(p)
        except AnalysisException:
            missing.append(p)
    if not there:
        return spark.createDataFrame([], DOCUMENT).select("list_id", F.inline("entities")).withColumn("ord", F.lit(0).cast("long")), missing
    docs = None
    for k, p in enumerate(there):
        one = spark.read.schema(DOCUMENT).option("multiLine", True).json(p).withColumn("file_no", F.lit(k))
        docs = one if docs is None else docs.unionByName(one)
    rows = docs.select("list_id", "file_no", F.posexplode("entities").alias("pos", "e"))
    return rows.select("list_id", "e.*", (F.col("file_no") * (1 << 32) + F.col("pos")).alias("ord")), missing


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", True).json(path)


def lists_of(meta: DataFrame) -> DataFrame:
    return meta.select(F.inline("lists"))


def _pages(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


class Table(HTMLParser):
    """Cells of the first table: text, and the spans in strong."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, list[str]]]] = []
        self.state, self.cell, self.strong = "before", None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table" and self.state == "before":
            self.state = "in"
        elif self.state != "in":
            return
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = ([], [])
        elif self.cell and tag == "strong":
            self.strong = []
        elif self.cell and tag in ("br", "p"):
            self.cell[0].append(" ")

    def handle_endtag(self, tag):
        if self.state != "in":
            return
        if tag == "table":
            self.state = "after"
        elif tag == "strong" and self.strong is not None:
            span, self.strong = " ".join("".join(self.strong).split()), None
            if span and self.cell:
                self.cell[1].append(span)
        elif tag in ("td", "th") and self.cell:
            if self.rows:
                self.rows[-1].append((" ".join("".join(self.cell[0]).split()), self.cell[1]))
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[0].append(data)
            if self.strong is not None:
                self.strong.append(data)


class Sections(HTMLParser):
    """Items (li, first td of a row) under the headings h2 to h5."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[int, str, str]] = []
        self.heading, self.number, self.buffer, self.cells = "", 0, None, -1

    def handle_starttag(self, tag, attrs):
        if tag in ("h2", "h3", "h4", "h5", "li"):
            self.buffer = []
        elif tag == "tr":
            self.cells = 0
        elif tag == "td":
            self.cells += 1
            if self.cells == 1:
                self.buffer = []

    def handle_endtag(self, tag):
        ends = tag == "li" or tag == "td" and self.cells == 1
        if tag in ("h2", "h3", "h4", "h5") or ends:
            text, self.buffer = " ".join("".join(self.buffer or []).split()), None
            if text and ends:
                self.items.append((self.number, self.heading, text))
            elif text:
                self.heading, self.number = text, self.number + 1

    def handle_data(self, data):
        if self.buffer is not None:
            self.buffer.append(data)


def read_html_table(spark: SparkSession, path: str) -> DataFrame:
    return html_table(_pages(spark, path))


def html_table(pages: DataFrame) -> DataFrame:
    """(path, row_ord, cells array<struct<text, strongs>>) of each page's first table, from (path, content)."""
    ship(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                parser = Table()
                parser.feed(raw.decode("utf-8", "replace"))
                rows = [r for r in parser.rows if r]
                yield pd.DataFrame({"path": [p] * len(rows), "row_ord": range(len(rows)), "cells": [[{"text": t, "strongs": s} for t, s in r] for r in rows]})

    return pages.mapInPandas(run, "path string, row_ord int, cells array<struct<text:string,strongs:array<string>>>")


def read_html_sections(spark: SparkSession, path: str) -> DataFrame:
    return html_sections(_pages(spark, path))


def _framed(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows in frames of FRAME characters, or a row more: small pages share one, as a frame costs more than a page."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, str) else 8 for x in row)
        if size >= FRAME:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def html_sections(pages: DataFrame) -> DataFrame:
    """(path, ord, section_ord, heading, item) from (path, content)."""
    ship(pages.sparkSession)

    def items(frame: pd.DataFrame) -> Iterator[tuple]:
        for p, raw in zip(frame["path"], frame["content"], strict=True):
            parser = Sections()
            parser.feed(raw.decode("utf-8", "replace"))
            yield from ((p, i, *x) for i, x in enumerate(parser.items))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _framed(items(frame), ["path", "ord", "section_ord", "heading", "item"])

    return pages.mapInPandas(run, "path string, ord int, section_ord int, heading string, item string")


def read_html_tables(spark: SparkSession, path: str, *, expected: int | None = None) -> DataFrame:
    return html_tables(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), expected=expected)


def html_tables(pages: DataFrame, *, expected: int | None = None) -> DataFrame:
    """(path, table_no, row_no, cells array<string>) of all tables of each page (path, value), by patterns alone; their number is checked if given.

    One narrow stage: a page's rows and cells are cut out of it where it is. The number is checked while they are read.
    """
    tables = F.regexp_extract_all("value", F.lit(r"(?s)(<table.*?</table>)"), F.lit(1))
    if expected is not None:
        wrong = F.raise_error(F.concat(F.lit(f"expected {expected} tables, found "), F.size(tables).cast("string"), F.lit(" in "), "path"))
        tables = F.when(F.size(tables) == expected, tables).otherwise(wrong)
    each = pages.select("path", F.posexplode(tables).alias("table_no", "t"))
    rows = each.select("path", "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?s)(<tr.*?</tr>)"), F.lit(1))).alias("row_no", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?s)(<t[dh][^>]*>.*?</t[dh]>)"), F.lit(1)), strip_tags)
    return rows.select("path", "table_no", "row_no", cells.alias("cells")).filter(F.size("cells") > 0)


def read_docx_table(spark: SparkSession, path: str, *, columns: int = 3) -> DataFrame:
    """(path, row_ord, c0, c1, ...) of the first table of a document; short rows are padded; paragraphs of a cell are lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
                out = []
                first = body.find(f".//{w}tbl")
                for i, tr in enumerate([] if first is None else first.findall(f"{w}tr")):
                    cells = ["\n".join("".join(t.text or "" if t.tag == f"{w}t" else "\n" if t.tag == f"{w}br" else "\t" for t in p.iter() if t.tag in (f"{w}t", f"{w}br", f"{w}tab")) for p in tc.findall(f"{w}p")).strip() for tc in tr.findall(f"{w}tc")]
                    out.append((path, i, *(cells + [""] * columns)[:columns]))
                yield pd.DataFrame(out, columns=["path", "row_ord", *[f"c{k}" for k in range(columns)]])

    return _pages(spark, path).mapInPandas(run, "path string, row_ord int, " + ", ".join(f"c{k} string" for k in range(columns)))
