"""Delimited text as it is: every cell is text, blank lines are rows of empty cells, and a record whose field count
differs from the header's is an error that names its line. Spark's own CSV reader drops, pads or renames instead.
"""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from affinis.config import Delimited
from affinis.errors import DatasetFormatError

FORMAT = "affinis_delimited"
_FIELD_LIMIT = 2**31 - 1
_HEADER_ERROR = "Could not read a valid delimited header"


def _records(path: str, delimiter: str, encoding: str) -> Iterator[list[str]]:
    csv.field_size_limit(_FIELD_LIMIT)
    with open(path, encoding=encoding, errors="strict", newline="") as stream:
        yield from csv.reader(stream, delimiter=delimiter)


def header(path: str | Path, source: Delimited) -> list[str]:
    try:
        names = next(_records(str(path), source.delimiter, source.encoding))
    except (OSError, UnicodeError, csv.Error, StopIteration) as e:
        raise DatasetFormatError(_HEADER_ERROR) from e
    if names and codecs.lookup(source.encoding).name == "utf-8":
        names[0] = names[0].removeprefix("﻿")
    return names


def first_fault(path: str, source: Delimited, width: int) -> str | None:
    """What breaks the contract first, without any cell's content."""
    try:
        records = _records(path, source.delimiter, source.encoding)
        next(records, None)
        for line, record in enumerate(records, start=2):
            if record and len(record) != width:
                return f"Line {line} has {len(record)} fields but the header declares {width}"
    except (OSError, UnicodeError, csv.Error):
        return "Delimited parsing failed"
    return None


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options["width"])
        self.delimiter, self.encoding = options.get("delimiter", ","), options.get("encoding", "utf-8")
        self.columns = [int(k) for k in options["columns"].split(",")] if options.get("columns") else None

    def partitions(self):
        return [InputPartition(self.path)]  # quoted line ends: a file can't be cut by bytes

    def read(self, partition):
        records = _records(partition.value, self.delimiter, self.encoding)
        next(records, None)
        blank = [""] * self.width
        for k, record in enumerate(records):
            cells = record or blank
            yield k, cells if self.columns is None else [cells[c] for c in self.columns]


class DelimitedText(DataSource):
    """spark.read.format("affinis_delimited").options(path, width, delimiter, encoding, columns)"""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "row_idx bigint, cells array<string>"

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, path: str | Path, source: Delimited, *, columns: list[int] | None = None) -> tuple[list[str], DataFrame]:
    """(header, rows of row_idx and cells), after a pass on an executor that checks every record."""
    names = header(path, source)

    def check(frames):
        for frame in frames:
            yield pd.DataFrame({"fault": [first_fault(p, source, len(names)) for p in frame["path"]]})

    fault = spark.createDataFrame([(str(path),)], "path string").mapInPandas(check, "fault string").first()[0]
    if fault:
        raise DatasetFormatError(fault)
    spark.dataSource.register(DelimitedText)
    options = {"path": str(path), "width": len(names), "delimiter": source.delimiter, "encoding": source.encoding}
    if columns is not None:
        options["columns"] = ",".join(map(str, columns))
    return (names if columns is None else [names[k] for k in columns]), spark.read.format(FORMAT).options(**options).load()
