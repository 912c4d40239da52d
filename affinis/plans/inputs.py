"""One traversal of a source for estimates, runs and partitions: its objects, and what it was."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.config import Delimited, Files, Table, Workbook
from affinis.errors import DatasetFormatError, InputValidationError
from affinis.operators import objects as O
from affinis.plans.files import sha256_file, stamp
from affinis.sources import corpus, delimited, tables, workbook


@dataclass
class Scan:
    kind: str
    objects: DataFrame
    description: dict
    paths: tuple[Path, ...]
    stamps: tuple[tuple[int, int], ...]
    rows: DataFrame | None = None
    header: tuple[str, ...] = ()
    split: str | None = None

    def unchanged(self) -> None:
        try:
            now = tuple(stamp(p) for p in self.paths)
        except OSError as e:
            raise InputValidationError("Input disappeared", code="input_drift") from e
        if now != self.stamps:
            raise InputValidationError("Input changed", code="input_drift")

    def chunk_peak(self, chunk_rows: int) -> int:
        if self.rows is None:
            return self.objects.agg(F.max("size_bytes")).first()[0]
        return O.chunk_peak(self.rows, self.split, chunk_rows).first()[0]


def dataset_path(source) -> Path:
    if isinstance(source, (list, tuple)):
        if len(source) != 1:
            raise InputValidationError("A dataset is exactly one path")
        source = source[0]
    if not isinstance(source, (str, Path)):
        raise InputValidationError("A source is a path")
    path = Path(source).resolve()
    if not path.is_file():
        raise InputValidationError(f"Dataset is not a file: {path}")
    return path


def read_dataset(spark: SparkSession, source, kind) -> tuple[list[str], DataFrame, dict, Path]:
    """(header, rows, description, path) of a delimited file or a worksheet."""
    path = dataset_path(source)
    about = {"kind": kind.kind, "path": str(path), "size_bytes": path.stat().st_size, "sha256": sha256_file(path), "split": kind.split}
    if isinstance(kind, Workbook):
        header, rows, sheet = workbook.read(spark, path, kind)
        return header, rows, {**about, "sheet": sheet, "cell_text_rule": workbook.CELL_TEXT_RULE}, path
    header = delimited.header(path, kind)
    O.check_header(header)
    header, rows = delimited.read(spark, path, kind)
    return header, rows, {**about, "delimiter": kind.delimiter, "encoding": kind.encoding}, path


def scan(spark: SparkSession, source, kind) -> Scan:
    if isinstance(kind, Table):
        if not isinstance(source, DataFrame):
            raise InputValidationError("A table source is a DataFrame")
        header, rows = tables.read(source, kind)
        found = O.from_dataset(header, rows, kind.split)
        return Scan("table", found, {"kind": "table", "order_by": list(kind.order_by), "split": kind.split}, (), (), rows, tuple(header), kind.split)
    if isinstance(kind, Files):
        paths = [source] if isinstance(source, (str, Path)) else list(source) if isinstance(source, Sequence) and not isinstance(source, bytes) else [None]
        if not all(isinstance(p, (str, Path)) for p in paths):
            raise InputValidationError("A corpus is paths")
        root, files = corpus.read(spark, paths, kind)
        found = O.from_files(files)
        digest = O.set_digest(found).first()
        _, listed = corpus.listing(paths, kind)
        about = {"kind": "files", "root": str(root), "sha256": digest["sha256"], "size_bytes": digest["size_bytes"], "file_count": digest["file_count"], "recursive": kind.recursive, "include_hidden": kind.include_hidden}
        own = tuple(p for _, p in listed)
        return Scan("files", found, about, own, tuple(stamp(p) for p in own))
    if not isinstance(kind, (Delimited, Workbook)):
        raise DatasetFormatError("Unknown source kind")
    path = dataset_path(source)
    before = stamp(path)
    header, rows, about, path = read_dataset(spark, source, kind)
    found = O.from_dataset(header, rows, kind.split)
    return Scan(kind.kind, found, about, (path,), (before,), rows, tuple(header), kind.split)
