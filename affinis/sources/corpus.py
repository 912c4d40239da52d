"""Files as objects: listed on the driver by one rule, read on the executors byte by byte.

Spark's binaryFile would leave out names that begin with a dot or an underscore.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from affinis.config import Files
from affinis.errors import InputValidationError


def _refuse(message: str) -> InputValidationError:
    return InputValidationError(message, code="corpus_validation_error")


def _below(folder: Path, recursive: bool) -> Iterator[Path]:
    with os.scandir(folder) as entries:
        for entry in sorted(entries, key=lambda e: e.name):
            if entry.is_symlink():
                raise _refuse(f"Corpus entry is a symlink: {entry.path}")
            if entry.is_dir():
                if recursive:
                    yield from _below(Path(entry.path), recursive)
            else:
                yield Path(entry.path)


def listing(paths: Sequence[str | Path], source: Files) -> tuple[Path, list[tuple[str, Path]]]:
    """(root, [(label, path)]) in order of the labels, which are paths relative to the root."""
    given = [Path(p).resolve() for p in paths]
    if not given:
        raise InputValidationError("No corpus path was given")
    found: list[Path] = []
    for p in given:
        if p.is_dir():
            found += _below(p, source.recursive)
        elif p.exists():
            found.append(p)
        else:
            raise InputValidationError(f"Corpus path does not exist: {p}")
    if len(given) == 1 and given[0].is_dir():
        root = given[0]
    else:
        root = Path(os.path.commonpath(found)) if len(found) > 1 else found[0].parent if found else Path.cwd()
    labels = [(p.relative_to(root).as_posix(), p) for p in found]
    if not source.include_hidden:
        labels = [(x, p) for x, p in labels if not any(part.startswith(".") for part in x.split("/"))]
    if len({p for _, p in labels}) != len(labels):
        raise _refuse("Corpus contains the same file twice")
    for _, p in labels:
        if not p.is_file():
            raise _refuse(f"Corpus entry is not a regular file: {p}")
        if not p.stat().st_size:
            raise _refuse(f"Corpus entry is empty: {p}")
    if len(labels) < 2:
        raise _refuse(f"A corpus needs at least two files; found {len(labels)}")
    return root, sorted(labels)


def read(spark: SparkSession, paths: Sequence[str | Path], source: Files) -> tuple[Path, DataFrame]:
    """(root, rows of object_idx, label, payload)."""
    root, found = listing(paths, source)

    def load(batches):
        for batch in batches:
            for k, label, path in zip(*(batch.column(c).to_pylist() for c in ("object_idx", "label", "path")), strict=True):
                with open(path, "rb") as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([label]), pa.array([stream.read()], pa.binary())], ["object_idx", "label", "payload"])

    rows = [(k, label, str(p)) for k, (label, p) in enumerate(found)]
    listed = spark.createDataFrame(rows, "object_idx long, label string, path string").repartition(min(len(rows), 256))
    return root, listed.mapInArrow(load, "object_idx long, label string, payload binary")
