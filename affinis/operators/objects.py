"""Objects: rows or columns of a dataset, or files, as canonical bytes.

object_idx (from 0), object_id, label, payload, size_bytes, sha256.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.errors import DatasetFormatError
from affinis.functions.serialize import cell_bytes, row_bytes, serialize_row


def check_header(names: list[str]) -> None:
    if not names or not all(names):
        raise DatasetFormatError("Column names must be non-empty")
    if len(set(names)) != len(names):
        raise DatasetFormatError("Column names must be unique")


def described(objects: DataFrame) -> DataFrame:
    """object_idx, object_id, label, payload with size and hash."""
    return objects.select("object_idx", "object_id", "label", "payload", F.octet_length("payload").cast("long").alias("size_bytes"), F.sha2("payload", 256).alias("sha256"))


def _id(prefix: str):
    return F.format_string(f"{prefix}_%06d", F.col("object_idx") + 1)


def by_rows(rows: DataFrame) -> DataFrame:
    """Each row an object, a JSON array of its cells."""
    out = rows.select(F.col("row_idx").alias("object_idx"), serialize_row("cells").alias("payload"))
    return described(out.withColumn("object_id", _id("row")).withColumn("label", F.col("object_id")))


def by_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each column an object, a JSON string a line for each cell, in row order.

    Runs of rows are joined to one piece for each column where they lie; only pieces are shuffled, and put in order.
    """
    width = len(names)

    def pieces(batches):
        for batch in batches:
            if batch.num_rows:
                first = batch.column("row_idx")[0].as_py()
                cells = batch.column("cells").to_pylist()
                joined = [b"".join(cell_bytes(c[k]) for c in cells).decode() for k in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array([first] * width, pa.int64()), pa.array(joined)], ["object_idx", "first", "piece"])

    ordered = rows.repartitionByRange("row_idx").sortWithinPartitions("row_idx")
    parts = ordered.mapInArrow(pieces, "object_idx long, first long, piece string")
    joined = parts.groupBy("object_idx").agg(F.array_sort(F.collect_list(F.struct("first", "piece"))).alias("p"))
    labels = rows.sparkSession.createDataFrame(list(enumerate(names)), "object_idx long, label string")
    out = joined.select("object_idx", F.encode(F.array_join("p.piece", ""), "UTF-8").alias("payload")).join(F.broadcast(labels), "object_idx")
    return described(out.withColumn("object_id", _id("column")))


def from_dataset(names: list[str], rows: DataFrame, split: str) -> DataFrame:
    """Objects of a dataset, after the checks on its shape."""
    check_header(names)
    least = 2 if split == "rows" else 1
    if split == "columns" and len(names) < 2:
        raise DatasetFormatError("split='columns' needs at least two columns")
    if rows.limit(least).count() < least:
        raise DatasetFormatError(f"split={split!r} needs at least {least} data row{'s' * (least > 1)}")
    return by_rows(rows) if split == "rows" else by_columns(rows, names)


def from_files(files: DataFrame) -> DataFrame:
    """object_idx, label, payload as raw-byte objects."""
    return described(files.withColumn("object_id", _id("file")))


def chunk_peak(rows: DataFrame, split: str, chunk_rows: int) -> DataFrame:
    """One row: the most serialized bytes of any chunk_rows rows."""

    def sizes(batches):
        for batch in batches:
            cells = batch.column("cells").to_pylist()
            n = [len(row_bytes(c)) if split == "rows" else sum(len(cell_bytes(x)) for x in c) for c in cells]
            yield pa.RecordBatch.from_arrays([batch.column("row_idx"), pa.array(n, pa.int64())], ["row_idx", "n"])

    by_row = rows.mapInArrow(sizes, "row_idx long, n long")
    return by_row.groupBy(F.floor(F.col("row_idx") / chunk_rows).alias("chunk")).agg(F.sum("n").alias("n")).agg(F.max("n").alias("max_serialized_chunk_bytes"))


def set_digest(objects: DataFrame) -> DataFrame:
    """One row: SHA-256 over a JSON line of label, size and hash for each object in order."""
    line = F.concat(F.regexp_replace(F.to_json(F.array("label")), r"\]\z", ""), F.lit(","), F.col("size_bytes").cast("string"), F.lit(',"'), F.col("sha256"), F.lit('"]\n'))
    lines = F.array_sort(F.collect_list(F.struct("object_idx", line.alias("line"))))
    return objects.agg(F.sha2(F.array_join(lines["line"], ""), 256).alias("sha256"), F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("file_count"))
