"""What a run will cost, in whole numbers, before it starts; and which limits that breaks."""

from __future__ import annotations

import math
import shutil
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.config import Execution
from affinis.plans.inputs import Scan


@dataclass(frozen=True)
class Estimate:
    source_kind: str
    source_paths: tuple[str, ...]
    input_sha256: str | None
    input_size_bytes: int | None
    split: str | None
    object_count: int
    pair_count: int
    effective_workers: int
    matrix_bytes: int
    normalized_bytes: int
    max_serialized_chunk_bytes: int
    compression_input_bytes: int
    max_pair_bytes: int
    compressor_window_bytes: int | None
    estimated_working_memory_bytes: int
    estimated_final_metadata_bytes: int
    estimated_diagnostic_bytes: int
    estimated_artifact_bytes: int
    required_free_disk_bytes: int
    available_free_disk_bytes: int
    within_limits: bool
    violations: tuple[str, ...]

    def to_json(self) -> dict:
        return {**asdict(self), "source_paths": list(self.source_paths), "violations": list(self.violations)}


def totals(objects: DataFrame) -> DataFrame:
    """One row from one pass: objects, bytes, label bytes, the largest size and the sum of the two largest."""
    top = W.orderBy(F.col("size_bytes").desc())
    sums = objects.agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"), F.sum(F.octet_length("label")).alias("label_bytes"), F.max("size_bytes").alias("largest"))
    two = objects.orderBy(F.col("size_bytes").desc()).limit(2).withColumn("k", F.row_number().over(top)).agg(F.sum("size_bytes").alias("max_pair_bytes"))
    return sums.join(F.broadcast(two))


def estimate(scan: Scan, codec, execution: Execution, *, save_diagnostics: bool = False, target: Path | str = ".") -> Estimate:
    t = totals(scan.objects.select("size_bytes", "label")).first()
    n, total = t["objects"], t["bytes"]
    pairs = n * (n - 1) // 2
    per_shard = execution.shard_pairs(pairs)
    matrix = 8 * n * n
    metadata = 1_048_576 + 4_096 * n + 8 * t["label_bytes"]
    diagnostics = 32 * n * n + 96 * pairs + 2 * t["label_bytes"] if save_diagnostics else 0
    artifacts = total + 2 * matrix + math.ceil(pairs / per_shard) * 256 + metadata + diagnostics
    peak = scan.chunk_peak(execution.chunk_rows)
    working = max(6 * peak, execution.effective_workers * (2 * execution.compression_chunk_bytes + codec.stream_bytes) + 24 * per_shard)
    limits, window = execution.limits, codec.window_bytes
    disk = math.ceil(artifacts * limits.required_free_disk_factor)
    place = Path(target).resolve()
    while not place.exists():
        place = place.parent
    free = shutil.disk_usage(place).free
    gates = {
        "max_objects": n > limits.max_objects,
        "max_pairs": pairs > limits.max_pairs,
        "max_matrix_bytes": matrix > limits.max_matrix_bytes,
        "max_working_memory_bytes": working > limits.max_working_memory_bytes,
        "free_disk": disk > free,
        "compressor_window": window is not None and t["max_pair_bytes"] > window * limits.max_pair_window_factor,
    }
    broken = tuple(name for name, fails in gates.items() if fails)
    return Estimate(
        scan.kind, tuple(map(str, scan.paths)), scan.description.get("sha256"), scan.description.get("size_bytes"), scan.split, n, pairs, execution.effective_workers, matrix, total, peak,
        n * total + 2 * t["largest"], t["max_pair_bytes"], window, working, metadata, diagnostics, artifacts, disk, free, not broken, broken,
    )
