"""Settings: sources, codecs' choices, limits, execution. All are frozen and validated when made."""

from __future__ import annotations

import codecs as _codecs
import os
from dataclasses import dataclass, field

from affinis.errors import ConfigurationError


def _int(name: str, value: object, least: int, most: int | None = None) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < least or (most is not None and value > most):
        raise ConfigurationError(f"{name} must be an integer of at least {least}" + (f" and at most {most}" if most is not None else ""))
    return value


def _choice(name: str, value: object, allowed: tuple) -> None:
    if value not in allowed:
        raise ConfigurationError(f"{name} must be one of {', '.join(map(repr, allowed))}")


@dataclass(frozen=True)
class Delimited:
    """A delimited text file whose first record is the header."""

    split: str = "columns"
    delimiter: str = ","
    encoding: str = "utf-8"
    kind: str = "delimited"

    def __post_init__(self):
        _choice("split", self.split, ("columns", "rows"))
        if not isinstance(self.delimiter, str) or len(self.delimiter) != 1 or self.delimiter in '"\r\n':
            raise ConfigurationError("delimiter must be one character other than a quote or line end")
        try:
            _codecs.lookup(self.encoding)
        except (LookupError, TypeError) as e:
            raise ConfigurationError(f"unknown encoding {self.encoding!r}") from e


@dataclass(frozen=True)
class Workbook:
    """A worksheet of an .xlsx file."""

    split: str = "columns"
    sheet: str | None = None
    kind: str = "xlsx"

    def __post_init__(self):
        _choice("split", self.split, ("columns", "rows"))


@dataclass(frozen=True)
class Files:
    """Files and folders, each file an object."""

    recursive: bool = True
    include_hidden: bool = False
    kind: str = "files"


@dataclass(frozen=True)
class Table:
    """A DataFrame with a column that orders its rows; cells are their values as text, null as the empty text."""

    order_by: tuple[str, ...]
    split: str = "columns"
    kind: str = "table"

    def __post_init__(self):
        _choice("split", self.split, ("columns", "rows"))
        if not self.order_by:
            raise ConfigurationError("a table needs order_by")


@dataclass(frozen=True)
class Limits:
    """What a run may cost. max_pair_window_factor is on what it measures: the largest pair against the codec's window."""

    max_objects: int = 1_000
    max_pairs: int = 500_000
    max_matrix_bytes: int = 536_870_912
    max_working_memory_bytes: int = 536_870_912
    required_free_disk_factor: float = 1.25
    max_pair_window_factor: float = 1.0

    def __post_init__(self):
        for name in ("max_objects", "max_pairs", "max_matrix_bytes", "max_working_memory_bytes"):
            _int(name, getattr(self, name), 1)
        if not self.required_free_disk_factor >= 1:
            raise ConfigurationError("required_free_disk_factor must be at least 1")
        if not self.max_pair_window_factor > 0:
            raise ConfigurationError("max_pair_window_factor must be above 0")


@dataclass(frozen=True)
class Execution:
    """How a run is carried out; nothing here changes what it computes."""

    workers: int | str = "auto"
    chunk_rows: int = 50_000
    compression_chunk_bytes: int = 4_194_304
    pairs_per_shard: int | str = "auto"
    resume: bool = True
    reuse_completed: bool = True
    materialization_limit_bytes: int = 268_435_456
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self):
        for name in ("workers", "pairs_per_shard"):
            if getattr(self, name) != "auto":
                _int(name, getattr(self, name), 1)
        for name in ("chunk_rows", "compression_chunk_bytes", "materialization_limit_bytes"):
            _int(name, getattr(self, name), 1)

    @property
    def effective_workers(self) -> int:
        return min(4, max(1, (os.cpu_count() or 1) - 1)) if self.workers == "auto" else int(self.workers)

    def shard_pairs(self, pairs: int) -> int:
        """Pairs of a shard: at least 64 shards where there are enough pairs, of 10 000 pairs at most."""
        return min(10_000, max(1, pairs // 64)) if self.pairs_per_shard == "auto" else int(self.pairs_per_shard)
