"""Failures. `code` is stable and machine-readable; messages hold line numbers, counts, names and paths, never cell values."""

from __future__ import annotations

import re


class AffinisError(Exception):
    """The base of every failure here."""

    def __init__(self, message: str, *, code: str | None = None, **context: object) -> None:
        super().__init__(message)
        self.code = code or re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", type(self).__name__).lower()
        self.context = context


class ConfigurationError(AffinisError):
    """An argument is invalid."""


class InputValidationError(AffinisError):
    """The input is missing, of the wrong kind, unreadable, or changed meanwhile (code input_drift)."""


class DatasetFormatError(InputValidationError):
    """A dataset breaks the input contract."""


class ResourceLimitError(AffinisError):
    """The estimate is beyond the limits; context["estimate"] holds it."""


class OutputDirectoryConflictError(AffinisError):
    """The output folder holds something else, or reuse is off."""


class CheckpointMismatchError(AffinisError):
    """State to resume from can't be trusted."""


class NormalizationError(AffinisError):
    """Objects could not be made."""


class CompressionError(AffinisError):
    """A codec is missing or rejected an object."""


class DistanceComputationError(AffinisError):
    """Distances could not be computed."""


class DistanceMatrixValidationError(AffinisError):
    """A distance matrix breaks an invariant."""


class TreeBuildError(AffinisError):
    """The tree could not be built."""


class TreeFormatError(TreeBuildError):
    """A tree is not a valid binary tree."""


class ClusterizationError(AffinisError):
    """Communities could not be found or don't cover the leaves."""


class ArtifactValidationError(AffinisError):
    """A written artifact fails its schema, size, hash or place."""


class MaterializationError(AffinisError):
    """A matrix is too large to be brought to the driver."""
