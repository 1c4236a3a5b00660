"""Errors that fits, tests and sources raise."""

from __future__ import annotations


class StatError(Exception):
    """Base of all errors of this package."""


class SingularMatrix(StatError):
    """A system of equations has no unique solution."""


class InsufficientData(StatError):
    def __init__(self, required: int, available: int):
        super().__init__(f"{required} rows are needed, {available} are there")
        self.required, self.available = required, available


class InvalidInput(StatError):
    """An argument or a value is out of its domain."""


class DimensionMismatch(StatError):
    """Lengths or column counts differ."""


class ComputationFailed(StatError):
    """An iteration did not give a finite result."""


class ParseError(StatError):
    """Text is not of the expected format."""


class SerializationError(StatError):
    """A model cannot be written."""


class DeserializationError(StatError):
    """A model cannot be read."""


class IncompatibleFormatVersion(DeserializationError):
    """A model file is of another major version."""


class ModelTypeMismatch(DeserializationError):
    """A model file holds another kind of model."""
