"""Typed errors of the engine."""

from __future__ import annotations


class QuoteError(ValueError):
    """Base of all errors about quotes and models."""


class InvalidConfig(QuoteError):
    """A setting is outside its range."""


class InvalidBook(QuoteError):
    """A book breaks the ordering policy or has no size at all."""

    def __init__(self, message: str, row: int | None = None):
        super().__init__(message if row is None else f"row {row}: {message}")
        self.row = row


class BadRow(QuoteError):
    """A row of a source that the policy does not let pass; names its line."""

    def __init__(self, line: int, reason: str):
        super().__init__(f"line {line}: {reason}")
        self.line, self.reason = line, reason


class BadSchema(QuoteError):
    """A source lacks a column or has it with another type."""


class OutOfOrder(QuoteError):
    """Sequence numbers do not strictly increase, or times decrease."""


class TooFewObservations(QuoteError):
    """A state was never visited and nothing smooths it, or a set is too small."""


class NoConvergence(QuoteError):
    """The fixed point was not reached within the sweeps allowed."""


class BadModel(QuoteError):
    """A stored model is inconsistent."""
