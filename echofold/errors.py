"""Errors by what the caller can do about them."""

from __future__ import annotations


class EngineError(Exception):
    exit_code, retryable = 20, False

    @classmethod
    def of(cls, operation: str, path: str, cause: Exception) -> EngineError:
        """What was done to which path, and what came of it."""
        made = cls(f"{operation} {path}: {cause}")
        made.operation, made.path, made.__cause__ = operation, path, cause
        return made


class InvalidInput(EngineError):
    exit_code = 2


class SafetyError(EngineError):
    """What was proven before doesn't hold any longer."""

    exit_code = 3


class StateError(EngineError):
    exit_code = 5


class DurabilityError(EngineError):
    exit_code, retryable = 10, True
