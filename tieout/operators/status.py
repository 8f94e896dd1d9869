"""Outcomes of a comparison. Only PASSED is truthy: nothing compared is never a pass."""

from __future__ import annotations

import enum
from dataclasses import dataclass


class Status(str, enum.Enum):
    PASSED = "passed"
    NOT_RECONCILED = "not_reconciled"
    FAILED = "failed"

    def __bool__(self) -> bool:
        return self is Status.PASSED


SEVERITY = {Status.PASSED: 0, Status.NOT_RECONCILED: 1, Status.FAILED: 2}

# Why something was not reconciled.
REASONS = [
    "no_regions",
    "no_cached_values",
    "partial_cached_values",
    "baseline_range_empty",
    "baseline_range_unreadable",
    "baseline_truncated",
    "no_actual_values",
    "notebook_failed",
    "not_reproduced",
]


def worst(statuses) -> Status:
    """The most severe outcome; nothing at all is not reconciled."""
    return max(statuses, key=lambda s: SEVERITY[s], default=Status.NOT_RECONCILED)


@dataclass(frozen=True)
class Tolerance:
    absolute: float = 1e-6
    relative: float = 0.0

    def __post_init__(self) -> None:
        if self.absolute < 0 or self.relative < 0:
            raise ValueError("tolerances cannot be negative")

    def describe(self) -> str:
        text = f"absolute {self.absolute:g}"
        return f"{text} or relative {self.relative:g}" if self.relative > 0 else text
