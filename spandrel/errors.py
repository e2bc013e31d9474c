"""Errors of this package."""

from __future__ import annotations


class MaxDepthError(ValueError):
    """A document is nested deeper than allowed."""

    def __init__(self, path: str, max_depth: int):
        super().__init__(f"maximum depth {max_depth} exceeded at {path}")
        self.path, self.max_depth = path, max_depth


class OutOfRangeError(ValueError):
    """A point in time that has no UTC form within the years 1 to 9999."""
