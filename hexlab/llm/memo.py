"""A bounded store of results per distinct piece of text, kept by a Python worker over its tasks."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` computes what it lacks; ``trim()`` empties it once it holds more than ``limit`` keys."""

    def __init__(self, compute: Callable, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
