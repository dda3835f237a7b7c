"""Texts are encoded chunk by chunk: what lies between blanks never merges across them, and chunks repeat."""

from __future__ import annotations

from collections.abc import Callable

#: Chunks that one generation of a task's memory holds; when it is full it becomes the old one, from which chunks that
#: come again are taken over. Results never depend on it.
CACHE_CHUNKS = 300_000
#: The same where a value takes some 300 bytes, so that two workers of an executor hold under 100 MB.
REMEMBERED = 80_000
#: Longer chunks are not remembered.
LONGEST = 48


class ChunkCache(dict):
    """chunk -> value, computed by ``make`` when it is first asked for."""

    def __init__(self, make: Callable, limit: int = CACHE_CHUNKS):
        super().__init__()
        self._make, self._limit = make, limit
        self._old: dict = {}

    def __missing__(self, chunk: str):
        value = self._old.get(chunk)
        if value is None:
            value = self._make(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self._limit:
                self._old = self.copy()
                self.clear()
            self[chunk] = value
        return value


def chunks(text: str) -> list[str]:
    """Parts between blanks and line feeds; empty ones where these repeat."""
    return text.replace("\n", " ").split(" ")
