"""What a worker process remembers between texts, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

#: Entries in a generation.
SIZE = 400_000

_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """The one thing this worker process keeps between tasks; asking for another lets it go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Let go of what an earlier operator left in this worker process."""
    _KEPT.clear()


class Memory(dict):
    """A mapping of chunks to ids that forgets what was not used lately.

    It holds two generations of at most ``size`` entries. When the younger is full it
    becomes the older, and what is asked for from there comes back, so frequent
    chunks stay and rare ones go. Only time depends on it, never a result.
    """

    def __init__(self, size: int = SIZE) -> None:
        super().__init__()
        self.size, self.older = size, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.older[chunk]
        return ids

    def renew(self) -> None:
        """Start a generation if this one is full; call it where no lookup is under way."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
