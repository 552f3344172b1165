"""Frames planned on first use."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class LazyFrames(Mapping):
    """Named frames; one that nobody asks for is never planned."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def __contains__(self, name: object) -> bool:
        return name in self._builders

    def replaced(self, **frames: DataFrame) -> LazyFrames:
        """The same frames with some put in place of others."""
        out = LazyFrames({**self._builders, **{name: (lambda f=frame: f) for name, frame in frames.items()}})
        return out
