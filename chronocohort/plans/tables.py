"""A set of derived tables that are built on first use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Tables:
    """Tables by name; a builder gets the whole set and may ask for other tables."""

    def __init__(self, builders: dict[str, Callable[[Tables], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](self)
        return self._built[name]

    def keys(self):
        return self._builders.keys()
