"""The extension point for alphas: a base class and a registry of names. None ships with the library."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AlphaMetadata:
    name: str
    version: int = 1
    horizon: str = "1d"
    description: str = ""


class Alpha(ABC):
    """Scores in [-1, 1] for each row of a feature panel."""

    metadata: AlphaMetadata

    @abstractmethod
    def compute(self, features: DataFrame) -> Column:
        """A column over ``features``; grouped-map pandas code may be used inside."""

    def scores(self, features: DataFrame, name: str = "score") -> DataFrame:
        """Adds the score, clipped to its range; nulls stay."""
        value = self.compute(features)
        return features.withColumn(name, F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))))


class AlphaRegistry:
    def __init__(self) -> None:
        self._known: dict[str, type[Alpha]] = {}

    def register(self, kind: type[Alpha]) -> type[Alpha]:
        name = kind.metadata.name
        if name in self._known:
            raise ValueError(f"alpha {name} is already registered")
        self._known[name] = kind
        return kind

    def __getitem__(self, name: str) -> type[Alpha]:
        if name not in self._known:
            raise KeyError(name)
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)
