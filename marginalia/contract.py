"""What a strategy and a synthesizer have to offer."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from marginalia.types import Clique, Domain

if TYPE_CHECKING:
    from marginalia.operators.marginals import TableCounts
    from marginalia.plans.compression import Compressor
    from marginalia.plans.inference import Measurement


@dataclass
class Chosen:
    """Measurements, and the compression that those of them that are ``coded`` were made under."""

    measurements: list[Measurement]
    compressor: Compressor


class Chooser(ABC):
    """Decides which marginals of a table are measured, and measures them within a budget."""

    @abstractmethod
    def select(self, domain: Domain, counts: TableCounts, public: bool = False, impossible: Mapping[str, Sequence[int]] | None = None) -> Chosen:
        """Choose and measure. public: every choice is the best one and nothing is noisy or paid for."""

    @abstractmethod
    def remeasure(self, domain: Domain, counts: TableCounts, cliques: Sequence[Clique], impossible: Mapping[str, Sequence[int]] | None = None) -> Chosen:
        """Spend all of the budget on cliques that were chosen before."""

    @abstractmethod
    def set_random_state(self, seed: int | None) -> None:
        """The seed of all noise from here on; None: the system's entropy."""


class Synthesizer(ABC):
    """Learns from a table and makes rows like it."""

    @abstractmethod
    def fit(self, df: DataFrame, **how) -> Synthesizer:
        """Learn; returns itself."""

    @abstractmethod
    def generate(self, spark: SparkSession, n_records: int | None = None, **how) -> DataFrame:
        """New rows; an error where nothing was learned."""

    @abstractmethod
    def set_random_state(self, seed: int | None) -> Synthesizer:
        """One seed for all that is drawn from here on; returns itself."""

    @abstractmethod
    def store(self, spark: SparkSession, path: str) -> None:
        """Write what was learned, never rows, to a folder of any file system that Spark knows."""

    @classmethod
    @abstractmethod
    def load(cls, spark: SparkSession, path: str) -> Synthesizer:
        """What ``store`` wrote."""
