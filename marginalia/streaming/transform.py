"""A frozen discretisation inside Structured Streaming: stateless, no budget is spent."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marginalia.operators.binning import TableBinner


def coded_stream(stream: DataFrame, binner: TableBinner, keep: tuple[str, ...] = ()) -> DataFrame:
    """Codes of a stream of rows. The binner must be fitted; it is never refitted here."""
    if binner.schema is None:
        raise ValueError("the binner is not fitted")
    return binner.transform(stream, keep)
