"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewheel.sources.shared import cut

__all__ = ["cut", "map_distinct", "text_of"]


def text_of(df: DataFrame, column: str):
    """``column`` as a string whatever it is; keeps nulls."""
    col = F.col(f"`{column}`")
    return col if isinstance(df.schema[column].dataType, StringType) else col.cast("string")


def map_distinct(texts: pa.Array, one: Callable[[str], object]) -> list:
    """``one`` of each text, worked out once per distinct text of the batch; null for null."""
    coded = texts.dictionary_encode()
    done = [one(x) for x in coded.dictionary.to_pylist()]
    return [None if i is None else done[i] for i in coded.indices.to_pylist()]

