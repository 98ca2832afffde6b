"""User functions that models may call by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Functions(dict):
    """Name to (function, result type, whether it takes whole pandas columns)."""

    def define(self, name: str, function: Callable, returns: str, vectorized: bool = True) -> None:
        """``vectorized`` functions get and give pandas Series in Arrow batches; others are called for each row."""
        self[name] = function, returns, vectorized

    def register(self, spark: SparkSession) -> None:
        for name, (function, returns, vectorized) in self.items():
            spark.udf.register(name, (F.pandas_udf if vectorized else F.udf)(function, returns))
