"""Comparing every row of one table with every row of another in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpointing import materialize

ROWS = 4096


def block_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows: int = ROWS) -> DataFrame:
    """``compare`` of each pair of blocks; its rows are partial results, to be merged by the caller.

    Blocks hold about ``rows`` rows by a hash of the key, so each task sees two blocks whatever the
    size of the tables, results of a block stay in its task, and no pair of rows is ever shuffled."""
    n_left, n_right = (max(1, math.ceil(x.count() / rows)) for x in (left, right))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = left.withColumn("__i", block(left_key, n_left)).withColumn("__j", every(n_right))
    y = right.withColumn("__j", block(right_key, n_right)).withColumn("__i", every(n_left))
    names = [f.split()[0] for f in schema.split(",")]

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:  # a block that is empty on one side comes without columns
        return compare(a, b) if len(a) and len(b) else pd.DataFrame({k: [] for k in names})

    # written down: the costly part runs once, whatever the caller does with it
    return materialize(x.groupBy("__i", "__j").cogroup(y.groupBy("__i", "__j")).applyInPandas(both, schema), "blocks")
