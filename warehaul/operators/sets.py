"""Set operations beyond UNION, INTERSECT and EXCEPT."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from warehaul.operators.windows import top_n_per_key


def union_first(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union that keeps, for every key, only its first row by ``order``."""
    return top_n_per_key(reduce(DataFrame.unionByName, frames), keys, order, 1)
