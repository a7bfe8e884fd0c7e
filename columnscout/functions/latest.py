"""Current rows of tables that keep superseded versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: Sequence[str], version: str, ties: Sequence[Column | str] = ()) -> DataFrame:
    """For each combination of `keys` the row with the greatest `version`.

    Rows with a null key are left out; a null version counts as the oldest. Exact
    repeats give one row. Rows that tie in `version` are told apart by `ties`, in
    descending order, so that the result doesn't depend on the order of arrival.
    """
    order = [F.col(version).desc_nulls_last(), *(F.col(t).desc_nulls_last() if isinstance(t, str) else t for t in ties)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    known = df.dropna(subset=list(keys))
    return known.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
