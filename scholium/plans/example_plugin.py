"""A plugin to copy from: it marks what was retrieved with the name of its run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = "example"


def tagged(rows: DataFrame) -> DataFrame:
    """rows with a column more; what a plugin gives must keep the columns that it got."""
    return rows.withColumn("plugin_tag", F.lit(TAG))


def register(add: Callable[[str, Callable], None]) -> None:
    add("after_retrieve", tagged)
