"""What an ingest keeps beside a history, derived from the test tables for the
registered queries: the day-partitioned layout, the summary tree and the dimension.

They are written once per session and table folder into the shared folder, as an
ingest would have done before any request, and read by every query after that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tagscope.operators.tree import SummaryTree, read_tree, write_tree
from tagscope.session import shared_dir
from tagscope.sources import testdata as td
from tagscope.sources.history import read_history, write_history
from tagscope.streaming import dimension as dim

VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"history": td.history, "counter": td.counter_history, "state": td.state_history}
_WRITTEN: dict[tuple, str] = {}


@dataclass
class Derived:
    history: DataFrame
    tree: SummaryTree
    dimension: DataFrame


def derived(spark: SparkSession, sf_dir: str, view: str = "history") -> Derived:
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/derived-{view}-{uuid.uuid4().hex}"
        write_history(VIEWS[view](spark, sf_dir), f"{path}/history", mode="overwrite")
        written = read_history(spark, f"{path}/history")
        write_tree(written, f"{path}/tree")
        dim.add_batch(written, f"{path}/dimension", 0)
        _WRITTEN[key] = path
    path = _WRITTEN[key]
    return Derived(read_history(spark, f"{path}/history"), read_tree(spark, f"{path}/tree"), dim.read_dimension(spark, f"{path}/dimension"))
