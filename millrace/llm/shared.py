"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import shared_folder


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more.

    It does so when the driver's JVM collects what refers to them, which else may
    be much later.  Python's references are given back by a thread of its own, so
    the JVM is asked a moment later, and once more for what depended on those.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(0.4)
        spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs no recomputation of it.

    The shuffle files that led to it aren't needed then; they go once the caller
    has dropped ``df``, at a later cut or release.
    """
    shared_folder(df.sparkSession)
    made = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return made
