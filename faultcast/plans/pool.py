"""Independent Spark jobs side by side.

A fit on a few hundred rows is a chain of jobs of one task each, so one fit
keeps one core busy whatever the cluster has.  Fits of different systems, models,
folds and trials do not need each other; they are submitted from a bounded
number of threads that inherit the session's local properties (job group,
scheduler pool).  With ``spark.scheduler.mode=FAIR`` they share the cores evenly.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Calls that run at a time.
WIDTH = 8


def run_all(calls: list[Callable], width: int = WIDTH) -> list:
    """Results of the calls in their order; the first failure is raised after the running calls have ended."""
    if width <= 1 or len(calls) <= 1:
        return [c() for c in calls]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(width, len(calls))) as pool:
        futures = [pool.submit(inherit(c)) for c in calls]
        try:
            return [f.result() for f in futures]
        finally:
            for f in futures:
                f.cancel()
