"""Several fits at once: each is many small jobs, which leave most of a cluster idle."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Fits that run at once.
PARALLEL = 6


def at_once(work: Callable, items: Iterable) -> list:
    """work of each item in order, some at a time, with the caller's job properties."""
    with ThreadPoolExecutor(PARALLEL) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))
