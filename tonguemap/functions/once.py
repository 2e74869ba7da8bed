"""Reuse of column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext


def once(build: Callable) -> Callable:
    """Build a column expression of fixed column names once and reuse it in every later plan.

    A large expression takes thousands of calls into the JVM to put together, seconds that each query,
    and each micro-batch of a stream, would spend again.
    """
    built: dict = {}

    @functools.wraps(build)
    def get(*names: str):
        # the gateway itself is held, so that no later one can be taken for it
        gateway = SparkContext._gateway
        if built.get("gateway") is not gateway:
            built.clear()
            built["gateway"] = gateway
        if names not in built:
            built[names] = build(*names)
        return built[names]

    return get
