"""Chains of DataFrame steps."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def pipe(*steps: Step) -> Step:
    """One step out of many, run from left to right."""
    return lambda df: functools.reduce(DataFrame.transform, steps, df)


def compose(*steps: Step) -> Step:
    """One step out of many, run from right to left."""
    return pipe(*reversed(steps))
