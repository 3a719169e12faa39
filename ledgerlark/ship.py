"""Functions for the executors travel by value: an executor need not have this package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
