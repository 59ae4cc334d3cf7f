"""Support for functions that run in Python workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Send a module's functions to workers by value: executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
