"""Annalist: longitudinal analytics as plain DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

__all__ = ["__version__"]
__version__ = "0.1.0"

# Functions of this package travel to executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
