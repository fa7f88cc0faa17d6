"""Spark-native analytics for network-flow telemetry."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to Python workers travel by value, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
