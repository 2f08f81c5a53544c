"""Sensor time-series analytics on PySpark.

Every public function takes and returns DataFrames; nothing here runs a Spark job unless its
docstring says so.
"""

import sys

from pyspark import cloudpickle

from sensorweave.spec import SeriesSpec

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SeriesSpec"]
