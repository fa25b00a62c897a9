"""Regulatory-text monitoring on PySpark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions by value: executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
