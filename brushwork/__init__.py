"""Data work behind interactive charts and point clouds, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
