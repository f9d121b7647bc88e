"""Security-operations analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
