"""Stratalake: a declarative raw / canonical / analytical engine on PySpark."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
