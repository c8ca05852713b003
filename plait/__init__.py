"""Versioned property graphs and evidence journals on PySpark DataFrames.

Functions of this package that run in Python workers are shipped by value, so
executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
