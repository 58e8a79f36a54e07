"""Operators for training-data pipelines over the tables documents, labels and benchmark.

Functions that run in Python workers are sent by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
