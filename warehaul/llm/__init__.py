"""Operators for preparing training texts at scale, and their queries.

Functions of this package that run in Python workers travel by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
