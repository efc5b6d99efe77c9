"""Regulatory-record analytics as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
