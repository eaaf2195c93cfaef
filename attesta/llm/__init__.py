"""Operators and one pipeline for large text corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# the helpers travel with the task, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
