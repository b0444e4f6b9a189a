"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get these functions by value, so that they need no copy of the library on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
