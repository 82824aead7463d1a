"""Data-quality analytics on Spark: profile, validate, clean, infer, detect, query."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python workers travel with their tasks, so executors need no
# copy of this package.
register_pickle_by_value(sys.modules[__name__])
