"""Culling analytics over picture collections, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# What runs in Python on the executors goes there with the plan: they needn't
# have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
