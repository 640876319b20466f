"""Column expressions, skew-safe ordered helpers and the few functions that run in Python."""

from pyspark import cloudpickle

from . import similarity

# Ship the functions that run in Python inside the task closure: executors need no installed package.
cloudpickle.register_pickle_by_value(similarity)
