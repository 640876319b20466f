"""The batch jobs on streams."""

from pyspark import cloudpickle

from . import state

cloudpickle.register_pickle_by_value(state)
