"""weftline: catalog, event-log, graph, retrieval, telemetry and text analytics as Spark plans."""

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
