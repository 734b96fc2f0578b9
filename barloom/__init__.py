"""barloom: market-bar analytics expressed as Spark DataFrame plans."""

from pyspark import cloudpickle as _cloudpickle

from . import pytasks as _pytasks

# Task-side helpers travel inside the serialized closure, so executors need
# no separate install of this package.
_cloudpickle.register_pickle_by_value(_pytasks)

SERIES = ("symbol", "source", "interval", "adjustment")
