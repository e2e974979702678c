"""Operators for building training corpora.

Nothing else in the library imports this subpackage.  Code that runs inside
tasks is shipped by value with the task closures, so executors need only the
public Python packages, not this one.
"""
from pyspark import cloudpickle as _cloudpickle
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
