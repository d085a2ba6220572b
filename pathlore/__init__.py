"""Event-log behaviour analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions and classes that tasks need travel inside the task: executors do not have to have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
