"""tallyloom: corpus, ranking and program-text analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no copy of it on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
