"""Knowledge-graph analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs
# no copy of the package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
