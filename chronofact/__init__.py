"""A bitemporal fact store and hybrid retrieval engine on Spark."""

import sys

from pyspark import cloudpickle

# Functions for executors carry their code: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
