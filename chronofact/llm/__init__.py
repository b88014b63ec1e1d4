"""Training-data operators: filters, de-duplication, scans, search and packing.

Each module holds one operator with a general interface; ``queries`` applies
them to the driver's tables.  Nothing else in the library imports this
subpackage.  Functions that run on executors are shipped by value, so a
cluster needs no copy of the package on its workers' path.
"""

import sys

from pyspark import cloudpickle

from . import _text

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(_text)
