"""Training-data operators: each module holds one operator and its thin registered query."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
