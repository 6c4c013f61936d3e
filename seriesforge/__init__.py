"""Signal analytics over transactional tables, on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
