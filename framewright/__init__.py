"""framewright: capture-data analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Worker functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
