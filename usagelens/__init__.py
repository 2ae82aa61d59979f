"""Usage analytics for developer-tool telemetry, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
