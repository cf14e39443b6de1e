"""Document retrieval and corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel by value, so the package need only be
# installed where the job is submitted.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
