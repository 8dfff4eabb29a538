"""paceline: two-way participant/event analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code along, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
