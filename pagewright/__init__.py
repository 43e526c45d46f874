"""Spark-native document retrieval and command-log analytics."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the job, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
