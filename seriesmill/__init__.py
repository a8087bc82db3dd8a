"""Panel forecasting analytics on Spark."""

import sys

from pyspark import cloudpickle

#: Functions sent to executors carry this package's code, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
