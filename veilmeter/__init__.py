"""Analytics over model traffic and text corpora on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry the library's code with them, so that workers need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
