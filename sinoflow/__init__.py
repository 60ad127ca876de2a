"""Spark-native tomographic reconstruction and dense-array analytics.

Worker functions are pickled by value, so executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
