"""Spark-native analytics for social-media corpora.

The package is shipped to the executors by value, so a cluster needs no copy of it on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
