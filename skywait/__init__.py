"""Observation-availability analytics on Spark.

Worker functions travel with the query (pickled by value), so executors need only the
libraries the functions import, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
