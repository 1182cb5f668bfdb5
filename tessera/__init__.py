"""Panel analytics and training-data operators on Spark.

Task code travels by value with each job, so executors need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
