"""Training-data operators: deduplication, mixing, classification, encoding, formatting and quality.

Nothing else in the library imports this subpackage.  Its task code travels by
value with each job, so executors need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
