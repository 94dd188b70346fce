"""Training-data operators: one module per operator, ``queries`` registers them.

The package is pickled by value, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
