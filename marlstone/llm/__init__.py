"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this subpackage. Its functions are shipped
to the executors by value, so that the cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
