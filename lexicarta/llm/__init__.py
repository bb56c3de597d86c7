"""Operators for preparing training data.

Functions that run on executors are shipped by value, so that the executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
