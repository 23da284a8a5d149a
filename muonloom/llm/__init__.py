"""Operators for preparing text corpora.  Nothing outside this package imports it.

Functions of this package travel to the workers by value, so only the driver needs it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
