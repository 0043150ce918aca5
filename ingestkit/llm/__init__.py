"""Operators a training-data pipeline needs; nothing else in the library imports them.

The helpers that run in Python tasks travel with the plan, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
