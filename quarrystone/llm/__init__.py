"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it can be removed as a
whole. ``registry`` lists its queries and their SQL for the driver entry point.

Functions that run on executors are pickled by value, so executors need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
