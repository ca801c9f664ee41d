"""Operators for preparing language-model training data.

Nothing else in the package imports this folder. Functions that run inside
tasks are shipped by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
