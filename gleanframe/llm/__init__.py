"""Operators that prepare text for training language models.

Nothing outside this folder imports it.  Worker functions travel by value, so the package need
not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
