"""Shelfmark: retrieval analytics over product catalogues, expressed as PySpark DataFrame operators.

The package's Python functions travel to the executors by value, so it needs to be installed only
where the driver runs.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
