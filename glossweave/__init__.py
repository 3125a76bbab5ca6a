"""Text extraction, bundle merging and translation-state tracking on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# task functions travel with the plan, so executors need no installed copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
