"""Spark-native analytics for time-lapse volumes, detections and tracks.

Every operator takes and returns DataFrames.  Relational work is declared with
the DataFrame API so that Catalyst plans it; only kernels that are sequential by
nature (assignment, region growing, optical flow) run as grouped Arrow functions.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the query: executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
