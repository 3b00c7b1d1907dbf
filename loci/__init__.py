"""loci: a PySpark-native engine for long-term textual memory.

Every operator takes DataFrames and returns a DataFrame; nothing is fetched
to the driver unless its size was checked first.
"""

import sys

from pyspark import cloudpickle

# Functions for the executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
