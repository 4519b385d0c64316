"""Literature screening on Spark: DataFrame operators, sources and ML stages."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
