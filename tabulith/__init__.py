"""Tabular science on Spark: DataFrame-to-DataFrame operators for profiling,
cleaning, dependence, ranking, modelling, conditioning and stability."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# executors get the Arrow helpers by value, so the package need not be installed there
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
