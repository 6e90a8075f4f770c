"""Daily-panel analytics on Spark: cleaning, features, causality, forecasting and validation."""

import sys

from pyspark import cloudpickle

# Functions used inside pandas UDFs travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
