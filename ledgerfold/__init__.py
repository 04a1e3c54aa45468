"""Ledgerfold: a PySpark-native engine for distress records and the tables around them."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
