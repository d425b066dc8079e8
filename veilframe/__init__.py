"""Spark-native privacy-preserving federated analytics."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so Python workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
