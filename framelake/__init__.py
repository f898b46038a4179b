"""Spark-native analytics over frame signals, page catalogs and near-duplicates."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
