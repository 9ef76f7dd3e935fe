"""Candle lake ingest on Spark."""

import sys

from pyspark import cloudpickle

# Tasks carry the package's own functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
